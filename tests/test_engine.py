import os
import zipfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import tideline

from tideline.functions import dsp, labels
from tideline.operators import loaders, sampling, signals, split, tensor
from tideline.plans import catalog
from tideline.sources import recordings, staging

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = duck.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (want, got))
    assert len(a) == len(b)
    for c in cols:
        assert ((a[c] == b[c]) | (a[c].isna() & b[c].isna())).all(), c


@pytest.mark.parametrize("kind,order", [("butter", 4), ("cheby1", 5), ("cheby2", 6), ("ellip", 8), ("ellip", 15)])
def test_filters_meet_their_masks(kind, order):
    z, p, k = dsp.lowpass(kind, order, 0.25)
    f = np.linspace(0, 1, 4001)
    w = np.exp(1j * np.pi * f)
    h = np.ones(len(f), complex)
    for q in dsp.sections(z, p, k):
        h *= (q[0] + q[1] / w + q[2] / w**2) / (1 + q[3] / w + q[4] / w**2)
    db = 20 * np.log10(np.abs(h) + 1e-12)
    assert np.abs(p).max() < 1
    if kind in ("ellip", "cheby1"):
        assert db[f < 0.2499].min() > -0.51 and db[f < 0.2499].max() < 0.01
    if kind == "butter":
        assert abs(db[1000] + 3.01) < 0.01
    if kind in ("ellip", "cheby2"):
        assert db[f > 0.3].max() < -59.5


def test_lfilter_is_the_recursion():
    x = np.random.default_rng(0).normal(size=(3, 50))
    b, a = np.array([0.2, 0.1, 0.05]), np.array([1.0, -0.4, 0.2])
    want = np.zeros_like(x)
    for t in range(50):
        want[:, t] = sum(b[j] * x[:, t - j] for j in range(3) if t >= j) - sum(a[j] * want[:, t - j] for j in (1, 2) if t >= j)
    assert np.allclose(dsp.lfilter(b, a, x), want)
    assert np.allclose(dsp.filtfilt(b, a, np.full((1, 40), 2.0)), 2.0 * (b.sum() / a.sum()) ** 2)


def test_tachometer():
    t = np.arange(50_000) / 50_000
    assert np.allclose(dsp.TachometerProcessor()((np.sin(2 * np.pi * 20 * t) > 0.9) * 5.0), 1200)
    assert (dsp.TachometerProcessor()(np.zeros(1000)) == 0).all()
    assert (dsp.TachometerProcessor()(np.full(1000, 3.3)) == 0).all()


PATHS = [
    ("normal/12.288.csv", "normal", "", 737), ("imbalance/6g/13.1072.csv", "imbalance", "6g", 786), ("imbalance/12.5.csv", "imbalance", "12.5.csv", 750),
    ("horizontal-misalignment/0.5mm/20.csv", "horizontal-misalignment", "0.5mm", 1200), ("vertical-misalignment/0.51mm/20.csv", "vertical-misalignment", "0.51mm", 1200),
    ("overhang/ball_fault/20g/30.csv", "overhang-ball_fault", "20g", 1800), ("underhang/outer_race/35g/30.csv", "underhang-outer_race", "35g", 1800), ("other/x/readme.csv", "unknown", "", -1),
]


def test_paths(spark):
    rows = spark.createDataFrame([(p,) for p, *_ in PATHS], "p string")
    got = rows.select("p", labels.fault_type(F.col("p")), labels.fault_severity(F.col("p")), labels.rpm(F.col("p"))).collect()
    assert [tuple(r) for r in got] == PATHS
    bad = spark.createDataFrame([("my-horizontal-misalignment-v2/0.5mm/20.csv",), ("normal/1.csv",)], "p string").select(labels.path_is_broken(F.col("p"))).collect()
    assert [r[0] for r in bad] == [True, False]


def test_ingest_store_and_filters(spark, tmp_path):
    rng, want = np.random.default_rng(1), {}
    for p, *_ in [*PATHS, ("my-horizontal-misalignment-v2/0.5mm/20.csv",)]:
        x = rng.normal(size=(200, 8)).round(3)
        path = tmp_path / "raw" / p
        path.parent.mkdir(parents=True, exist_ok=True)
        np.savetxt(path, x, delimiter=",", fmt="%.3f")
        want[p[:-4]] = x.astype(np.float32)
    (tmp_path / "raw/normal/bad.csv").write_text("1,2\n3,x\n")
    good, errors = recordings.ingest_csv(spark, str(tmp_path / "raw"))
    assert {r.rel for r in errors.collect()} == {"my-horizontal-misalignment-v2/0.5mm/20.csv", "normal/bad.csv"}
    recordings.write_store(good, str(tmp_path / "store"))
    store = recordings.with_file_index(recordings.read_store(spark, str(tmp_path / "store")))
    rows = {r.file_path: r for r in store.collect()}
    assert len(rows) == 8
    for path, r in rows.items():
        assert np.array_equal(np.array([r[s] for s in labels.SENSORS], np.float32).T, want[path])
    plan = tensor.select_files(recordings.read_store(spark, str(tmp_path / "store")), target_classes=["normal"], rpm_range=(700, 800)).select("label", "Microphone")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(rpm)" in plan and "Radial" not in plan.split("ReadSchema")[-1]
    got = signals.filter_recordings(store, {"Microphone": lambda x: x * 2}, 3).first()
    assert got.n_samples == 67 == len(got.Microphone) == len(got.Tachometer) and got.fs == pytest.approx(50_000 / 3)
    with pytest.raises(RuntimeError):
        recordings.ingest_csv(spark, str(tmp_path / "store"))
    with pytest.raises(ValueError):
        tensor.load(store, target_classes=["misalignment"], eager=True)


def split_rule(n, train, val):
    test = 1 - train - val
    if n >= 4 and test > 0.02 and val > 0.02:
        a, v = int(np.floor(n * train)), int(np.ceil(n * val))
        a = max(1, n - v - 1) if a + v >= n else a
        return max(1, a), max(1, a) + max(1, v)
    if test <= 0.02:
        return (3, 4) if n == 4 else (max(1, round(n * train)), n)
    return {4: (2, 3), 3: (1, 2)}.get(n, (1, n))


@pytest.mark.parametrize("train,val", [(0.75, 0.25), (0.7, 0.2), (0.5, 0.25), (0.7, 0.0)])
def test_split_table(spark, train, val):
    sizes = [1, 2, 3, 4, 5, 50]
    rows = [(i * 100 + j, f"c{n}") for i, n in enumerate(sizes) for j in range(n)]
    got = split.stratified_file_split(spark.createDataFrame(rows, "file_idx int, label string"), train, val, strict=True).toPandas()
    assert len(got) == len(rows) == got.file_idx.nunique()
    for n in sizes:
        c = got[got.label == f"c{n}"].split.value_counts()
        a, b = split_rule(n, train, val)
        assert (c.get("train", 0), c.get("train", 0) + c.get("val", 0)) == (min(a, n), min(max(a, b), n))
    with pytest.raises(ValueError):
        split.stratified_file_split(spark.createDataFrame(rows, "file_idx int, label string"), 0.8, 0.3)


def small(spark):
    rows = [(f, i, f"c{i % 2}", "s", float(i), [float(f * 100 + i * 10 + t) for t in range(10)]) for f in range(2) for i in (2, 5, 9)]
    return spark.createDataFrame(rows, "fold int, file_idx int, label string, severity string, rpm float, x array<double>")


def test_windows_lookup_and_order(spark):
    t = small(spark)
    rows = tensor.windows(t, 4, 3).orderBy("flat_idx").collect()
    assert [r.flat_idx for r in rows] == list(range(18))
    for i in (0, 7, 17):
        w = tensor.get_window(t, i, 4, 3, 2, [2, 5, 9], 10).first()
        assert (w.fold, w.file_idx, w.win_idx, w.x) == (rows[i].fold, rows[i].file_idx, rows[i].win_idx, rows[i].x)
    with pytest.raises(IndexError):
        tensor.get_window(t, 18, 4, 3, 2, [2, 5, 9], 10)
    assert tensor.windows(t, 11, 1).count() == 0 and tensor.windows(t, 10, 1).count() == 6
    assert [r.file_idx for r in tensor.windows(t, 10, 1, valid_folds=[1], valid_files=[9, 2]).orderBy("flat_idx").collect()] == [9, 2]


def test_episode_and_batches(spark):
    w = tensor.windows(small(spark), 4, 3)
    names = {0: "c0", 1: "c1"}
    got = sampling.episode(w, names, [0, 1, 0], [2, 3, 1], seed=3).orderBy("pos").collect()
    assert [r.pos for r in got] == list(range(6)) and len({(r.req_pos, r.flat_idx) for r in got}) == 6
    again = sampling.episode(w.repartition(5), names, [0, 1, 0], [2, 3, 1], seed=3).orderBy("pos").collect()
    assert [r.flat_idx for r in got] == [r.flat_idx for r in again]
    for classes, k in (([0], [99]), ([5], [1]), ([0, 1], [1])):
        with pytest.raises(ValueError):
            sampling.episode(w, names, classes, k)
    x = list(loaders.get_pytorch_dataloader(w, {"c0": 0, "c1": 1}, ["x"], 4, shuffle=True))
    assert [len(b[1]) for b in x] == [4, 4, 4, 4, 2] and x[0][0].shape == (4, 1, 4)
    with pytest.raises(Exception, match="no class number"):
        loaders.encoded(w, {"c0": 0}).select("y").collect()


def test_staging(spark, tmp_path):
    src = tmp_path / "src/deep"
    src.mkdir(parents=True)
    (src / "a.txt").write_text("a" * 100)
    assert staging.create_zip(str(tmp_path / "src"), str(tmp_path / "x.zip")) and zipfile.ZipFile(tmp_path / "x.zip").namelist() == ["deep/a.txt"]
    assert staging.extract_zip(str(tmp_path / "x.zip"), str(tmp_path / "out")) and staging.total_bytes(tmp_path / "out") == 100
    assert staging.extract_zip(str(tmp_path / "none.zip"), str(tmp_path / "out"))  # it is there
    (tmp_path / "bad.zip").write_bytes(b"no")
    assert not staging.extract_zip(str(tmp_path / "bad.zip"), str(tmp_path / "out"), replace=True) and staging.total_bytes(tmp_path / "out") == 100
    assert staging.safe_copy(str(tmp_path / "out"), str(tmp_path / "copy")) and staging.total_bytes(tmp_path / "copy") == 100
    ranges = staging.byte_ranges(spark, 1003, 4).orderBy("part").collect()
    assert ranges[0].first == 0 and ranges[-1].last == 1002 and all(a.last + 1 == b.first for a, b in zip(ranges, ranges[1:]))


def test_blocks_filter_like_the_recursion():
    x = np.random.default_rng(2).normal(size=(4, 5000))
    for q in dsp.sections(*dsp.lowpass("ellip", 8, 0.25)):
        b, a = q[:3], np.array([1.0, *q[3:]])
        state = np.random.default_rng(3).normal(size=(2, 4))
        want, _ = dsp.recursion(b, a, x, np.ascontiguousarray(state.T))
        assert np.allclose(dsp.lfilter(b, a, x, state), want, atol=1e-9)
    whole, one = dsp.AccelerometerFilter()(x), x
    for q in dsp.sections(*dsp.AccelerometerFilter().zpk):
        one = dsp.recursion(q[:3], np.array([1.0, *q[3:]]), one, np.zeros((4, 2)))[0]
    assert np.allclose(whole, one, atol=1e-9)
    assert np.allclose(whole[2], dsp.AccelerometerFilter()(x[2])) and np.isfinite(whole).all()


def test_many_series_take_little_more_than_one():
    import time

    x = np.random.default_rng(4).normal(size=(64, 50_000))
    f = dsp.AccelerometerFilter()

    def took(rows):
        began = time.perf_counter()
        f(rows)
        return time.perf_counter() - began

    took(x[:1])
    one, all_ = min(took(x[:1]) for _ in range(2)), took(x)
    assert all_ < 40 * one and all_ < 10


def test_close_edges_by_rule(spark):
    rng = np.random.default_rng(5)
    for _ in range(20):
        e = np.sort(rng.choice(2000, 80, replace=False))
        least = max(1, round(0.7 * float(np.median(np.diff(e)))))
        want, last = [], None
        for v in e.tolist()[::-1]:
            if last is None or last - v >= least:
                want.append(v)
                last = v
        assert dsp.apart(e, 0.7).tolist() == want[::-1]
    rows = spark.createDataFrame([(f, int(i)) for f in ("a", "b") for i in e] + [("c", 7)], "file string, i int")
    got = signals.close_edges_removed(rows).collect()
    assert sorted(r.i for r in got if r.file == "a") == want[::-1] and [r.i for r in got if r.file == "c"] == [7]


def test_filter_store_keeps_errors_and_settings(spark, tmp_path):
    rows = [(f"normal/{k}", f"{k}.csv", "normal", "", 600 + k, n, *([[float(v) for v in np.sin(np.arange(n) / (3 + k))]] * 8)) for k, n in enumerate((400, 400, 300, 10))]
    schema = "file_path string, original_filename string, fault_type string, fault_severity string, rpm int, n_samples int, " + ", ".join(f"`{s}` array<float>" for s in labels.SENSORS)
    recordings.write_store(spark.createDataFrame(rows, schema), str(tmp_path / "a"))
    accel, tacho = dsp.AccelerometerFilter(), dsp.TachometerProcessor()
    failed = signals.filter_store(spark, str(tmp_path / "a"), str(tmp_path / "b"), {"Tachometer": tacho, **{s: accel for s in labels.ACCELEROMETERS}}, 5)
    assert [(r.file_path, "Tachometer: ValueError" in r.error) for r in failed.collect()] == [("normal/3", True)]
    back = recordings.read_store(spark, str(tmp_path / "b/recordings")).orderBy("file_path").collect()
    assert [r.n_samples for r in back] == [80, 80, 60] and all(r.fs == 10_000 for r in back)
    x = np.array(rows[1][6], np.float32).astype(float)
    assert np.allclose(back[1]["UH Axial Acc"], accel(x)[::5]) and np.allclose(back[1]["Tachometer"], tacho(x)[::5]) and np.allclose(back[1]["Microphone"], x[::5])
    said = {r.name: r.value for r in spark.read.parquet(str(tmp_path / "b/_attributes")).collect()}
    assert said["downsample_factor"] == "5" and said["filter.Tachometer"] == "TachometerProcessor"


def test_ingest_parses_once_in_half_precision(spark, tmp_path):
    (tmp_path / "raw/normal").mkdir(parents=True)
    x = np.random.default_rng(6).normal(size=(50, 8))
    np.savetxt(tmp_path / "raw/normal/12.5.csv", x, delimiter=",")
    (tmp_path / "raw/normal/bad.csv").write_text("1,2\n3,x\n")
    errors = tideline.ingest(spark, str(tmp_path / "raw"), str(tmp_path / "store"))
    assert [r.rel for r in errors.collect()] == ["normal/bad.csv"] and not (tmp_path / "store_parsed").exists()
    row = tideline.read_store(spark, str(tmp_path / "store")).collect()
    assert len(row) == 1 and np.array_equal(row[0]["Microphone"], x[:, 7].astype(np.float16).astype(np.float32))


def test_feature_loaders(spark, tmp_path):
    w = tensor.windows(small(spark), 4, 3)
    stored = loaders.feature_extraction_pipeline(w, str(tmp_path / "f"), ["x"], names=["min", "max"])
    codes = {"c0": 0, "c1": 1}
    got = list(loaders.get_tensorflow_featureset(stored, codes, 4))
    assert [len(y) for _, y in got] == [4, 4, 4, 4, 2] and got[0][0].shape == (4, 2) and got[0][1].dtype == np.int32
    want = w.orderBy("flat_idx").collect()
    assert np.allclose(np.concatenate([x for x, _ in got])[:, 0], [min(r.x) for r in want])
    x = list(loaders.get_pytorch_feature_loader(stored, codes, 4, shuffle=True, with_meta=True, valid_folds=[1], valid_files=[2, 9]))
    assert sum(len(b[1]) for b in x) == 6 and x[0][2][0][0] == "s" and set(np.concatenate([b[2][1] for b in x])) == {2.0, 9.0}
    own = loaders.feature_extraction_pipeline(w, str(tmp_path / "g"), ["x"], lambda v: v.mean(axis=1), 4)
    assert next(iter(loaders.get_pytorch_feature_loader(own, codes, 32, shuffle=False)))[0].shape == (18, 1)
    assert [len(y) for _, y in loaders.get_tensorflow_dataset(w, codes, ["x"], 8, valid_files=[5])] == [6]
    with pytest.raises(FileNotFoundError):
        loaders.read_features(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        loaders.feature_extraction_pipeline(w, str(tmp_path / "h"), ["x"], lambda v: v)


def test_numbering_by_quantiles(spark, monkeypatch):
    monkeypatch.setattr(loaders, "RANGE_ROWS", 40)
    rows = spark.createDataFrame([(i * i * i % 10_007 * 3, "c0") for i in range(1000)], "flat_idx long, label string").distinct()
    got = loaders.batches(rows, 32).orderBy("flat_idx").collect()
    assert [r.batch * 32 + r.slot for r in got] == list(range(len(got)))


def test_concat_sink_and_many_tensors(spark, tmp_path):
    t = small(spark)
    got = tensor.concat_to([t] * 6, str(tmp_path / "c"), 1)
    assert got.count() == 36 and got.agg(F.max("file_idx")).first()[0] == 59 and tensor.materialised(t, str(tmp_path / "m")).count() == 6


def test_half_precision_column(spark):
    got = spark.createDataFrame([([0.1, 2.0, 70_000.0],), (None,)], "x array<float>").select(loaders.as_half(F.col("x")).alias("x")).collect()
    assert got[0].x[:2] == [float(np.float16(0.1)), 2.0] and np.isinf(got[0].x[2]) and got[1].x is None


def test_download_from_a_local_server(tmp_path):
    import http.server
    import threading

    body = bytes(range(256)) * 500

    class Handler(http.server.BaseHTTPRequestHandler):
        ranged = True

        def reply(self, send):
            first, last = 0, len(body) - 1
            if self.ranged and (r := self.headers.get("Range")):
                first, last = map(int, r.removeprefix("bytes=").split("-"))
            self.send_response(206 if self.headers.get("Range") and self.ranged else 200)
            if self.ranged:
                self.send_header("Accept-Ranges", "bytes")
            self.send_header("Content-Length", str(last - first + 1))
            self.end_headers()
            if send:
                self.wfile.write(body[first : last + 1])

        def do_HEAD(self):
            self.reply(False)

        def do_GET(self):
            self.reply(True)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}/x"
        (tmp_path / "a.bin.part1").write_bytes(body[32_000:33_000])  # resumed
        assert staging.download(url, str(tmp_path / "a.bin"), 1, 1, 0, num_connections=4) and (tmp_path / "a.bin").read_bytes() == body
        Handler.ranged = False
        assert staging.download(url, str(tmp_path / "b.bin"), 1, 1, 0) and (tmp_path / "b.bin").read_bytes() == body
        assert not staging.download(url, str(tmp_path / "c.bin"), len(body) + 1, 2, 0) and not (tmp_path / "c.bin").exists()
        assert staging.download(url, str(tmp_path / "a.bin"), 1)
    finally:
        server.shutdown()
