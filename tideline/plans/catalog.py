"""The driver's queries and their SQL, over stand-ins for recordings.

A supplier's lineitems in order are a four-sensor recording; its region is the class, its nation the severity and its
balance the speed. A user's events are a one-sensor recording. Embeddings are recordings of 64 samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import features, labels
from tideline.operators import loaders, sampling, signals, split, tensor
from tideline.sources import staging
from tideline.streaming import live

SENSORS = ["q", "p", "d", "t"]
SQL: dict[str, str] = {}
RUN: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        RUN[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(RUN)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.struct(*keys, F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t")))).alias("s"))
    s, n, r = table(spark, sf, "supplier"), table(spark, sf, "nation"), table(spark, sf, "region")
    files = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    own = {"q": "s.q", "p": "s.l_extendedprice", "d": "s.d", "t": "s.t"}
    return files.join(rows, F.col("s_suppkey") == F.col("l_suppkey")).select(F.col("s_suppkey").cast("int").alias("file_idx"), F.col("r_name").alias("fault_type"), F.col("n_name").alias("fault_severity"), F.col("s_acctbal").alias("rpm"), F.size("s").alias("n_samples"), *(F.col(v).alias(k) for k, v in own.items()))


ORDER = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice"
#: Recordings, and the tensor of the given folds after a filter.
REC = f"""rec AS (SELECT CAST(s_suppkey AS INTEGER) AS file_idx, r_name AS label, n_name AS severity, CAST(s_acctbal AS FLOAT) AS rpm, s_acctbal AS balance, CAST(count(*) AS INTEGER) AS n_samples,
list(l_quantity {ORDER}) AS q, list(l_extendedprice {ORDER}) AS p, list(l_discount {ORDER}) AS d, list(l_tax {ORDER}) AS t
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY s_suppkey, r_name, n_name, s_acctbal)"""


def ten(folds: int, where: str = "true") -> str:
    return f"""WITH {REC}, sel AS (SELECT * FROM rec WHERE {where}), m AS (SELECT CAST(min(n_samples) // {folds} AS INTEGER) AS chunk FROM sel),
ten AS (SELECT CAST(fold AS INTEGER) AS fold, file_idx, label, severity, rpm, chunk, q[fold*chunk+1:fold*chunk+chunk] AS q, p[fold*chunk+1:fold*chunk+chunk] AS p, d[fold*chunk+1:fold*chunk+chunk] AS d, t[fold*chunk+1:fold*chunk+chunk] AS t FROM sel, m, (SELECT unnest(range(0, {folds})) AS fold))"""


def win(size: int, step: int, folds: int = 4, where: str = "true") -> str:
    return ten(folds, where) + f""", pos AS (SELECT file_idx, row_number() OVER (ORDER BY file_idx) - 1 AS fp, count(*) OVER () AS nf FROM (SELECT DISTINCT file_idx FROM ten)),
win AS (SELECT fold, file_idx, label, severity, rpm, CAST(w AS INTEGER) AS win_idx, CAST((fold * nf + fp) * per + w AS BIGINT) AS flat_idx, q[w*{step}+1:w*{step}+{size}] AS q, p[w*{step}+1:w*{step}+{size}] AS p, d[w*{step}+1:w*{step}+{size}] AS d, t[w*{step}+1:w*{step}+{size}] AS t
FROM (SELECT *, unnest(range(0, per)) AS w FROM (SELECT *, greatest(0, floor((chunk - {size}) / {step})::INTEGER + 1) AS per FROM ten JOIN pos USING (file_idx))))"""


def loaded(spark, sf, folds=4, **kw) -> DataFrame:
    return tensor.load(recordings(spark, sf), folds=folds, selected_sensors=SENSORS, **kw)


def windowed(spark, sf, size=64, step=32, folds=4, **kw) -> DataFrame:
    return tensor.windows(loaded(spark, sf, folds, **kw), size, step)


# ---------------------------------------------------------------- metadata and labels

TYPES = ["normal", "imbalance", "horizontal-misalignment", "vertical-misalignment", "overhang/ball_fault", "underhang/outer_race", "other", "imbalance", "normal"]
PATHS = """paths AS (SELECT page_id, concat(CASE page_id % 9 WHEN 0 THEN 'normal' WHEN 1 THEN 'imbalance' WHEN 2 THEN 'horizontal-misalignment' WHEN 3 THEN 'vertical-misalignment' WHEN 4 THEN 'overhang/ball_fault' WHEN 5 THEN 'underhang/outer_race' WHEN 6 THEN 'other' WHEN 7 THEN 'imbalance' ELSE 'normal' END,
CASE WHEN page_id % 9 IN (0, 7, 8) THEN '' ELSE concat('/', page_id % 5, 'g') END, '/', CASE WHEN page_id % 13 = 12 THEN 'readme' ELSE concat(page_id * 37 % 6000 // 100, '.', lpad(CAST(page_id * 37 % 100 AS VARCHAR), 2, '0')) END, '.csv') AS path FROM pages)"""


def paths(spark, sf) -> DataFrame:
    i = F.col("page_id")
    kind = F.element_at(F.array(*map(F.lit, TYPES)), (i % 9 + 1).cast("int"))
    severity = F.when((i % 9).isin(0, 7, 8), "").otherwise(F.concat(F.lit("/"), (i % 5).cast("string"), F.lit("g")))
    stem = F.when(i % 13 == 12, "readme").otherwise(F.concat(F.floor(i * 37 % 6000 / 100).cast("string"), F.lit("."), F.lpad((i * 37 % 100).cast("string"), 2, "0")))
    return table(spark, sf, "pages").select("page_id", F.concat(kind, severity, F.lit("/"), stem, F.lit(".csv")).alias("path"))


PARSED = PATHS + """, parsed AS (SELECT page_id, path, string_split(path, '/') AS s, regexp_replace(list_last(string_split(path, '/')), '\\.[^.]*$', '') AS stem FROM paths),
meta AS (SELECT page_id, CASE WHEN list_contains(s, 'normal') THEN 'normal' WHEN list_contains(s, 'imbalance') THEN 'imbalance' WHEN contains(path, 'horizontal-') THEN 'horizontal-misalignment' WHEN contains(path, 'vertical-misalignment') THEN 'vertical-misalignment' WHEN list_contains(s, 'overhang') THEN concat('overhang-', s[2]) WHEN list_contains(s, 'underhang') THEN concat('underhang-', s[2]) ELSE 'unknown' END AS fault_type,
CASE WHEN list_contains(s, 'normal') THEN '' WHEN list_contains(s, 'imbalance') OR contains(path, 'horizontal-') OR contains(path, 'vertical-misalignment') THEN s[2] WHEN list_contains(s, 'overhang') OR list_contains(s, 'underhang') THEN s[3] ELSE '' END AS fault_severity,
coalesce(CAST(round_even(TRY_CAST(stem AS DOUBLE) * 60, 0) AS INTEGER), -1) AS rpm, list_last(s) AS original_filename, regexp_replace(path, '\\.[^./]*$', '') AS array_path FROM parsed)"""


def metadata(spark, sf) -> DataFrame:
    p = F.col("path")
    return paths(spark, sf).select("page_id", labels.fault_type(p).alias("fault_type"), labels.fault_severity(p).alias("fault_severity"), labels.rpm(p).alias("rpm"), labels.file_name(p).alias("original_filename"), labels.array_path(p).alias("array_path"))


@query("ingest_path_metadata", f"WITH {PARSED} SELECT * FROM meta")
def _(spark, sf):
    return metadata(spark, sf)


@query("label_types_and_severity", f"WITH {PARSED} SELECT page_id, concat(fault_type, fault_severity) AS label, fault_severity AS severity FROM meta")
def _(spark, sf):
    a, b = labels.label_of(F.col("fault_type"), F.col("fault_severity"), "types & severity", True)
    return metadata(spark, sf).select("page_id", a.alias("label"), b.alias("severity"))


@query("label_group_direction", f"WITH {PARSED} SELECT page_id, CASE WHEN contains(fault_type, 'misalignment') THEN 'misalignment' ELSE fault_type END AS label, CASE WHEN contains(fault_type, 'misalignment') THEN concat(split_part(fault_type, '-', 1), fault_severity) ELSE fault_severity END AS severity FROM meta")
def _(spark, sf):
    a, b = labels.label_of(F.col("fault_type"), F.col("fault_severity"), "only types", True)
    return metadata(spark, sf).select("page_id", a.alias("label"), b.alias("severity"))


@query("label_defaults", "SELECT s_suppkey AS k, coalesce(CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_name END, 'unknown') AS fault_type, coalesce(CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE 'x' END, '') AS severity, coalesce(CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_acctbal END, 0.0) AS rpm FROM supplier")
def _(spark, sf):
    k = F.col("s_suppkey")
    a, b, c = labels.with_defaults(F.when(k % 3 != 0, F.col("s_name")), F.when(k % 4 != 0, F.lit("x")), F.when(k % 5 != 0, F.col("s_acctbal")))
    return table(spark, sf, "supplier").select(k.alias("k"), a.alias("fault_type"), b.alias("severity"), c.alias("rpm"))


@query("temp_names", r"SELECT page_id, regexp_replace(concat('d/', page_id, '.csv'), '^(.*?)(\.[^./]*)?$', '\1_tmp\2') AS name FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", labels.temp_name(F.concat(F.lit("d/"), F.col("page_id").cast("string"), F.lit(".csv"))).alias("name"))


# ---------------------------------------------------------------- filters, alignment, folds

FILES = f"WITH {REC} SELECT file_idx, label, severity, rpm, n_samples FROM rec WHERE "


def files(spark, sf, **kw) -> DataFrame:
    return tensor.select_files(recordings(spark, sf), **kw).select("file_idx", "label", "severity", "rpm", "n_samples")


@query("load_filter_class_severity_rpm", FILES + "label IN ('ASIA', 'EUROPE', 'AMERICA') AND balance BETWEEN 1000 AND 8000")
def _(spark, sf):
    return files(spark, sf, target_classes=["ASIA", "EUROPE", "AMERICA"], rpm_range=(1000, 8000))


@query("load_filter_single_class", FILES + "label = 'ASIA'")
def _(spark, sf):
    return files(spark, sf, target_classes="ASIA")


@query("load_filter_strict_substring", FILES + "contains('ASIA EUROPE', label)")
def _(spark, sf):
    return files(spark, sf, target_classes="ASIA EUROPE", strict=True)


@query("load_filter_severity", FILES + "severity IN (SELECT n_name FROM nation WHERE n_nationkey < 10)")
def _(spark, sf):
    names = [r[0] for r in table(spark, sf, "nation").where("n_nationkey < 10").select("n_name").collect()]
    return files(spark, sf, target_severities=names)


@query("sensor_projection_long", f"WITH {REC}, u AS (SELECT file_idx, 'q' AS sensor, q AS x FROM rec UNION ALL SELECT file_idx, 't', t FROM rec) SELECT file_idx, sensor, round(list_sum(x), 4) AS total, CAST(len(x) AS INTEGER) AS n FROM u")
def _(spark, sf):
    rows = recordings(spark, sf).select("file_idx", "q", "t").unpivot("file_idx", ["q", "t"], "sensor", "x")
    return rows.select("file_idx", "sensor", F.round(features.total(F.col("x")), 4).alias("total"), F.size("x").alias("n"))


@query("tensor_shape_align", f"WITH {REC} SELECT count(*) AS n_files, min(n_samples) AS min_length, CAST(min(n_samples) // 4 AS INTEGER) AS chunk_length FROM rec")
def _(spark, sf):
    return tensor.shape(recordings(spark, sf), 4)


@query("fold_slices", ten(4) + " SELECT fold, file_idx, label, CAST(len(q) AS INTEGER) AS n, q[1] AS first_q, q[-1] AS last_q, round(list_sum(p), 2) AS sum_p FROM ten")
def _(spark, sf):
    return loaded(spark, sf).select("fold", "file_idx", "label", F.size("q").alias("n"), F.element_at("q", 1).alias("first_q"), F.element_at("q", -1).alias("last_q"), F.round(features.total(F.col("p")), 2).alias("sum_p"))


@query("fold_clamp", ten(1) + " SELECT fold, file_idx, CAST(len(q) AS INTEGER) AS n FROM ten")
def _(spark, sf):
    return loaded(spark, sf, 0).select("fold", "file_idx", F.size("q").alias("n"))


# ---------------------------------------------------------------- windows


@query("window_count_per_file", ten(4) + " SELECT file_idx, CAST(sum(greatest(0, floor((chunk - 64) / 32)::INTEGER + 1)) AS BIGINT) AS n FROM ten GROUP BY 1")
def _(spark, sf):
    return loaded(spark, sf).groupBy("file_idx").agg(F.sum(tensor.windows_per_series(F.size("q"), 64, 32)).alias("n"))


@query("window_total", win(64, 32) + " SELECT count(*) AS n FROM win")
def _(spark, sf):
    return windowed(spark, sf).agg(F.count("*").alias("n"))


@query("window_virtual_index", win(64, 32) + " SELECT fold, file_idx, win_idx, flat_idx, label, severity, rpm, q[1] AS first_q FROM win")
def _(spark, sf):
    return windowed(spark, sf).select("fold", "file_idx", "win_idx", "flat_idx", "label", "severity", "rpm", F.element_at("q", 1).alias("first_q"))


@query("window_point_lookup", win(64, 32) + " SELECT fold, file_idx, win_idx, flat_idx, round(list_sum(p), 2) AS sum_p FROM win WHERE flat_idx = 25")
def _(spark, sf):
    own = recordings(spark, sf)
    chunk = tensor.shape(own, 4).first().chunk_length
    known = [r[0] for r in table(spark, sf, "supplier").select("s_suppkey").orderBy("s_suppkey").collect()]
    w = tensor.get_window(loaded(spark, sf), 25, 64, 32, 4, known, chunk)
    return w.select("fold", "file_idx", "win_idx", "flat_idx", F.round(features.total(F.col("p")), 2).alias("sum_p"))


STATS = "round(list_sum(q) / len(q), 6) AS mean_q, list_min(q) AS min_q, list_max(q) AS max_q, round(sqrt(list_sum(list_transform(q, lambda x: x * x)) / len(q)), 6) AS rms_q"


def stats(rows: DataFrame) -> DataFrame:
    q = F.col("q")
    return rows.select("fold", "file_idx", "win_idx", F.round(features.mean(q), 6).alias("mean_q"), F.array_min(q).alias("min_q"), F.array_max(q).alias("max_q"), F.round(features.rms(q), 6).alias("rms_q"))


@query("window_physical_stats", win(64, 32) + f" SELECT fold, file_idx, win_idx, {STATS} FROM win")
def _(spark, sf):
    return stats(windowed(spark, sf))


@query("window_tumbling", win(32, 32) + f" SELECT fold, file_idx, win_idx, {STATS} FROM win")
def _(spark, sf):
    return stats(windowed(spark, sf, 32, 32))


@query("window_hopping_gap", win(16, 48) + f" SELECT fold, file_idx, win_idx, {STATS} FROM win")
def _(spark, sf):
    return stats(windowed(spark, sf, 16, 48))


@query("window_longer_than_series", win(4096, 32) + f" SELECT fold, file_idx, win_idx, {STATS} FROM win")
def _(spark, sf):
    return stats(windowed(spark, sf, 4096, 32))


@query("valid_files_order", ten(4) + """, v AS (SELECT unnest([7, 3, 5]) AS file_idx, unnest([0, 1, 2]) AS fp), f AS (SELECT unnest([2, 0]) AS fold, unnest([0, 1]) AS ff)
SELECT fold, file_idx, CAST(w AS INTEGER) AS win_idx, CAST((ff * 3 + fp) * per + w AS BIGINT) AS flat_idx FROM (SELECT *, unnest(range(0, per)) AS w FROM (SELECT ten.fold, ten.file_idx, ff, fp, greatest(0, floor((chunk - 64) / 32)::INTEGER + 1) AS per FROM ten JOIN v USING (file_idx) JOIN f USING (fold)))""")
def _(spark, sf):
    return tensor.windows(loaded(spark, sf), 64, 32, valid_folds=[2, 0], valid_files=[7, 3, 5]).select("fold", "file_idx", "win_idx", "flat_idx")


@query("meta_broadcast", win(64, 32) + " SELECT label, severity, count(*) AS n, round(avg(rpm), 3) AS mean_rpm FROM win GROUP BY ALL")
def _(spark, sf):
    return windowed(spark, sf).groupBy("label", "severity").agg(F.count("*").alias("n"), F.round(F.avg("rpm"), 3).alias("mean_rpm"))


EMB = "e AS (SELECT vec_id, label, fold, embedding[fold*16+1:fold*16+16] AS x FROM embeddings, (SELECT unnest(range(0, 4)) AS fold))"


@query("prewindowed_embeddings", f"WITH {EMB} SELECT vec_id, CAST(fold AS INTEGER) AS fold, CAST(w AS INTEGER) AS win_idx, round(list_max(list_transform(x[w*4+1:w*4+8], lambda v: CAST(v AS DOUBLE))), 6) AS top FROM e, (SELECT unnest(range(0, 3)) AS w)")
def _(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("fold"), "embedding")
    rows = rows.select("vec_id", "fold", F.slice("embedding", F.col("fold") * 16 + 1, 16).alias("x")).withColumn("win_idx", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return rows.select("vec_id", "fold", "win_idx", F.round(F.array_max(F.slice("x", F.col("win_idx") * 4 + 1, 8).cast("array<double>")), 6).alias("top"))


@query("events_windows", """WITH s AS (SELECT user_id, list(value ORDER BY event_id) AS x FROM events GROUP BY 1), m AS (SELECT min(len(x)) // 2 AS chunk FROM s), f AS (SELECT user_id, fold, chunk, x[fold*chunk+1:fold*chunk+chunk] AS x FROM s, m, (SELECT unnest(range(0, 2)) AS fold)),
w AS (SELECT user_id, fold, x, unnest(range(0, floor((chunk - 8) / 4)::INTEGER + 1)) AS w FROM f) SELECT user_id, CAST(fold AS INTEGER) AS fold, CAST(w AS INTEGER) AS win_idx, round(list_sum(x[w*4+1:w*4+8]) / 8, 6) AS mean_value, list_max(x[w*4+1:w*4+8]) AS max_value FROM w""")
def _(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias("x"))
    chunk = rows.agg(F.floor(F.min(F.size("x")) / 2).cast("int").alias("chunk")).scalar()
    rows = rows.withColumn("chunk", chunk).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(1))))
    rows = rows.select("user_id", "fold", F.slice("x", F.col("fold") * F.col("chunk") + 1, F.col("chunk")).alias("x"))
    rows = rows.withColumn("per", tensor.windows_per_series(F.size("x"), 8, 4)).where("per > 0").withColumn("win_idx", F.explode(F.sequence(F.lit(0), F.col("per") - 1)))
    x = F.slice("x", F.col("win_idx") * 4 + 1, 8)
    return rows.select("user_id", "fold", "win_idx", F.round(features.mean(x), 6).alias("mean_value"), F.array_max(x).alias("max_value"))


# ---------------------------------------------------------------- splits

MIX = "(CAST({k} AS BIGINT) * 2654435761 + {seed}) % 4294967296"
LABELLED = "f AS (SELECT CAST(s_suppkey AS INTEGER) AS file_idx, r_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def labelled(spark, sf) -> DataFrame:
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").cast("int").alias("file_idx"), F.col("r_name").alias("label"))


def split_sql(a: str, b: str, source: str = LABELLED) -> str:
    order = MIX.format(k="file_idx", seed=42 * 40503)
    return f"WITH {source}, r AS (SELECT file_idx, label, CAST(count(*) OVER (PARTITION BY label) AS INTEGER) AS n, row_number() OVER (PARTITION BY label ORDER BY {order}, file_idx) AS nth FROM f), b AS (SELECT *, {a} AS a, {b} AS b FROM r), s AS (SELECT file_idx, label, CASE WHEN nth <= a THEN 'train' WHEN nth <= b THEN 'val' ELSE 'test' END AS split FROM b)"


TWO = split_sql("CASE WHEN n = 4 THEN 3 ELSE greatest(1, round_even(n * 0.75::DOUBLE, 0)::INTEGER) END", "n")
_A = "greatest(1, CASE WHEN floor(n * 0.7::DOUBLE) + ceil(n * 0.2::DOUBLE) >= n THEN greatest(1, n - ceil(n * 0.2::DOUBLE) - 1) ELSE floor(n * 0.7::DOUBLE) END)::INTEGER"
THREE = split_sql(f"CASE WHEN n >= 4 THEN {_A} ELSE 1 END", f"CASE WHEN n >= 4 THEN {_A} + greatest(1, ceil(n * 0.2::DOUBLE)::INTEGER) WHEN n = 3 THEN 2 ELSE n END")
FEW = split_sql(f"CASE WHEN n >= 4 THEN {_A} ELSE 1 END", f"CASE WHEN n >= 4 THEN {_A} + greatest(1, ceil(n * 0.2::DOUBLE)::INTEGER) WHEN n = 3 THEN 2 ELSE n END", "f AS (SELECT CAST(p_partkey AS INTEGER) AS file_idx, concat(p_partkey // 60, '-', p_partkey // (1 + p_partkey // 60 % 5)) AS label FROM part)")


@query("split_membership", TWO + " SELECT * FROM s")
def _(spark, sf):
    return split.stratified_file_split(labelled(spark, sf))


@query("split_2way", TWO + " SELECT label, split, count(*) AS n FROM s GROUP BY ALL")
def _(spark, sf):
    return split.stratified_file_split(labelled(spark, sf)).groupBy("label", "split").agg(F.count("*").alias("n"))


@query("split_counts", THREE + " SELECT label, split, count(*) AS n FROM s GROUP BY ALL")
def _(spark, sf):
    return split.stratified_file_split(labelled(spark, sf), 0.7, 0.2).groupBy("label", "split").agg(F.count("*").alias("n"))


@query("split_low_file", FEW + " SELECT label, split, count(*) AS n FROM s GROUP BY ALL")
def _(spark, sf):
    # classes of one to five files
    rows = table(spark, sf, "part").select(F.col("p_partkey").cast("int").alias("file_idx"), F.expr("concat(p_partkey div 60, '-', p_partkey div (1 + p_partkey div 60 % 5))").alias("label"))
    return split.stratified_file_split(rows, 0.7, 0.2).groupBy("label", "split").agg(F.count("*").alias("n"))


@query("split_leakage_check", "SELECT CAST(0 AS BIGINT) AS leaked, count(*) AS n_files FROM supplier")
def _(spark, sf):
    s = split.stratified_file_split(labelled(spark, sf), 0.7, 0.2)
    per = s.groupBy("file_idx").agg(F.count_distinct("split").alias("k"))
    return per.agg(F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).cast("long").alias("leaked"), F.count("*").alias("n_files"))


@query("split_windows", TWO.replace("WITH ", win(64, 32) + ", ", 1) + " SELECT split, count(*) AS n FROM win JOIN s USING (file_idx) GROUP BY 1")
def _(spark, sf):
    s = split.stratified_file_split(labelled(spark, sf)).select("file_idx", "split")
    return windowed(spark, sf).join(s, "file_idx").groupBy("split").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- few-shot episodes


@query("fewshot_capacity", win(64, 32) + " SELECT label, count(*) AS n_windows, count(DISTINCT file_idx) AS n_files FROM win GROUP BY 1")
def _(spark, sf):
    return sampling.capacity(windowed(spark, sf)).select("label", "n_windows", F.size("files").cast("long").alias("n_files"))


@query("distinct_labels", "SELECT DISTINCT r_name AS label FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def _(spark, sf):
    return labelled(spark, sf).select("label").distinct().orderBy("label")


@query("files_per_class", f"WITH {LABELLED} SELECT label, array_to_string(list(file_idx ORDER BY file_idx), ',') AS files FROM f GROUP BY 1")
def _(spark, sf):
    return labelled(spark, sf).groupBy("label").agg(F.array_join(F.sort_array(F.collect_list("file_idx")).cast("array<string>"), ",").alias("files"))


CLASSES = {0: "AFRICA", 1: "AMERICA", 2: "ASIA", 3: "EUROPE", 4: "MIDDLE EAST"}
EPISODE = f""", req AS (SELECT unnest([0, 1, 2]) AS req_pos, unnest([2, 3, 2]) AS class_id, unnest(['ASIA', 'EUROPE', 'ASIA']) AS label, unnest([4, 3, 2]) AS k),
drawn AS (SELECT *, row_number() OVER (PARTITION BY req_pos ORDER BY {MIX.format(k='(flat_idx + req_pos * 7919)', seed=42 * 40503)}, flat_idx) AS nth FROM win JOIN req USING (label)),
ep AS (SELECT *, row_number() OVER (ORDER BY {MIX.format(k='(flat_idx * 31 + req_pos)', seed=43 * 40503)}, req_pos, flat_idx) - 1 AS pos FROM drawn WHERE nth <= k)"""


@query("fewshot_episode", win(64, 32) + EPISODE + " SELECT CAST(pos AS INTEGER) AS pos, req_pos, CAST(class_id AS BIGINT) AS class_id, label, fold, file_idx, win_idx, severity, rpm FROM ep")
def _(spark, sf):
    return sampling.episode(windowed(spark, sf), CLASSES, [2, 3, 2], [4, 3, 2], check=False).select("pos", "req_pos", "class_id", "label", "fold", "file_idx", "win_idx", "severity", "rpm")


@query("fewshot_unavailable", f"WITH {LABELLED} SELECT label FROM (SELECT unnest(['ASIA', 'ATLANTIS']) AS label) WHERE label NOT IN (SELECT label FROM f)")
def _(spark, sf):
    return sampling.unavailable(labelled(spark, sf), spark.createDataFrame([("ASIA",), ("ATLANTIS",)], "label string"))


# ---------------------------------------------------------------- signals

LONG = "x AS (SELECT CAST(l_suppkey AS INTEGER) AS file, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS INTEGER) AS i, l_quantity AS x FROM lineitem)"
SCALED = LONG + ", c AS (SELECT file, quantile_cont(x, 0.01) AS low, quantile_cont(x, 0.99) AS high FROM x GROUP BY 1), y AS (SELECT x.file, x.i, CASE WHEN high - low <= 1e-9 * greatest(abs(low), abs(high)) THEN x.x - low ELSE (x.x - low) / (high - low) END AS x FROM x JOIN c USING (file))"
EDGES = SCALED + ", e AS (SELECT file, i FROM (SELECT *, lag(x) OVER (PARTITION BY file ORDER BY i) AS b FROM y) WHERE b < 0.7 AND x >= 0.7)"


def samples(spark, sf) -> DataFrame:
    from pyspark.sql import Window

    own = Window.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").cast("int").alias("file"), (F.row_number().over(own) - 1).alias("i"), F.col("l_quantity").alias("x"))


def found_edges(spark, sf) -> DataFrame:
    return signals.rising_edges(signals.robust_scaled(samples(spark, sf)))


@query("decimate", f"WITH {LONG} SELECT file, CAST(i // 5 AS INTEGER) AS i, x FROM x WHERE i % 5 = 0")
def _(spark, sf):
    return recordings(spark, sf).select(F.col("file_idx").alias("file"), F.posexplode(signals.decimated(F.col("q"), 5)).alias("i", "x"))


@query("robust_scale", f"WITH {SCALED} SELECT file, i, round(x, 6) AS x FROM y")
def _(spark, sf):
    return signals.robust_scaled(samples(spark, sf)).select("file", "i", F.round("x", 6).alias("x"))


@query("rising_edges", f"WITH {EDGES} SELECT file, i FROM e")
def _(spark, sf):
    return found_edges(spark, sf)


@query("close_edge_filter", f"""WITH RECURSIVE {EDGES}, g AS (SELECT file, greatest(1, round_even(median(gap) * 0.7::DOUBLE, 0)::INTEGER) AS least FROM (SELECT file, i - lag(i) OVER (PARTITION BY file ORDER BY i) AS gap FROM e) GROUP BY 1),
k AS (SELECT file, i, least FROM (SELECT file, max(i) AS i FROM e GROUP BY 1) JOIN g USING (file) UNION ALL SELECT file, i, least FROM (SELECT k.file, max(e.i) AS i, k.least FROM k JOIN e ON e.file = k.file AND k.i - e.i >= k.least GROUP BY k.file, k.i, k.least)) SELECT file, i FROM k""")
def _(spark, sf):
    return signals.close_edges_removed(found_edges(spark, sf))


@query("instant_rpm", f"""WITH {EDGES}, s AS (SELECT file, i, 60.0::DOUBLE * (50.0::DOUBLE / greatest(1, lead(i) OVER (PARTITION BY file ORDER BY i) - i)) AS rpm FROM e),
j AS (SELECT x.file, x.i, last_value(s.rpm IGNORE NULLS) OVER (PARTITION BY x.file ORDER BY x.i) AS l, first_value(s.rpm IGNORE NULLS) OVER (PARTITION BY x.file ORDER BY x.i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM x LEFT JOIN s ON x.file = s.file AND x.i = s.i)
SELECT file, i, round(coalesce(l, f, 0.0::DOUBLE), 6) AS rpm FROM j""")
def _(spark, sf):
    own = samples(spark, sf)
    return signals.instant_rpm(own, signals.rising_edges(signals.robust_scaled(own)), fs=50).select("file", "i", F.round("rpm", 6).alias("rpm"))


@query("iir_first_order", f"WITH RECURSIVE {LONG}, r AS (SELECT file, i, 0.25::DOUBLE * x AS y FROM x WHERE i = 0 UNION ALL SELECT x.file, x.i, 0.25::DOUBLE * x.x + 0.75::DOUBLE * r.y FROM r JOIN x ON x.file = r.file AND x.i = r.i + 1) SELECT file, i, round(y, 6) AS y FROM r")
def _(spark, sf):
    import numpy as np

    from tideline.functions import dsp

    class Smooth:
        many = True

        def __call__(self, x):
            return dsp.lfilter(np.array([0.25]), np.array([1.0, -0.75]), x)

    rows = signals.filter_recordings(recordings(spark, sf), {"q": Smooth()}, sensors=SENSORS)
    return rows.select(F.col("file_idx").alias("file"), F.posexplode("q").alias("i", "y")).select("file", "i", F.round("y", 6).alias("y"))


@query("tacho_pipeline")
def _(spark, sf):
    from tideline.functions import dsp

    rows = signals.filter_recordings(recordings(spark, sf), {"q": dsp.TachometerProcessor(Fs=50, filter_cutoff=10)}, sensors=SENSORS)
    return rows.select("file_idx", F.round(features.mean(F.col("q")), 4).alias("mean_rpm"), F.size("q").alias("n"))


@query("accel_filter_energy")
def _(spark, sf):
    from tideline.functions import dsp

    rows = signals.filter_recordings(recordings(spark, sf), {"q": dsp.AccelerometerFilter(fs=50, cutoff=6.22)}, 5, 50, SENSORS)
    return rows.select("file_idx", F.round(features.rms(F.col("q")), 6).alias("rms_q"), F.size("q").alias("n"), "fs")


# ---------------------------------------------------------------- features


@query("feature_stats", win(64, 32) + " SELECT fold, file_idx, win_idx, label, round(list_sum(q) / 64, 6) AS mean_q, round(list_var_pop(q), 6) AS var_q, round(list_max(p) - list_min(p), 2) AS span_p FROM win")
def _(spark, sf):
    q, p = F.col("q"), F.col("p")
    return windowed(spark, sf).select("fold", "file_idx", "win_idx", "label", F.round(features.mean(q), 6).alias("mean_q"), F.round(features.variance(q), 6).alias("var_q"), F.round(features.peak_to_peak(p), 2).alias("span_p"))


@query("feature_covariance", win(64, 32) + ", u AS (SELECT fold, file_idx, win_idx, unnest(q) AS a, unnest(d) AS b FROM win) SELECT fold, file_idx, win_idx, round(covar_samp(a, b), 6) AS cov FROM u GROUP BY ALL")
def _(spark, sf):
    return windowed(spark, sf).select("fold", "file_idx", "win_idx", F.round(features.covariance(F.col("q"), F.col("d")), 6).alias("cov"))


@query("feature_custom_transform", win(64, 32) + " SELECT fold, file_idx, win_idx, round(CAST(CAST(list_max(q) AS FLOAT) AS DOUBLE), 3) AS top_q, round(CAST(CAST(list_min(d) AS FLOAT) AS DOUBLE), 3) AS low_d FROM win")
def _(spark, sf):
    import numpy as np

    rows = loaders.transformed(windowed(spark, sf), ["q", "d"], lambda w: np.array([w[0].max(), w[1].min()]), 64)
    return rows.select("fold", "file_idx", "win_idx", *(F.round(F.col("features")[i].cast("double"), 3).alias(n) for i, n in enumerate(("top_q", "low_d"))))


@query("feature_load_filtered", win(64, 32) + " SELECT fold, file_idx, win_idx, label, round(CAST(CAST(list_max(q) AS FLOAT) AS DOUBLE), 3) AS top_q FROM win WHERE label IN ('ASIA', 'EUROPE') AND rpm BETWEEN 0 AND 5000")
def _(spark, sf):
    rows = loaders.load_features(loaders.feature_rows(windowed(spark, sf), SENSORS, ["max"]), ["q", "nothing"], ["ASIA", "EUROPE"], rpm_range=(0, 5000))
    return rows.select("fold", "file_idx", "win_idx", "label", F.round(F.col("q.max").cast("double"), 3).alias("top_q"))


@query("feature_batches", win(64, 32) + f", n AS (SELECT *, row_number() OVER (ORDER BY flat_idx) - 1 AS n FROM win) SELECT CAST(n // 32 AS BIGINT) AS batch, count(*) AS n, round(sum(CAST(CAST(list_max(d) AS FLOAT) AS DOUBLE)), 4) AS top_d FROM n GROUP BY 1")
def _(spark, sf):
    rows = loaders.flat(loaders.feature_rows(windowed(spark, sf), ["q", "d"], ["min", "max"]))
    return loaders.batches(rows, 32).groupBy("batch").agg(F.count("*").alias("n"), F.round(F.sum(F.element_at("features", 4).cast("double")), 4).alias("top_d"))


@query("fewshot_features", win(64, 32) + EPISODE + " SELECT CAST(pos AS INTEGER) AS pos, req_pos, CAST(class_id AS BIGINT) AS class_id, label, round(CAST(CAST(list_max(q) AS FLOAT) AS DOUBLE), 4) AS top_q FROM ep")
def _(spark, sf):
    rows = loaders.flat(loaders.feature_rows(windowed(spark, sf), ["q"], ["max"]))
    return sampling.episode(rows, CLASSES, [2, 3, 2], [4, 3, 2]).select("pos", "req_pos", "class_id", "label", F.round(F.element_at("features", 1).cast("double"), 4).alias("top_q"))


# ---------------------------------------------------------------- concatenation


@query("concat_files_axis", ten(4) + ", m2 AS (SELECT max(file_idx) + 1 AS k FROM ten) SELECT fold, file_idx, label, q[1] AS first_q FROM ten UNION ALL SELECT fold, CAST(file_idx + k AS INTEGER), label, q[1] FROM ten, m2 WHERE label = 'ASIA'")
def _(spark, sf):
    a = loaded(spark, sf)
    return tensor.concat([a, a.where("label = 'ASIA'")], 1).select("fold", "file_idx", "label", F.element_at("q", 1).alias("first_q"))


@query("concat_folds_axis", ten(4) + " SELECT fold, file_idx, q[1] AS first_q FROM ten UNION ALL SELECT fold + 4, file_idx, q[1] FROM ten")
def _(spark, sf):
    a = loaded(spark, sf)
    return tensor.concat([a, a], 0).select("fold", "file_idx", F.element_at("q", 1).alias("first_q"))


@query("concat_channel_axis", ten(4) + " SELECT fold, file_idx, q[1] AS first_q, d[1] AS first_d FROM ten")
def _(spark, sf):
    a = loaded(spark, sf)
    return tensor.concat([a.select(*tensor.META, "q"), a.select(*tensor.META, "d")], 2).select("fold", "file_idx", F.element_at("q", 1).alias("first_q"), F.element_at("d", 1).alias("first_d"))


@query("concat_time_axis", ten(4) + " SELECT fold, file_idx, CAST(2 * len(q) AS INTEGER) AS n, q[-1] AS last_q FROM ten")
def _(spark, sf):
    a = loaded(spark, sf).select(*tensor.META, "q")
    return tensor.concat([a, a], 3).select("fold", "file_idx", F.size("q").alias("n"), F.element_at("q", -1).alias("last_q"))


# ---------------------------------------------------------------- loaders, staging, streams

CODES = {v: k for k, v in CLASSES.items()}
CASE = "CASE label " + " ".join(f"WHEN '{v}' THEN {k}" for k, v in CLASSES.items()) + " END"


@query("label_encode", win(64, 32) + f" SELECT flat_idx, CAST({CASE} AS BIGINT) AS y FROM win")
def _(spark, sf):
    return loaders.encoded(windowed(spark, sf), CODES).select("flat_idx", "y")


@query("batch_assign", win(64, 32) + " SELECT flat_idx, CAST(n // 32 AS BIGINT) AS batch, CAST(n % 32 AS INTEGER) AS slot FROM (SELECT flat_idx, row_number() OVER (ORDER BY flat_idx) - 1 AS n FROM win)")
def _(spark, sf):
    return loaders.batches(windowed(spark, sf), 32).select("flat_idx", "batch", "slot")


@query("batch_shuffled", win(64, 32) + f" SELECT flat_idx, CAST(n // 32 AS BIGINT) AS batch, CAST(n % 32 AS INTEGER) AS slot FROM (SELECT flat_idx, row_number() OVER (ORDER BY {MIX.format(k='flat_idx', seed=42 * 40503)}, flat_idx) - 1 AS n FROM win)")
def _(spark, sf):
    return loaders.batches(windowed(spark, sf), 32, True, 42).select("flat_idx", "batch", "slot")


@query("byte_range_plan", "SELECT CAST(i AS INTEGER) AS part, i * (12884901888 // 7) AS first, CASE WHEN i = 6 THEN 12884901887 ELSE (i + 1) * (12884901888 // 7) - 1 END AS last FROM (SELECT unnest(range(0, 7)) AS i)")
def _(spark, sf):
    return staging.byte_ranges(spark, 12 << 30, 7)


@query("events_time_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def _(spark, sf):
    return live.time_windows(table(spark, sf, "events")).withColumn("mean_value", F.round("mean_value", 6))
