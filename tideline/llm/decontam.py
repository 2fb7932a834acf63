"""Benchmark decontamination by winnowing, in DataFrame functions only.

Words are runs of 0-9, a-z and non-ASCII characters after A-Z are lowered. A window is `span` consecutive words of a
benchmark item; an item of fewer words is one window. For each length L that windows have, texts are winnowed with
k-grams of k = min(5, L) words: of each L - k + 1 successive k-gram hashes the least is kept, with its place. Both sides
keep the same hash of any shared run of L words, so every shared window shares a fingerprint. Texts are cut in words once:
one scan gives their numbers of words and the fingerprints that the benchmark has too. Each such hit is extended to the
left and right, as far as the windows that have its fingerprint reach, and compared with them word by word.
Fingerprints of the benchmark are broadcast if they are few, else shuffled; so is the list of documents with hits.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import few, keyed, real_id, written

#: Fixed value: what separates words, after lowering; and before.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Benchmark windows (about 200 bytes each) up to which they are broadcast.
FEW_WINDOWS = 100_000
#: Bits of a fingerprint that carry the place, modulo; far wider than a window.
PLACE = 16
LOW = (1 << PLACE) - 1


def words(text: Column) -> Column:
    lowered = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.filter(F.split(lowered, GAP), lambda w: w != "")


def grams(hashes: str, size: int, k: int):
    """The hash of the k words from place i on, in windows of size words; its low bits are free."""
    return lambda i: F.xxhash64(F.lit(size), *(F.get(hashes, i + j) for j in range(k))).bitwiseAND(F.lit(~LOW))


def winnowed(df: DataFrame, lengths: list[int]) -> tuple[DataFrame, list[str]]:
    """df (with the column words) and for each length a column of the packed least k-gram hashes: hash bits, and the place modulo 2**PLACE.

    Runs at the end of a text are cut short and may add hashes; none is ever missed."""
    df = df.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    for size in lengths:
        k = min(5, size)
        gram = grams("h", size, k)
        packed = lambda i: gram(i).bitwiseOR(i.cast("long").bitwiseAND(F.lit(LOW)))  # noqa: B023, E731
        df = df.withColumn(f"m{size}", F.when(F.size("h") >= size, F.transform(F.sequence(F.lit(0), F.size("h") - k), packed)).otherwise(F.array().cast("array<bigint>")))
        have, want = 1, size - k + 1
        while have < want:
            step = min(have, want - have)
            df = df.withColumn(f"m{size}", F.zip_with(f"m{size}", F.slice(f"m{size}", step + 1, F.size("h")), lambda a, b: F.least(a, b)))
            have += step
    return df, [f"m{size}" for size in lengths]


def seeds(df: DataFrame, lengths: list[int], *keep: str) -> DataFrame:
    """keep and s: structs of fp and pos (a word's place) of all fingerprints, each once; the first, of every text, has pos -1 and no fp."""
    df, names = winnowed(df, lengths)

    def placed(name: str):
        def one(x, i):
            pos = i + F.pmod(x.bitwiseAND(F.lit(LOW)) - i, F.lit(LOW + 1))
            return F.when((i == 0) | (x != F.get(name, i - 1)), F.struct(x.bitwiseAND(F.lit(~LOW)).alias("fp"), pos.cast("int").alias("pos")))

        return F.filter(F.transform(name, one), lambda s: s.isNotNull())

    none = F.array(F.struct(F.lit(None).cast("long").alias("fp"), F.lit(-1).alias("pos")))
    return df.select(*keep, F.concat(none, *map(placed, names)).alias("s"))


def of_windows(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """fp, off, size, h and window: each window's least fingerprint at all offsets that have it, as a text may keep any of equal ones."""
    parts = []
    for size in lengths:
        k = min(5, size)
        own = windows.where(F.size("window") == size).withColumn("g", F.transform("window", lambda w: F.xxhash64(w)))
        own = own.withColumn("g", F.transform(F.sequence(F.lit(0), F.lit(size - k)), grams("g", size, k)))
        at = F.filter(F.transform("g", lambda x, i: F.when(x == F.array_min("g"), F.struct(x.alias("fp"), i.alias("off")))), lambda s: s.isNotNull())
        parts.append(own.select(F.explode_outer(at).alias("s"), F.lit(size).alias("size"), "h", "window").select("s.fp", "s.off", "size", "h", "window"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10) -> DataFrame:
    """For each row of docs: id, crc, n_words, hits (sorted structs pos, size of occurring windows), n_hit (words inside
    them) and items (sorted item_ids, as strings, with occurring windows).

    Null and empty texts have no words and no hits; an item without words has no window; an item without id counts as the
    item of the empty string. An empty benchmark hits nothing. Rows that repeat get equal results."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words(F.coalesce("text", F.lit(""))).alias("words")).where(F.size("words") > 0)
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - span + 1, F.lit(1))), lambda i: F.slice("words", i, span))
    spans = written(items.select("item", F.explode(each).alias("window")).distinct().withColumn("h", F.xxhash64("window")), "spans")
    lengths = sorted(r[0] for r in spans.select(F.size("window")).distinct().collect())  # span numbers at most
    rows = keyed(docs)
    cut = rows.select("id", "crc", words(F.col("text")).alias("words"))
    if not lengths:
        return cut.select("id", "crc", F.size("words").cast("long").alias("n_words"), F.lit(None).cast("array<struct<pos:int,size:int>>").alias("hits"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    prints = written(of_windows(spans.select("window", "h").distinct(), lengths), "prints")
    n_prints = prints.count()
    near = (lambda df: F.broadcast(df)) if n_prints <= FEW_WINDOWS else (lambda df: df)
    # the one scan of all texts: a row for each, and one for each hit. explode_outer: of explode the optimizer infers a
    # filter and pushes it, with all of this inlined, below the projections
    own = seeds(cut, lengths, "id", "crc", "words").select("id", "crc", F.size("words").cast("long").alias("n_words"), "s")
    own = own.select("id", "crc", "n_words", F.explode_outer("s").alias("s")).select("id", "crc", "n_words", "s.fp", "s.pos")
    known = near(prints.select("fp").distinct().withColumn("hit", F.lit(True)))
    scan = written(own.join(known, "fp", "left").where(F.col("hit") | (F.col("pos") < 0)).select("id", "crc", "n_words", "fp", "pos"), "scan")
    counted = scan.where("pos < 0").select("id", "crc", "n_words")
    places = scan.where("pos >= 0").groupBy("id", "crc").agg(F.sort_array(F.collect_set(F.struct("pos", "fp"))).alias("places"))
    ids = written(places.select("id", "crc"), "ids")
    # the words around each hit, as far as a window with its fingerprint can reach
    lead = max(n - min(5, n) for n in lengths)
    around = lambda p: F.struct(p["fp"].alias("fp"), p["pos"].alias("pos"), F.greatest(p["pos"] - lead, F.lit(0)).alias("first"), F.slice("words", F.greatest(p["pos"] - lead, F.lit(0)) + 1, lead + span).alias("near"))
    again = cut.join(few(ids), ["id", "crc"], "left_semi").join(places, ["id", "crc"]).select("id", "crc", F.explode_outer(F.transform("places", around)).alias("c")).select("id", "crc", "c.*")
    begin = F.col("pos") - F.col("off")
    extended = again.join(near(prints), "fp").where((begin >= 0) & (F.slice("near", F.greatest(begin - F.col("first"), F.lit(0)) + 1, F.col("size")) == F.col("window")))
    found = written(extended.select("id", "crc", (begin + 1).alias("pos"), "size", "h", "window").distinct(), "found")
    hits = found.groupBy("id", "crc").agg(F.sort_array(F.collect_set(F.struct("pos", "size"))).alias("hits"))
    of = found.select("id", "crc", "h", "window").distinct().join(near(spans), ["h", "window"]).groupBy("id", "crc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = hits.join(of, ["id", "crc"])
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), h["pos"] + h["size"] - F.greatest(a["to"], h["pos"]))).cast("long").alias("n"), F.greatest(a["to"], h["pos"] + h["size"]).alias("to"))
    hits = hits.withColumn("n_hit", F.aggregate("hits", start, step, lambda a: a["n"]))
    return counted.join(hits, ["id", "crc"], "left").select("id", "crc", "n_words", "hits", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """op1: one row for each document."""
    return contamination(docs, benchmark).select(
        real_id(), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


#: DuckDB's statement of op1, from the definition: every window of every item against every place of every document.
ORACLE = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, least(len(w), 10) AS size, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 9), ' '))) AS win FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM bw),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS pos FROM d, sizes WHERE len(w) >= size),
q AS (SELECT doc_id, size, pos, array_to_string(list_slice(w, pos, pos + size - 1), ' ') AS win FROM p),
f AS (SELECT q.doc_id, q.pos, q.size, bw.item FROM q JOIN bw ON q.win = bw.win AND q.size = bw.size),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) AS x FROM f) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
