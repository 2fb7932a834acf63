"""Quality rules: base counts of each text, and robust multivariate outliers, in DataFrame functions only.

Each text becomes a vector of transformed statistics. For each language and source, each language, and all rows a minimum
covariance determinant is sought: three starts (medians with absolute deviations; means with covariances; medians with
the correlations of squashed deviations) take two concentration steps each, in which the rows of the least distances
(`subset` of the group) give the next mean and covariance. The start of the least determinant goes on until no step
lowers it further. A group's estimate is then pooled with PRIOR rows' worth of its language's, and that with PRIOR rows'
worth of the one of all: a rule that has no threshold of size, by which a source of few rows follows its language.

Distances are squared Mahalanobis distances by a Cholesky factor that is computed in columns, a row for each group;
nothing of a group's rows comes to the driver or to one task. Quantiles are exact over values rounded to a thousandth, so
that their partial counts stay bounded and do not depend on the order of rows. A floor of variance for each statistic
keeps groups of copies from collapsing to a point.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernel import discard, few, keyed, real_id, whole_row, written

SPACES = r"[\x20\x09-\x0D]+"
#: Names of the vector's statistics and the least standard deviation taken for each.
FLOORS = {"length": 0.12, "symbols": 0.05, "lines": 0.2, "repeats": 0.15, "capitals": 0.06, "marks": 0.06}
NAMES = list(FLOORS)
D = len(NAMES)
#: Rows that the estimate of the wider group counts for.
PRIOR = 50
#: Groups up to which their estimates (of about 400 bytes) are broadcast.
BROADCAST_GROUPS = 50_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_capitals", "n_marks"]


def word_list(text: Column | str) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def statistics(docs: DataFrame, carry: bool = False, hash_bits: int = 64) -> DataFrame:
    """id, crc, lang, source, COUNTS and n_repeat_words of each row, and unsure; with carry also row, all its columns.

    Null text: empty, all counts 0. Repeated windows are found by sorted 64-bit hashes of three words whose low bits carry
    the place; neighbours of equal hashes are compared by their words. unsure: some of them differ, so that equal windows
    may not be neighbours; repeated_words() counts such rows. hash_bits: fewer, for tests."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))
    keep = ["id", "crc", "lang", "source", *(["row"] if carry else [])]
    rows = keyed(docs, lang, source, *([whole_row(docs)] if carry else []))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rest = F.regexp_replace("text", r"[^#*$%&|<>!?=_~^+{}\[\]\\/@\p{Lu}]+", "")
    rows = rows.select(*keep, word_list("text").alias("words"), lines.alias("lines"), rest.alias("rest"))
    bits = F.greatest(F.length(F.bin(F.size("words").cast("long"))), F.lit(64 - hash_bits))
    made = {
        "n_words": F.size("words"), "word_chars": F.char_length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("rest", F.lit(r"[#*$%&|<>]")), "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")), "n_lines": F.size("lines"),
        "n_capitals": F.regexp_count("rest", F.lit(r"\p{Lu}")), "n_marks": F.regexp_count("rest", F.lit(r"[!?=_~^+{}\[\]\\/@]")),
    }
    keep += COUNTS
    rows = rows.withColumns({n: c.cast("long") for n, c in made.items()} | {"bits": bits})
    low = F.expr("~shiftleft(-1L, bits)")

    def window(i: Column) -> Column:
        h = F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2))
        return F.expr("shiftleft(-1L, bits)").bitwiseAND(h).bitwiseOR(i.cast("long"))

    def equal(a: Column, b: Column) -> Column:
        p, q = a.bitwiseAND(low).cast("int"), b.bitwiseAND(low).cast("int")
        same = [F.get("words", p + j) == F.get("words", q + j) for j in range(3)]
        return same[0] & same[1] & same[2]

    windows = F.transform(F.sequence(F.lit(0), F.size("words") - 3), window)
    windows = F.when(F.size("words") >= 3, F.sort_array(windows)).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(*keep, "words", "bits", windows.alias("s"))
    # for neighbours with equal hashes: both if their words are equal too, else an empty array
    twins = F.zip_with("s", F.slice("s", 2, F.size("s")), lambda a, b: F.when(a.bitwiseXOR(b).between(0, low), F.when(equal(a, b), F.array(a, b)).otherwise(F.array().cast("array<bigint>"))))
    rows = rows.select(*keep, "bits", F.filter(twins, lambda x: x.isNotNull()).alias("twins"))
    place = F.sort_array(F.transform(F.array_distinct(F.flatten("twins")), lambda x: low.bitwiseAND(x)))
    rows = rows.select(*keep, F.exists("twins", lambda x: F.size(x) == 0).alias("unsure"), place.alias("p"))
    three = F.lit(3).cast("long")
    cover = F.aggregate(F.transform("p", lambda x, i: F.least(three, F.coalesce(F.get("p", i + 1) - x, three))), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select(*keep, cover.alias("n_repeat_words"), "unsure")


def repeated_words(docs: DataFrame, which: DataFrame) -> DataFrame:
    """id, crc and n_repeat_words of the rows of docs that `which` (id, crc) names, by grouping of the windows' words: exact at any length."""
    rows = keyed(docs).join(few(which.distinct()), ["id", "crc"], "left_semi").dropDuplicates(["id", "crc"]).select("id", "crc", word_list("text").alias("w"))
    at = F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.struct(i.alias("p"), F.get("w", i).alias("a"), F.get("w", i + 1).alias("b"), F.get("w", i + 2).alias("c")))
    windows = rows.where(F.size("w") >= 3).select("id", "crc", F.explode(at).alias("x")).select("id", "crc", "x.*")
    many = windows.groupBy("id", "crc", "a", "b", "c").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    inside = windows.join(many, ["id", "crc", "a", "b", "c"], "left_semi").select("id", "crc", F.explode(F.sequence(F.col("p"), F.col("p") + 2)).alias("p")).distinct()
    return rows.select("id", "crc").join(inside.groupBy("id", "crc").agg(F.count("*").alias("n")), ["id", "crc"], "left").select("id", "crc", F.coalesce("n", F.lit(0)).cast("long").alias("n_repeat_words"))


def vector() -> list[Column]:
    """The transformed statistics: the logarithm of the mean word length, and angles of shares."""
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(a) / F.greatest(F.col(b), F.lit(1)))))
    length = F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1)))
    shares = [("n_symbols", "word_chars"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_capitals", "word_chars"), ("n_marks", "word_chars")]
    return [c.alias(n) for c, n in zip([length, *(share(*x) for x in shares)], NAMES)]


def chi2_cdf(x: float, d: int) -> float:
    """Of the chi-square distribution, by the series of the incomplete gamma function."""
    a, x = d / 2, x / 2
    if x <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-16:
        k += 1
        term *= x / k
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, d) < p else (low, mid)
    return (low + high) / 2


PAIRS = [(i, j) for i in range(D) for j in range(i + 1)]
MU, C, W = [f"mu_{n}" for n in NAMES], [f"c_{i}_{j}" for i, j in PAIRS], [f"w_{i}_{j}" for i, j in PAIRS]


def distance() -> Column:
    """The squared distance of a row from its group's center mu_, by the inverse factor w_i_j. (SQL text: one call instead of a hundred.)"""
    y = [" + ".join(f"w_{i}_{j} * ({NAMES[j]} - {MU[j]})" for j in range(i + 1)) for i in range(D)]
    return F.expr(" + ".join(f"({x}) * ({x})" for x in y))


def factored(stats: DataFrame) -> DataFrame:
    """Adds w_i_j, the inverse of the Cholesky factor l_i_j of the covariances c_i_j with the floors' variances added, and
    det, the logarithm of their determinant. One select, in which later columns read earlier ones."""
    made = []
    for j in range(D):
        floor = FLOORS[NAMES[j]] ** 2
        for i in range(j, D):
            rest = f"c_{i}_{j}" + (f" + {floor}D" if i == j else "") + "".join(f" - l_{i}_{k} * l_{j}_{k}" for k in range(j))
            made.append(f"sqrt(greatest({rest}, {floor * 1e-3}D)) AS l_{j}_{j}" if i == j else f"({rest}) / l_{j}_{j} AS l_{i}_{j}")
    for i in range(D):
        for j in range(i, -1, -1):
            inner = " + ".join(f"l_{i}_{k} * w_{k}_{j}" for k in range(j, i))
            made.append(f"1 / l_{i}_{i} AS w_{i}_{i}" if i == j else f"-({inner}) / l_{i}_{i} AS w_{i}_{j}")
    det = f"2 * ({' + '.join(f'ln(l_{i}_{i})' for i in range(D))}) AS det"
    return stats.selectExpr(*stats.columns, *made, det).select(*stats.columns, *W, "det")


def group_key(level: int, *names: str) -> Column:
    """One string for a level's group; lengths keep names apart."""
    return F.concat(F.lit(str(level)), *(F.concat(F.lit("|"), F.length(n).cast("string"), F.lit("|"), F.col(n)) for n in names))


def moments(rows: DataFrame, by: list[str], scale: float) -> DataFrame:
    """Means and scaled covariances by group."""
    made = [f"avg({n}) AS {m}" for n, m in zip(NAMES, MU)] + [f"covar_pop({NAMES[i]}, {NAMES[j]}) * {scale}D AS c_{i}_{j}" for i, j in PAIRS]
    return rows.groupBy(*by).agg(*map(F.expr, made))


def concentrated(members: DataFrame, near, subset: float) -> tuple[DataFrame, int]:
    """By group g of members the estimate (MU, C, W, det) of least determinant, and the number of steps that it took."""
    scale = subset / chi2_cdf(chi2_quantile(subset, D), D + 2)

    def step(stats: DataFrame) -> DataFrame:
        far = members.join(near(stats.select("g", "s", *MU, *W)), "g").select("g", "s", *NAMES, F.round(F.log1p(distance()), 3).alias("far"))
        edge = far.groupBy("g", "s").agg(F.percentile("far", F.lit(subset)).alias("edge"))
        inside = far.join(near(edge), ["g", "s"]).where("far <= edge")
        return factored(moments(inside, ["g", "s"], scale))

    mid = "percentile(round({}, 3), 0.5)".format
    center = written(members.groupBy("g").agg(*(F.expr(f"{mid(n)} AS m_{n}") for n in NAMES)), "center")
    mad = members.join(near(center), "g").groupBy("g").agg(*(F.expr(f"pow(1.4826 * {mid(f'abs({n} - m_{n})')}, 2) AS v_{n}") for n in NAMES))
    center = written(center.join(mad, "g"), "spread")
    squashed = members.join(near(center), "g").selectExpr("g", *(f"tanh(({n} - m_{n}) / greatest(sqrt(v_{n}), {FLOORS[n]}D)) AS {n}" for n in NAMES))
    alike = "covar_pop({0}, {1}) / greatest(stddev_pop({0}) * stddev_pop({1}), 1e-9D)".format
    alike = squashed.groupBy("g").agg(*(F.expr(f"{alike(NAMES[i], NAMES[j])} AS r_{i}_{j}") for i, j in PAIRS if i != j))
    middle = [f"m_{n} AS {m}" for n, m in zip(NAMES, MU)]
    own = lambda off: [f"{f'v_{NAMES[i]}' if i == j else off(i, j)} AS c_{i}_{j}" for i, j in PAIRS]
    plain = center.selectExpr("g", "0 AS s", *middle, *own(lambda i, j: "0D"))
    classic = moments(members, ["g"], 1.0).selectExpr("g", "1 AS s", *MU, *C)
    bent = center.join(alike, "g").selectExpr("g", "2 AS s", *middle, *own(lambda i, j: f"r_{i}_{j} * sqrt(v_{NAMES[i]} * v_{NAMES[j]})"))
    stats = written(factored(plain.unionByName(classic).unionByName(bent)), "starts")
    for _ in range(2):
        before, stats = stats, written(step(stats), "step")
        discard(before)
    best = stats.groupBy("g").agg(F.min(F.struct("det", "s", *MU, *C, *W)).alias("x")).select("g", "x.*", F.lit(True).alias("moved"))
    best, taken = written(best, "best"), 2
    discard(stats)
    while best.where("moved").limit(1).count():  # each round lowers a determinant by a hundredth, and the floors bound it from below
        new = step(best.where("moved")).select("g", F.struct(*best.columns[1:-1]).alias("new"))
        lower = F.coalesce(F.col("new.det") < F.col("old.det") - 0.01, F.lit(False))
        both = best.select("g", F.struct(*best.columns[1:-1]).alias("old")).join(near(new), "g", "left")
        before, best = best, written(both.select("g", F.when(lower, F.col("new")).otherwise(F.col("old")).alias("x"), lower.alias("moved")).select("g", "x.*", "moved"), "best")
        discard(before)
        taken += 1
    return best, taken


def pooled(own: DataFrame, wide: DataFrame, on: list[str], near, prior: float) -> DataFrame:
    """own (n, MU, C) with PRIOR rows of the wider group's center and covariance added to its n rows."""
    other = wide.selectExpr(*on, *(f"{c} AS o_{c}" for c in (*MU, *C)))
    both = own.join(near(other), on) if on else own.crossJoin(F.broadcast(other))  # one row: the estimate of all
    both = both.withColumn("_s", F.expr(f"n / (n + {float(prior)}D)"))
    blend = "_s * {0} + (1 - _s) * o_{0}".format
    keep = [c for c in own.columns if c not in (*MU, *C)]
    apart = lambda i, j: f"_s * (1 - _s) * ({MU[i]} - o_{MU[i]}) * ({MU[j]} - o_{MU[j]})"
    return both.selectExpr(*keep, *(f"{blend(m)} AS {m}" for m in MU), *(f"{blend(f'c_{i}_{j}')} + {apart(i, j)} AS c_{i}_{j}" for i, j in PAIRS))


def outliers(rows: DataFrame, slim: DataFrame, subset: float = 0.75, prior: float = PRIOR) -> DataFrame:
    """Adds d2, the squared robust distance, to rows. slim: a materialised table of lang, source and the vectors that make up the estimates."""
    sizes = written(slim.groupBy("lang", "source").agg(F.count("*").alias("n")), "groups")
    n_groups = sizes.count()
    near = (lambda df: F.broadcast(df)) if n_groups <= BROADCAST_GROUPS else (lambda df: df)
    levels = [group_key(0), group_key(1, "lang"), group_key(2, "lang", "source")]
    best, _ = concentrated(slim.select(F.explode(F.array(*levels)).alias("g"), *NAMES), near, subset)
    best = best.select("g", *MU, *C)
    by_all = best.join(sizes.agg(F.sum("n").alias("n")).withColumn("g", group_key(0)), "g")
    by_lang = sizes.groupBy("lang").agg(F.sum("n").alias("n")).withColumn("g", group_key(1, "lang")).join(near(best), "g").drop("g")
    by_source = sizes.withColumn("g", group_key(2, "lang", "source")).join(near(best), "g").drop("g")
    by_lang = pooled(by_lang, by_all, [], near, prior)
    final = written(factored(pooled(by_source, by_lang, ["lang"], near, prior)).select("lang", "source", *MU, *W), "estimates")
    return rows.join(near(final), ["lang", "source"]).withColumn("d2", distance()).select(*rows.columns, "d2")


def judged(docs: DataFrame, least_words: int = 50, most_repeats: int = 50, tail: float = 1e-6, carry: bool = False, hash_bits: int = 64) -> DataFrame:
    """For each row of docs: the statistics, base_failed, d2 and kept; with carry also row, all its columns as a struct.

    base_failed: fewer than least_words words, or over most_repeats percent of them in repeated windows; such rows take no
    part in the estimates and have no d2. Other rows are kept if d2 is within the chi-square quantile of 1 - tail. Null
    languages and sources are groups of their own; rows that repeat count each; an empty table gives an empty result."""
    made = written(statistics(docs, carry, hash_bits), "counts")
    unsure = made.where("unsure").select("id", "crc")
    if not unsure.isEmpty():
        exact = written(repeated_words(docs, unsure).select("id", "crc", F.col("n_repeat_words").alias("exact")), "exact")
        made = made.join(few(exact), ["id", "crc"], "left").withColumn("n_repeat_words", F.coalesce("exact", "n_repeat_words")).drop("exact")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))
    base = made.drop("unsure").withColumn("base_failed", failed).select("*", *vector())
    # the estimates read this slim table again and again
    slim = written(base.where("not base_failed").select("lang", "source", *NAMES), "vectors")
    limit = chi2_quantile(1 - tail, D)
    good = outliers(base.where("not base_failed"), slim).withColumn("kept", F.col("d2") <= limit)
    return good.unionByName(base.where("base_failed").select("*", F.lit(None).cast("double").alias("d2"), F.lit(False).alias("kept")))


def query(docs: DataFrame) -> DataFrame:
    """op9: one row for each document."""
    return judged(docs).select(real_id(), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
