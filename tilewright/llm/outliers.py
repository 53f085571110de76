"""Quality rules: text statistics, fixed limits, and robust multivariate outliers per language and source.

Everything is DataFrame expressions; no Python runs on the rows. A document's statistics become a vector (``TRANSFORMED``).
Per cell (language and source) the minimum-covariance-determinant estimate is found by concentration: start from medians and quartile
ranges, then repeat: take the share ``SHARE`` of the cell's vectors that lie nearest by Mahalanobis distance, estimate mean
and covariance from them. A step never raises the determinant but for the width of a bin; steps end when none falls by ``SETTLED``.
Distances are counted in bins, with the bin's moments, so that a cell of any size comes down to a bounded number of rows
by partial aggregation; the nearest share ends with a bin. A vector is rejected beyond ``CUTOFF`` times the cell's ratio of
the median squared distance to that of a normal sample, where the ratio is above 1.

Cells of fewer than ``LEAST`` vectors are pooled per language, pools that are still smaller into one; if that is smaller, too, nothing is
rejected in it. Null languages and sources are values of their own. Documents that fail the fixed limits aren't vectors. Null texts have no words and
fail. Rows with equal or null ids are judged each by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
LEAST, SHARE, STEPS, SETTLED = 100, 0.75, 12, 1e-2
NORMAL_MEDIAN = 4.351  # of the squared distance in five dimensions
CUTOFF = 25.74  # its 0.9999 quantile
# transformed statistic, and the least standard deviation that an estimate may have: below it, a cell says nothing of what is odd
TRANSFORMED = {
    "log(n_words)": 0.25,
    "log(word_chars / n_words)": 0.05,
    "sqrt(n_symbols / word_chars)": 0.05,
    "sqrt(n_dup_lines / n_lines)": 0.2,
    "sqrt(n_repeat_words / n_words)": 0.2,
}
D = range(len(TRANSFORMED))
PAIRS = [(i, j) for i in D for j in D if j <= i]
FLOOR = list(TRANSFORMED.values())
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every text, a row per row of ``docs``.

    A window's words are hashed to 64 bits. The steps are columns of their own, since a lambda that looks up an
    array would otherwise compute it for every element.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", "lang", "source", text.alias("text"))
    blanks = F.translate("text", SPACES, " " * len(SPACES))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    rows = rows.select(
        "doc_id", "lang", "source", F.array_remove(F.split(blanks, " "), "").alias("words"), lines.alias("lines"),
        F.length(F.translate("text", SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"))
    rows = rows.withColumns({
        "n_words": F.size("words").cast("bigint"), "n_lines": F.size("lines").cast("bigint"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"), "codes": F.transform("words", lambda x: F.xxhash64(x))}).drop("words", "lines")
    for reach in (1, 2, 4):  # hashes of 2, 4 and 8 words
        rows = rows.withColumn("codes", F.expr(f"zip_with(codes, slice(codes, {reach + 1}, size(codes)), (a, b) -> xxhash64(a, b))"))
    rows = rows.withColumn("codes", F.expr("slice(codes, 1, greatest(CAST(n_words AS int) - 7, 0))"))
    rows = rows.withColumn("codes", F.when(F.size(F.array_distinct("codes")) < F.size("codes"), F.expr("array_sort(transform(codes, (x, i) -> struct(x AS code, i AS place)))")))
    twice = F.expr("transform(codes, (x, i) -> IF(x.code = get(codes, i - 1).code OR x.code = get(codes, i + 1).code, x.place, -1))")
    rows = rows.withColumn("places", F.array_sort(F.filter(twice, lambda x: x >= 0))).drop("codes")
    covered = F.expr("aggregate(zip_with(places, slice(places, 2, size(places)), (a, b) -> IF(b IS NULL, 8, least(8, b - a))), 0, (s, x) -> s + x)")
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("places")


def failed() -> Column:
    """The fixed limits: fewer than 20 words, or more than 30 % of them in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def _name(column: str) -> list[Column]:
    return [F.col(column).isNull(), F.coalesce(F.col(column).cast("string"), F.lit(""))]


def cells(rows: DataFrame, least: int) -> DataFrame:
    """The fitting cell of every pair of language and source (``own``): itself, its language's small ones, or all small ones."""
    own = rows.groupBy("own").agg(F.first("lang").alias("lang"), F.count(F.lit(1)).alias("n"))
    small = own.where(F.col("n") < least).withColumn("pool", F.xxhash64(F.lit(1), *_name("lang")))
    pools = small.groupBy("pool").agg(F.sum("n").alias("pooled"))
    pooled = small.join(pools, "pool").select("own", F.when(F.col("pooled") >= least, F.col("pool")).otherwise(F.lit(0)).alias("cell"))
    return own.where(F.col("n") >= least).select("own", F.col("own").alias("cell")).unionByName(pooled)


def _quantile(bins: DataFrame, keys: list[str], share: float, name: str) -> DataFrame:
    """The smallest bin up to which ``share`` of the rows ``n`` of each key lie."""
    whole = Window.partitionBy(*keys)
    counted = bins.withColumns({"_upto": F.sum("n").over(whole.orderBy("bin")), "_all": F.sum("n").over(whole)})
    return counted.where(F.col("_upto") >= F.ceil(share * F.col("_all"))).groupBy(*keys).agg(F.min("bin").alias(name))


def _start(rows: DataFrame) -> DataFrame:
    """Mean and whitening matrix of each cell from medians and quartile ranges, to a bin of 1/64 of a vector's units."""
    each = rows.select("cell", F.posexplode(F.array(*[f"z{i}" for i in D])).alias("at", "z"))
    bins = materialise(each.groupBy("cell", "at", F.floor(F.col("z") * 64).alias("bin")).agg(F.count(F.lit(1)).alias("n")), "bins")
    cuts = bins.select("cell", "at").distinct()
    for share, name in ((0.25, "low"), (0.5, "mid"), (0.75, "high")):
        cuts = cuts.join(_quantile(bins, ["cell", "at"], share, name), ["cell", "at"])
    floor = F.element_at(F.array(*map(F.lit, FLOOR)), F.col("at") + 1)
    scale = F.greatest((F.col("high") - F.col("low")) / 64 / 1.349, floor)
    cuts = cuts.select("cell", "at", ((F.col("mid") + 0.5) / 64).alias("m"), scale.alias("s"))
    picked = [F.max(F.when(F.col("at") == i, F.col(c))).alias(f"{c}{i}") for i in D for c in "ms"]
    wide = cuts.groupBy("cell").agg(*picked)
    whitening = [(1 / F.col(f"s{i}") if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i, j in PAIRS]
    return wide.select("cell", *[f"m{i}" for i in D], *whitening, F.lit(float("inf")).alias("det"))


def _distance() -> Column:
    """Squared Mahalanobis distance of a vector joined with its cell's estimate."""
    along = [sum((F.col(f"w{i}{j}") * (F.col(f"z{j}") - F.col(f"m{j}")) for j in range(1, i + 1)), F.col(f"w{i}0") * (F.col("z0") - F.col("m0"))) for i in D]
    return sum((x * x for x in along[1:]), along[0] * along[0])


def _concentrate(near: DataFrame, old: DataFrame) -> DataFrame:
    """One step: the estimate from the nearest share of every cell."""
    moved = [(F.col(f"z{i}") - F.col(f"m{i}")) for i in D]
    sums = [F.sum(moved[i]).alias(f"a{i}") for i in D] + [F.sum(moved[i] * moved[j]).alias(f"b{i}{j}") for i, j in PAIRS]
    bins = near.groupBy("cell", "bin").agg(F.count(F.lit(1)).alias("n"), *sums)
    whole = Window.partitionBy("cell")
    bins = bins.withColumns({"_before": F.sum("n").over(whole.orderBy("bin")) - F.col("n"), "_all": F.sum("n").over(whole)})
    inner = bins.where(F.col("_before") < F.ceil(SHARE * F.col("_all")))
    totals = inner.groupBy("cell").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in bins.columns if c[0] in "ab" and c[1:].isdigit()])
    est = totals.join(old.select("cell", *[f"m{i}" for i in D]), "cell")
    est = est.withColumns({f"b{i}{j}": F.col(f"b{i}{j}") / F.col("n") - F.col(f"a{i}") * F.col(f"a{j}") / F.col("n") / F.col("n") + F.lit(FLOOR[i] ** 2 if i == j else 0.0) for i, j in PAIRS}
                          | {f"m{i}": F.col(f"m{i}") + F.col(f"a{i}") / F.col("n") for i in D})
    for j in D:  # Cholesky factor in place, column by column
        less = lambda i: sum((F.col(f"b{i}{k}") * F.col(f"b{j}{k}") for k in range(j)), F.lit(0.0))  # noqa: B023, E731
        est = est.withColumn(f"b{j}{j}", F.sqrt(F.col(f"b{j}{j}") - less(j)))
        if j + 1 < len(D):
            est = est.withColumns({f"b{i}{j}": (F.col(f"b{i}{j}") - less(i)) / F.col(f"b{j}{j}") for i in range(j + 1, len(D))})
    est = est.withColumns({f"w{i}{i}": 1 / F.col(f"b{i}{i}") for i in D})
    for apart in D[1:]:  # its inverse, diagonal by diagonal
        est = est.withColumns({f"w{j + apart}{j}": -sum((F.col(f"b{j + apart}{k}") * F.col(f"w{k}{j}") for k in range(j, j + apart)), F.lit(0.0)) * F.col(f"w{j + apart}{j + apart}")
                               for j in range(len(D) - apart)})
    det = F.col("b00")
    for i in D[1:]:
        det = det * F.col(f"b{i}{i}")
    return est.select("cell", *[f"m{i}" for i in D], *[f"w{i}{j}" for i, j in PAIRS], (det * det).alias("det"))


def _binned(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Vectors with their distance, and its bin: 32 to a doubling, whatever is below 2**-10 in one."""
    near = rows.join(fit, "cell").withColumn("distance", _distance())
    return near.withColumn("bin", F.greatest(F.floor(32 * F.log2(F.greatest("distance", F.lit(1e-9)))), F.lit(-320)))


def fit(rows: DataFrame) -> DataFrame:
    """Per cell: mean m, whitening matrix w, det, and the squared distance ``cutoff`` beyond which a vector is odd."""
    est = materialise(_start(rows), "estimate")
    for _ in range(STEPS):
        new = _concentrate(_binned(rows, est), est)
        both = new.join(est.select("cell", F.col("det").alias("_old")), "cell")
        est = materialise(both, "estimate")
        if est.where(F.col("det") < F.col("_old") * (1 - SETTLED)).isEmpty():
            break
        est = est.drop("_old")
    bins = _binned(rows, est).groupBy("cell", "bin").agg(F.count(F.lit(1)).alias("n"))
    middle = _quantile(bins, ["cell"], 0.5, "bin").select("cell", F.pow(F.lit(2.0), (F.col("bin") + 1) / 32).alias("_middle"))
    return materialise(est.join(middle, "cell").withColumn("cutoff", CUTOFF * F.greatest(F.lit(1.0), F.col("_middle") / NORMAL_MEDIAN)).drop("_middle", "_old"), "fit")


def judge(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, the statistics, base_failed, distance (null where the fixed limits decide or no cell is large enough), kept."""
    own = F.xxhash64(F.lit(0), *_name("lang"), *_name("source"))
    counted = statistics(docs).select("doc_id", "lang", *STATISTICS, "n_lines", failed().alias("base_failed"), own.alias("own"))
    counted = materialise(counted, "statistics")
    vectors = counted.where("NOT base_failed").withColumns({f"z{i}": F.expr(e) for i, e in enumerate(TRANSFORMED)})
    placed = materialise(vectors.select("own", *[f"z{i}" for i in D]).join(cells(vectors, least), "own"), "vectors")
    enough = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("cell")
    found = fit(placed.join(enough, "cell"))
    where = cells(vectors, least).join(found, "cell").withColumnRenamed("own", "_own")
    out = counted.withColumns({f"z{i}": F.when(~F.col("base_failed"), F.expr(e)) for i, e in enumerate(TRANSFORMED)})
    out = out.join(where, (F.col("own") == F.col("_own")) & ~F.col("base_failed"), "left").withColumn("distance", _distance())
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("cutoff"), F.lit(True))
    return out.select("doc_id", *STATISTICS, "base_failed", "distance", kept.alias("kept"))
