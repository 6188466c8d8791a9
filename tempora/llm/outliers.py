"""Quality rules: robust multivariate outliers within each language and source.

A document's statistics become a vector of four nearly normal values. For each language and source a minimum covariance
determinant estimate gives a centre and a covariance that outliers cannot pull: from medians and deviations, repeated
concentration steps keep the COVER share of documents nearest by Mahalanobis distance and estimate again from them.
Documents beyond the LIMIT quantile of the distances' law are rejected.

Most documents repeat no line and no words, so these two shares have no normal law over all documents. Each language and
source is therefore split by which of the two a document has at all: where it has none the value is constant and decides
nothing, where it has some the share is judged among the documents that have some. Symbols do not split a group: where
clean documents have none the value is constant, and FLOORS says how far from it a document may be.

Statistics are computed within a row by array functions and written once; the steps then aggregate that narrow table.
Quantiles come from counts in fine bins, so they are the same however rows are dealt, and a group of any size passes
through partial aggregates only: cuts and estimates, one row a group, are written and joined to the rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tempora.llm.text import WORD, words
from tempora.session import materialize

#: Share of a group's documents that its estimate rests on.
COVER = 0.75
#: Share of clean documents that the distance keeps, were they normal.
LIMIT = 1 - 1e-6
#: Groups of fewer documents are pooled by language, then over all, within what they repeat; a pool that is still smaller
#: rejects nothing.
MIN_GROUP = 50
#: Standard deviations of a value that is constant in a group: log of the mean word length, arc of the share of symbols,
#: logs of the shares of repeated lines and of words in repeated windows. They are far below those of values that vary.
FLOORS = (0.005, 0.03, 0.02, 0.02)
STEPS = 8
_P = len(FLOORS)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]


def _chi2(x: float, p: int) -> float:
    """Distribution function of chi-square for an even number of degrees."""
    term, total = 1.0, 1.0
    for k in range(1, p // 2):
        term *= x / 2 / k
        total += term
    return 1 - math.exp(-x / 2) * total


def _chi2_inverse(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, p) < q else (low, mid)
    return high


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(row, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every input row.

    ``row`` is a struct of the input columns named by ``keep`` (all by default), so names cannot clash. NULL text counts as empty. Lines count if they have a
    word. Steps are separate selections so that no array is computed more than once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    columns, keep = keep or docs.columns, ["row", "lang", "source"]
    a = docs.select(F.struct(*columns).alias("row"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"),
                    words(F.col("text")).alias("w"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
                    (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).alias("n_symbols"))
    b = a.select(*keep, "n_symbols", F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"), F.size("lines").alias("n_lines"),
                 (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"), F.transform("w", lambda x: F.xxhash64(x)).alias("t"))
    stats = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    c = b.select(*keep, *stats, F.slice(F.transform("t", lambda x, i: F.xxhash64(x, F.get("t", i + 1), F.get("t", i + 2))),
                                        F.lit(1), F.greatest(F.lit(0), F.size("t") - 2)).alias("h"))
    seen = F.size(F.array_distinct("h")) < F.size("h")
    d = c.select(*keep, *stats, F.when(seen, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).alias("s"))
    same = lambda e, i: F.coalesce(F.get("s", i)["h"] == e["h"], F.lit(False))
    e = d.select(*keep, *stats, F.sort_array(F.transform(F.filter("s", lambda e, i: same(e, i - 1) | same(e, i + 1)), lambda x: x["i"])).alias("at"))
    width = F.zip_with("at", F.slice("at", F.lit(2), F.greatest(F.lit(0), F.size("at") - 1)), lambda x, y: F.least(F.lit(3), F.coalesce(y - x, F.lit(3))))
    covered = F.when(F.col("at").isNotNull(), F.aggregate(width, F.lit(0), lambda x, y: x + y)).otherwise(0)
    return e.select(*keep, *[F.col(s).cast("long").alias(s) for s in stats], covered.cast("long").alias("n_repeat_words"))


def _vector() -> list[Column]:
    def log_share(part: str, whole: str) -> Column:
        return F.when(F.col(part) > 0, F.log(F.col(part) / F.col(whole))).otherwise(0.0)

    return [F.log(F.greatest(F.lit(1.0), F.col("word_chars") / F.greatest(F.lit(1), F.col("n_words")))),
            F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_symbols") / F.greatest(F.lit(1), F.col("word_chars"))))),
            log_share("n_dup_lines", "n_lines"), log_share("n_repeat_words", "n_words")]


def _with_factor(estimates: DataFrame) -> DataFrame:
    """Columns of the lower triangular factor of the covariance c, and its log determinant; a variance of 0 becomes its floor's."""
    out = estimates.withColumns({f"c{i}{i}": F.greatest(F.col(f"c{i}{i}"), F.lit(FLOORS[i] ** 2)) for i in range(_P)})
    for i, j in _PAIRS:
        rest = F.col(f"c{i}{j}")
        for k in range(j):
            rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        # what the other values explain may leave nothing; the floor keeps the factor regular
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit((FLOORS[i] / 4) ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    return out.withColumn("logdet", sum(F.log(f"l{i}{i}") for i in range(_P)))


def _distance() -> Column:
    """Squared Mahalanobis distance of x from the centre m by the factor l."""
    z: list[Column] = []
    for i in range(_P):
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * z[k]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum(v * v for v in z)


def _quantile(binned: DataFrame, by: list[str], share: float) -> DataFrame:
    """(by, cut): the lowest bin at or below which the share of a group's rows lies."""
    order = Window.partitionBy(*by).orderBy("bin")
    counts = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    return upto.where(F.col("upto") >= share * F.col("total")).groupBy(*by).agg(F.min("bin").alias("cut"))


def _centre(long: DataFrame, name: str) -> DataFrame:
    """Median of v for every group and value, from bins of half a floor."""
    width = F.element_at(F.array(*[F.lit(f / 2) for f in FLOORS]), F.col("k") + 1)
    cut = _quantile(long.select("g", "k", F.floor(F.col("v") / width).alias("bin")), ["g", "k"], 0.5)
    return cut.select("g", "k", ((F.col("cut") + 0.5) * width).alias(name))


def _start(vectors: DataFrame) -> DataFrame:
    long = vectors.select("g", F.posexplode(F.array(*[f"x{i}" for i in range(_P)])).alias("k", "v"))
    middle = materialize(_centre(long, "m"), "medians")
    spread = _centre(long.join(middle, ["g", "k"]).select("g", "k", F.abs(F.col("v") - F.col("m")).alias("v")), "s")
    both = middle.join(spread, ["g", "k"]).groupBy("g").agg(
        *[F.max(F.when(F.col("k") == i, F.col("m"))).alias(f"m{i}") for i in range(_P)],
        *[F.max(F.when(F.col("k") == i, F.pow(1.4826 * F.col("s"), F.lit(2.0)))).alias(f"c{i}{i}") for i in range(_P)])
    return _with_factor(both.withColumns({f"c{i}{j}": F.lit(0.0) for i, j in _PAIRS if i != j}))


def estimate(vectors: DataFrame, cover: float = COVER, steps: int = STEPS) -> DataFrame:
    """Centre and factor of every group g, from (g, x0 ...)."""
    # what a normal law's nearest share understates its covariance by
    scale = cover / _chi2(_chi2_inverse(cover, _P), _P + 2)
    now = materialize(_start(vectors), "estimates")
    for step in range(steps):
        near = vectors.join(now, "g").select("g", *[f"x{i}" for i in range(_P)], F.floor(F.log(_distance() + 1e-3) * 64).alias("bin"))
        cut = materialize(_quantile(near.select("g", "bin"), ["g"], cover), "cuts")
        new = near.join(cut, "g").where("bin <= cut").groupBy("g").agg(
            *[F.avg(f"x{i}").alias(f"m{i}") for i in range(_P)], *[(scale * F.covar_pop(f"x{i}", f"x{j}")).alias(f"c{i}{j}") for i, j in _PAIRS])
        new = materialize(_with_factor(new), "estimates")
        moved = new.select("g", "logdet").join(now.select("g", F.col("logdet").alias("was")), "g").agg(F.max(F.abs(F.col("was") - F.col("logdet")))).first()[0]
        now = new
        if step and (moved or 0.0) < 1e-3:
            break
    return now


def assess(docs: DataFrame, keep: list[str] | None = None, limit: float = LIMIT, min_group: int = MIN_GROUP) -> DataFrame:
    """Every input row with its statistics, ``base_failed`` and ``kept``.

    Documents that fail the base rules take no part in the estimates. NULL is a language and a source of its own; NULL
    text counts as empty. Repeated rows count each. An empty table gives no rows.
    """
    named = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit("="), c))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = materialize(statistics(docs, keep).withColumn("base_failed", failed), "statistics")
    repeats = F.concat((F.col("n_dup_lines") > 0).cast("int").cast("string"), (F.col("n_repeat_words") > 0).cast("int").cast("string"))
    sizes = stats.where("NOT base_failed").groupBy("lang", "source", repeats.alias("gr")).agg(F.count("*").alias("n"))
    small = F.col("n") < min_group
    pool = F.sum(F.when(small, F.col("n"))).over(Window.partitionBy("lang", "gr"))
    rest = F.sum(F.when(small & (F.col("pool") < min_group), F.col("n"))).over(Window.partitionBy("gr"))
    groups = materialize(
        sizes.withColumn("pool", pool).withColumn("rest", rest)
        .select(F.col("lang").alias("gl"), F.col("source").alias("gs"), "gr", F.concat("gr", F.when(
            ~small, F.concat(F.lit("s"), F.length(named("lang")), named("lang"), named("source")))
            .when(F.col("pool") >= min_group, F.concat(F.lit("l"), named("lang"))).when(F.col("rest") >= min_group, F.lit("a"))).alias("g")), "groups")
    own = F.col("lang").eqNullSafe(F.col("gl")) & F.col("source").eqNullSafe(F.col("gs")) & (repeats == F.col("gr"))
    vectors = stats.where("NOT base_failed").join(groups, own).where("g IS NOT NULL").select("g", *[v.alias(f"x{i}") for i, v in enumerate(_vector())])
    judged = materialize(groups.join(estimate(materialize(vectors, "vectors")), "g", "left"), "judged")
    far = _chi2_inverse(limit, _P)
    return stats.withColumns({f"x{i}": v for i, v in enumerate(_vector())}).join(judged, own, "left") \
        .select(*stats.columns, (~F.col("base_failed") & ~F.coalesce(_distance() > far, F.lit(False))).alias("kept"))


def quality_table(docs: DataFrame) -> DataFrame:
    return assess(docs, ["doc_id"]).select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, unchanged."""
    return assess(docs).where("kept").select("row.*")
