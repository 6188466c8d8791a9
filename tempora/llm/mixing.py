"""Mixing of sources to target weights by entropy balancing.

Among all ways to repeat documents so that every source gives its target number of tokens, take the one closest in
relative entropy to taking each document once, with at most CAP copies. Its rates are exponentially tilted in the
document's size: min(CAP, exp(tilt * size / mean size)), with one dual variable, the tilt, for each source's token
constraint. The dual is convex; Newton steps, kept inside a bracket, solve it for all sources at once on the table of
(source, size, number of documents), so an iteration costs a small aggregate however many documents there are.

Rates become copies without chance: cells of equal source and size, split by a hash of the id, share their
fractional copies by a running sum in falling size, which leaves a source's tokens off by less than one document, and
the cell whose size is nearest to that remainder settles it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tempora.llm.text import n_words
from tempora.session import materialize

CAP = 3
#: Weights of the sources in their order, repeated.
WEIGHTS = (1, 2, 3)
#: Newton steps stop when no source is further from its target than this share of its size.
TOLERANCE = 1e-6
STEPS_A_ROUND = 4
#: Halving alone closes any bracket within this many rounds.
MAX_ROUNDS = 30
#: Parts of a cell, so that documents of one source and size are numbered by many tasks.
PARTS = 64


def _site(source: Column) -> Column:
    """A source as text that sorts by code point with NULL last."""
    return F.when(source.isNull(), "2").otherwise(F.concat(F.lit("1"), source.cast("string")))


def targets(cells: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(site, source_size, target) from (site, size, n): all tokens shared by weight, at most cap times a source's size.

    Sources fill up in the order of cap * size / weight; the first that stays below the level of what is left to share
    sets the level for itself and all after it. One row a source goes through these windows.
    """
    size = cells.groupBy("site").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    own = size.withColumn("rank", F.row_number().over(Window.orderBy("site")) - 1).withColumn("weight", pick) \
        .withColumn("full", cap * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("full") / F.col("weight"), "site")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) \
        / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    own = own.withColumn("level", level)
    open_ = F.when(F.col("full") / F.col("weight") >= F.col("level"), F.col("level"))
    return own.withColumn("level", F.first(open_, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) \
        .select("site", "source_size", F.when(F.col("level").isNull(), F.col("full"))
                .otherwise(F.least("full", F.col("weight") * F.col("level"))).alias("target"))


def _rate(tilt: str, cap: int) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(F.lit(50.0), F.col(tilt) * F.col("size") / F.col("mean"))))


def tilts(cells: DataFrame, goals: DataFrame, cap: int = CAP, tolerance: float = TOLERANCE) -> DataFrame:
    """(site, source_size, target, mean, tilt): the dual solution of every source."""
    shape = cells.where("size > 0").groupBy("site").agg(F.min("size").alias("least"), (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    edge = F.log(F.col("target") / F.col("source_size")) * F.col("mean") / F.col("least")
    state = goals.join(shape, "site").withColumn("edge", edge).select(
        "site", "source_size", "target", "mean", F.lit(0.0).alias("tilt"), F.least(F.lit(0.0), "edge").alias("low"),
        F.greatest(F.lit(0.0), "edge").alias("high"), F.lit(1.0).alias("gap"))
    state = materialize(state, "dual")
    for _ in range(MAX_ROUNDS):
        for _ in range(STEPS_A_ROUND):
            state = _newton(cells, state, cap)
        state = materialize(state, "dual")
        if not state.where(F.col("gap") > tolerance).limit(1).count():
            break
    return state.select("site", "source_size", "target", "mean", "tilt")


def _newton(cells: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """One step: the dual's gradient and second derivative at the tilts, then Newton's point, or the bracket's middle."""
    mass, rate = F.col("size") * F.col("n"), _rate("tilt", cap)
    slope = F.when(rate < cap, mass * rate * F.col("size") / F.col("mean")).otherwise(0.0)
    at = cells.join(state.select("site", "tilt", "mean"), "site").groupBy("site") \
        .agg(F.sum(mass * rate).alias("taken"), F.sum(slope).alias("slope"))
    over = F.col("taken") - F.col("target")
    gap = F.abs(over) / F.col("source_size")
    new = state.join(at, "site").withColumns({"gap": gap, "low": F.when(over <= 0, F.col("tilt")).otherwise(F.col("low")),
                                              "high": F.when(over >= 0, F.col("tilt")).otherwise(F.col("high"))})
    point = F.when(F.col("slope") > 0, F.col("tilt") - over / F.col("slope"))
    inside = F.coalesce((point > F.col("low")) & (point < F.col("high")), F.lit(False))
    tilt = F.when(F.col("gap") <= TOLERANCE / 10, F.col("tilt")).when(inside, point).otherwise((F.col("low") + F.col("high")) / 2)
    return new.withColumn("tilt", tilt).select(*state.columns)


def _shares(cells: DataFrame, solved: DataFrame, cap: int) -> DataFrame:
    """(site, size, part, base, extra, ...): copies of every document of a cell, and how many of them get one more."""
    falling = Window.partitionBy("site").orderBy(F.col("size").desc(), "part").rowsBetween(Window.unboundedPreceding, 0)
    rate = F.when(F.col("size") == 0, F.lit(1.0)).when(F.col("target") >= cap * F.col("source_size"), F.lit(float(cap))).otherwise(_rate("tilt", cap))
    own = cells.join(solved, "site").withColumn("rate", rate).withColumn("base", F.floor("rate"))
    own = own.withColumn("upto", F.sum(F.col("n") * (F.col("rate") - F.col("base"))).over(falling))
    step = F.col("n") * (F.col("rate") - F.col("base"))
    extra = F.floor(F.col("upto") + 0.5) - F.floor(F.col("upto") - step + 0.5)
    own = own.withColumn("extra", F.greatest(F.lit(0), F.least(F.col("n"), extra))).select("site", "size", "part", "n", "base", "extra", "source_size", "target")
    for _ in range(2):
        own = _settle(materialize(own, "cells"), cap)
    return own


def _settle(own: DataFrame, cap: int) -> DataFrame:
    """One copy more or less of the document whose size is nearest to what a source is off, if that brings it closer."""
    off = own.groupBy("site").agg((F.first("target") - F.sum(F.col("size") * (F.col("base") * F.col("n") + F.col("extra")))).alias("off"))
    with_off = own.join(off, "site")
    more = (F.col("off") > 0) & (F.col("extra") < F.col("n")) & (F.col("base") < cap)
    less = (F.col("off") < 0) & (F.col("extra") > 0)
    miss = F.abs(F.abs("off") - F.col("size"))
    best = with_off.where((more | less) & (miss < F.abs("off")) & (F.col("size") > 0)) \
        .groupBy("site").agg(F.min(F.struct(miss.alias("miss"), "size", "part")).alias("best"), F.first(F.signum("off")).alias("sign")) \
        .select("site", F.col("best.size").alias("size"), F.col("best.part").alias("part"), F.col("sign").cast("long").alias("change"))
    return own.join(best, ["site", "size", "part"], "left").withColumn("extra", F.col("extra") + F.coalesce("change", F.lit(0))).drop("change")


def mix(docs: DataFrame, size: Column | None = None, source: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(row, size, source_size, target, copies): every input row as a struct and how often the mix takes it.

    A NULL source is a source of its own, after all others. NULL text has size 0; documents of size 0 are taken once,
    and a source of them has target 0. Repeated rows are documents each. Equal input gives equal output. Input columns
    live inside ``row``, so their names cannot clash. An empty table gives no rows.
    """
    sized = docs.select(F.struct(*docs.columns).alias("row"), _site(F.col(source)).alias("site"),
                        (n_words(F.col("text")) if size is None else size).cast("long").alias("size"),
                        F.xxhash64("doc_id").alias("hash")).withColumn("part", F.pmod("hash", F.lit(PARTS)).cast("int"))
    parts = materialize(sized.groupBy("site", "size", "part").agg(F.count("*").alias("n")), "sizes")
    cells = parts.groupBy("site", "size").agg(F.sum("n").alias("n"))
    goals = materialize(targets(cells, weights, cap), "targets")
    solved = tilts(cells, goals, cap).join(goals.select("site"), "site", "right")
    solved = goals.join(solved.select("site", "mean", "tilt"), "site")
    shares = materialize(_shares(parts, solved, cap), "shares").select("site", "size", "part", "base", "extra", "source_size", "target")
    order = Window.partitionBy("site", "size", "part").orderBy("hash", F.col("row.doc_id"))
    placed = sized.withColumn("at", F.row_number().over(order)).join(shares, ["site", "size", "part"])
    return placed.select("row", "size", "source_size", "target",
                         (F.col("base") + F.when(F.col("at") <= F.col("extra"), 1).otherwise(0)).cast("long").alias("copies"))


def mix_table(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of every document."""
    return mix(docs.select("doc_id", "source", "text").withColumn("size", n_words(F.col("text"))).drop("text"), F.col("size")).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def repeat_documents(docs: DataFrame) -> DataFrame:
    """The documents as often as the mix takes them; a document taken twice is two rows."""
    return mix(docs).select("row", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1)))).alias("copy"), "copies") \
        .where("copies >= 1").select("row.*")
