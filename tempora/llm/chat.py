"""Collapse of cumulative conversation snapshots, and rendering.

Loggers store a conversation again after every turn, so most logged conversations are prefixes of later ones. Each
turn's hash includes its position; the running sums of these hashes are the rolling hashes of all prefixes. A
conversation whose whole hash occurs as a proper prefix of any other is dropped by an anti-join of distinct hashes;
of equal conversations the smallest id stays. What is left is rendered turn by turn.

Positions and running sums are built from blocks of BLOCK turn numbers and one row a block, so a very long
conversation is spread over many tasks. Hashes are grouped before they meet, so a first turn that all share is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tempora.session import materialize

BLOCK = 256
TEMPLATE = "<|{role}|>\n{text}<|end|>\n"


def _numbered(turns: DataFrame) -> DataFrame:
    """Distinct turns with their block, their position from 1, and their conversation's number of turns."""
    t = turns.select(F.col("conv_id"), F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).distinct() \
        .withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("long"))
    local = Window.partitionBy("conv_id", "block").orderBy(*[F.col(c).asc_nulls_first() for c in ("turn", "role", "text")])
    whole = Window.partitionBy("conv_id")
    blocks = t.groupBy("conv_id", "block").agg(F.count("*").alias("n")).select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), F.sum("n").over(whole).alias("n_turns"),
        F.coalesce(F.sum("n").over(whole.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return t.withColumn("at", F.row_number().over(local)) \
        .join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b"))) \
        .select("conv_id", "block", "turn", "role", "text", (F.col("at") + F.col("before")).alias("position"), "n_turns")


def _halves(seed: int) -> list[Column]:
    h = F.xxhash64(F.lit(seed), "position", F.col("role").isNull(), "role", F.col("text").isNull(), "text")
    return [h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)]


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, position, n_turns, k1, k2): the rolling hash of every prefix of every conversation."""
    sums = ["s1", "s2", "s3", "s4"]
    t = _numbered(turns).select("conv_id", "block", "position", "n_turns", *[h.alias(s) for h, s in zip(_halves(1) + _halves(2), sums)])
    t = materialize(t, "turns")
    within = Window.partitionBy("conv_id", "block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("conv_id", "block").agg(*[F.sum(s).alias(s) for s in sums]).select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"), *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"o{s}") for s in sums])
    rolled = t.select("conv_id", "block", "position", "n_turns", *[F.sum(s).over(within).alias(s) for s in sums]) \
        .join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    total = [F.col(s) + F.col(f"o{s}") for s in sums]
    return rolled.select("conv_id", "position", "n_turns", F.xxhash64(*total).alias("k1"), F.xxhash64(F.lit(7), *total).alias("k2"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): conversations that are no prefix of a longer one, one of each set of equals."""
    rolled = materialize(prefixes(turns), "prefixes")
    whole = rolled.where("position = n_turns").groupBy("n_turns", "k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    longer = rolled.where("position < n_turns").select(F.col("position").alias("n_turns"), "k1", "k2").distinct()
    return whole.join(longer, ["n_turns", "k1", "k2"], "left_anti").select("conv_id", "n_turns", "copies")


def render(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """(conv_id, position, n_turns, copies, rendered): the turns of all maximal conversations, formatted.

    A conversation's turns in the order of turn, role and text, NULL first; repeated rows count once. NULL role and
    text differ from empty ones but render as empty. Rows without a conv_id are one conversation with the id NULL.
    The text of a conversation is its turns' in the order of position. Other columns are not read.
    """
    left = maximal(turns).select(F.col("conv_id").alias("c"), "copies")
    head, middle, tail = (template.replace("{role}", "\0").replace("{text}", "\0").split("\0"))
    shown = F.concat(F.lit(head), F.coalesce("role", F.lit("")), F.lit(middle), F.coalesce("text", F.lit("")), F.lit(tail))
    return _numbered(turns).join(left, F.col("conv_id").eqNullSafe(F.col("c"))) \
        .select("conv_id", F.col("position").cast("long").alias("position"), "n_turns", "copies", shown.alias("rendered"))


SQL = r"""
WITH d AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS position,
             count(*) OVER (PARTITION BY conv_id) AS n_turns,
             md5(concat(CASE WHEN role IS NULL THEN 'n' ELSE md5(role) END, CASE WHEN text IS NULL THEN 'n' ELSE md5(text) END)) AS h FROM d),
p AS (SELECT conv_id, position, n_turns, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY position) AS pre FROM t),
f AS (SELECT pre, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE position = n_turns GROUP BY pre),
m AS (SELECT conv_id, copies FROM f ANTI JOIN (SELECT DISTINCT pre FROM p WHERE position < n_turns) USING (pre))
SELECT t.conv_id, position, CAST(n_turns AS BIGINT) AS n_turns, copies,
       concat('<|', coalesce(role, ''), '|>', chr(10), coalesce(text, ''), '<|end|>', chr(10)) AS rendered
FROM t JOIN m ON t.conv_id IS NOT DISTINCT FROM m.conv_id
"""
