"""How five quality filters overlap, in every order, with duplicates found by radix tries.

Four filters judge a text alone; the fifth asks whether a smaller doc_id has the same text. For that the texts are
range-partitioned by adaptive prefixes: every batch sorts its distinct texts and names, every STEP bytes, the shortest
prefix that parts two neighbours, with the bytes since the last; merged and sorted, these weighted prefixes are quantiles
of all texts, and those at multiples of RANGE_BYTES bound the ranges. Near copies simply get longer prefixes. Before the
shuffle a batch settles what it can: of its copies of a text only the smallest doc_id is still open, so a text crosses
the network once a batch, however often it stands in the corpus. A range's texts go into a compressed trie whose
terminals hold the smallest doc_id; a traversal then flags every open row above it.

What is left of a document is a mask of five bits. Masks are counted by part and joined with the labels by doc_id; all
120 orders are then sums over at most 32 masks a part.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tempora.llm.hashing import slices, word_hashes
from tempora.session import materialize

# The filters, and the characters that D rejects.
FILTERS = "ABCDE"
SYMBOLS = "#$%&*|"
MIN_WORDS = 200
#: Bytes of text in a range, as the quantiles have it.
RANGE_BYTES = 16 << 20
#: A batch names a prefix every so many bytes.
STEP = 1 << 18
#: Ranges are made larger rather than more than this: their bounds are sent to every task.
MAX_RANGES = 50_000
_COPY = 16


# ---- the four filters on a text alone ----------------------------------------------------------------------------

def _inside(wanted: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Number of wanted bytes of each text."""
    total = np.concatenate([[0], np.cumsum(wanted)])
    return total[places[1:]] - total[places[:-1]]


def text_masks(texts: pa.Array) -> np.ndarray:
    """Bits 1, 2, 4, 8 of the filters A to D that each text fails; texts are large_binary without NULL."""
    h, words = word_hashes(texts)
    row = np.repeat(np.arange(len(texts)), words)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    distinct = np.bincount(row[new], minlength=len(texts))
    _, places, content = texts.buffers()
    places = np.frombuffer(places, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(content or b"", np.uint8)[places[0]:places[-1]]
    places = places - places[0]
    capitals = _inside((data >= 65) & (data <= 90), places)
    points = _inside((data & 0xC0) != 0x80, places)
    symbols = _inside(np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8)), places)
    return (words < MIN_WORDS) + 2 * (100 * distinct < 50 * words) + 4 * (100 * capitals > 3 * points) + 8 * (symbols > 0)


# ---- ranges by adaptive prefixes ---------------------------------------------------------------------------------

def common_length(a: bytes, b: bytes, at: int = 0) -> int:
    """How many bytes of a stand in b from a place on."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low:at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


def weighted_prefixes(texts: list[bytes], step: int) -> tuple[list[bytes], list[int]]:
    """Prefixes of sorted distinct texts, one for about every ``step`` bytes, and the bytes that each stands for."""
    prefixes, weights, held = [], [], step
    for before, text in zip([b"", *texts], texts):
        if held >= step:
            prefixes.append(text[:common_length(before, text) + 1])
            weights.append(0)
            held = 0
        held += len(text)
        weights[-1] += len(text)
    return prefixes, weights


def _distinct(batch: pa.RecordBatch) -> pa.DictionaryArray:
    return pc.fill_null(batch.column("text").cast(pa.large_binary()), b"").dictionary_encode()


def range_bounds(docs: DataFrame, range_bytes: int = RANGE_BYTES, step: int = STEP) -> list[bytes]:
    """Sorted prefixes; range i holds the texts from bound i - 1 up to bound i."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes, weights = weighted_prefixes(sorted(_distinct(batch).dictionary.to_pylist()), step)
            yield pa.RecordBatch.from_arrays([pa.array(prefixes, pa.binary()), pa.array(weights, pa.int64())], ["prefix", "bytes"])

    named = docs.select("text").mapInArrow(name, "prefix binary, bytes long")
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = materialize(named.repartitionByRange(slots, "prefix").withColumn("slot", F.spark_partition_id()), "prefixes")
    sums = {r["slot"]: r["bytes"] for r in named.groupBy("slot").agg(F.sum("bytes").alias("bytes")).collect()}
    total = sum(sums.values())
    limit = max(range_bytes, total // MAX_RANGES)
    if total <= limit:
        return []
    before, running = F.lit(0).cast("long"), 0
    starts = []
    for slot in sorted(sums):
        starts += [F.lit(slot), F.lit(running).cast("long")]
        running += sums[slot]
    before = F.coalesce(F.create_map(*starts)[F.col("slot")], before)
    upto = F.sum("bytes").over(Window.partitionBy("slot").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)) + before
    placed = named.withColumn("upto", upto)
    crossing = F.floor(F.col("upto") / limit) > F.floor((F.col("upto") - F.col("bytes")) / limit)
    return sorted({bytes(r["prefix"]) for r in placed.where(crossing).select("prefix").collect()})


# ---- tries -------------------------------------------------------------------------------------------------------

class Trie:
    """A compressed trie over bytes. A terminal holds the smallest id inserted there and the rows that were."""

    __slots__ = ("edge", "kids", "low", "rows")

    def __init__(self, edge: bytes = b""):
        self.edge, self.kids, self.low, self.rows = edge, {}, None, []

    def insert(self, text: bytes, id_: int, row: int) -> None:
        node, at = self, 0
        while at < len(text):
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = Trie(text[at:])
            elif not text.startswith(kid.edge, at):
                k = common_length(kid.edge, text, at)
                fork = Trie(kid.edge[:k])
                kid.edge = kid.edge[k:]
                fork.kids[kid.edge[0]] = kid
                node.kids[text[at]] = kid = fork
            node, at = kid, at + len(kid.edge)
        node.low = id_ if node.low is None else min(node.low, id_)
        node.rows.append(row)

    def terminals(self) -> Iterator["Trie"]:
        open_ = [self]
        while open_:
            node = open_.pop()
            if node.rows:
                yield node
            open_.extend(node.kids.values())


_ROWS = pa.schema([("range", pa.int32()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64()), ("text", pa.binary())])
_MASKS = pa.schema([f for f in _ROWS if f.name not in ("range", "text")])


def document_masks(docs: DataFrame, range_bytes: int = RANGE_BYTES, step: int = STEP) -> DataFrame:
    """(doc_id, part, mask, n): masks of all filters, n rows each."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.col("text"))
    bounds = docs.sparkSession.sparkContext.broadcast(range_bounds(source, range_bytes, step))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Open rows with their texts, one for each text and part; the others are settled and carry none."""
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = _distinct(batch)
            distinct = pa.RecordBatch.from_arrays([texts.dictionary], ["text"])
            masks = np.concatenate([text_masks(part.column("text")) for part in slices(distinct, "text")])
            code = texts.indices.to_numpy(zero_copy_only=False)
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(batch.column("doc_id"), 0).to_numpy(zero_copy_only=False)
            low = np.full(len(texts.dictionary), np.iinfo(np.int64).max)
            np.minimum.at(low, code[known], ids[known])
            copy = known & (ids > low[code])
            part = batch.column("part").dictionary_encode()
            part_code = part.indices.to_numpy(zero_copy_only=False)
            keys = np.column_stack([code, part_code, known, copy, np.where(copy, ids, 0)])
            first, n = np.unique(keys, axis=0, return_index=True, return_counts=True)[1:]
            is_open = known[first] & ~copy[first]
            values = texts.dictionary
            ranges = [bisect_right(bounds.value, values[int(c)].as_py()) if o else int(i % (len(bounds.value) + 1)) for c, o, i in zip(code[first], is_open, ids[first])]
            mask = masks[code[first]] + _COPY * copy[first]
            yield pa.RecordBatch.from_arrays([
                pa.array(ranges, pa.int32()), batch.column("doc_id").take(pa.array(first)), batch.column("part").take(pa.array(first)), pa.array(mask.astype(np.int32)),
                pa.array(n.astype(np.int64)), values.take(pa.array(np.where(is_open, code[first], 0), mask=~is_open)).cast(pa.binary())], schema=_ROWS)

    def flag(table: pa.Table) -> pa.Table:
        trie, ids, mask = Trie(), table.column("doc_id").to_pylist(), table.column("mask").to_numpy().copy()
        row = 0
        for chunk in table.column("text").chunks:
            for text in chunk:
                if text.is_valid:
                    trie.insert(text.as_py(), ids[row], row)
                row += 1
        for node in trie.terminals():
            for row in node.rows:
                if ids[row] > node.low:
                    mask[row] += _COPY
        return pa.Table.from_arrays([table.column("doc_id"), table.column("part"), pa.array(mask), table.column("n")], schema=_MASKS)

    rows = source.mapInArrow(settle, "range int, doc_id long, part string, mask int, n long, text binary")
    return rows.groupBy("range").applyInArrow(flag, "doc_id long, part string, mask int, n long")


def audit(docs: DataFrame, labels: DataFrame, range_bytes: int = RANGE_BYTES, step: int = STEP) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    One row for each part (lang, NULL as the empty one), order of the filters and step, zeros included. NULL text is
    empty and as such equal to other empty texts. A row without a doc_id is no copy of anything and makes no other row
    one; rows that repeat a doc_id with the same text are not copies of each other and count as often as they stand. Of
    several labels of a doc_id any with quality 1 makes it good, any with toxic 1 toxic; without one it is neither.
    Other columns are not read; an empty table has no parts and gives no rows.
    """
    one = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(c)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality"), one("toxic"))
    each = document_masks(docs, range_bytes, step).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    counts = each.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("quality", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    mask, bit = F.col("mask"), F.col("bit")
    fails = lambda at: mask.bitwiseAND(at) != 0
    first = F.least(*[F.when(fails(F.lit(1 << i)), F.instr("filter_order", f)).otherwise(len(FILTERS) + 1) for i, f in enumerate(FILTERS)])
    each_order = counts.withColumn("filter_order", F.explode(orders)).withColumn("gone_at", first)
    steps = each_order.withColumn("step", F.explode(F.array(*[F.lit(i + 1) for i in range(len(FILTERS))])))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    steps = steps.withColumn("bit", F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(FILTERS) for x in (f, 1 << i)]), letter))
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(0)).cast("long")
    here = F.col("gone_at") == F.col("step")
    # of the 120 orders, one in bit_count(mask) has this filter first among those that the document fails
    share = F.when(fails(bit), F.col("n") * (F.lit(120) / F.bit_count(mask)).cast("long")).otherwise(0)
    return steps.groupBy("part", "filter_order", "step").agg(
        total(F.col("gone_at") > F.col("step")).alias("kept"), total(here).alias("removed"), total(fails(bit) & (F.col("gone_at") < F.col("step"))).alias("redundant"),
        total(mask == bit).alias("unique_fails"), total(here, "good").alias("good_lost"), total(here, "toxic").alias("toxic_lost"), F.sum(share).cast("long").alias("shapley"))


SQL = r"""WITH p AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM p),
l AS (SELECT doc_id, max((coalesce(quality, 0) = 1)::INT) AS good, max((coalesce(toxic, 0) = 1)::INT) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, [a, b, c, d, e] AS fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT x1.x || x2.x || x3.x || x4.x || x5.x AS filter_order FROM x x1, x x2, x x3, x x4, x x5
  WHERE len(list_distinct([x1.x, x2.x, x3.x, x4.x, x5.x])) = 5),
r AS (SELECT part, filter_order, n, good, toxic, fails, [fails[ascii(filter_order[k]) - 64] for k in range(1, 6)] AS own FROM g, o),
s AS (SELECT *, coalesce(list_position(own, true), 6) AS gone FROM r),
t AS (SELECT *, unnest(range(1, 6))::INT AS step FROM s),
u AS (SELECT part, filter_order, step, sum(CASE WHEN gone = 0 OR gone > step THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN own[step] AND gone < step THEN n ELSE 0 END)::BIGINT AS redundant,
  sum(CASE WHEN own[step] AND len(list_filter(own, lambda y: y)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
  sum(CASE WHEN gone = step THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost FROM t GROUP BY 1, 2, 3)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM u"""
