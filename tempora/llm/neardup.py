"""Near-duplicate documents by ProbMinHash on weighted five-word shingles.

Every shingle is a Poisson process whose rate is its weight and whose arrivals each fall into one of REGISTERS
registers; both depend on the shingle alone. A register keeps the shingle that arrives first. Two texts agree in a
register with the probability Jaccard similarity of their weights, which is the Jaccard similarity where no shingle
repeats. Arrivals after the latest register was filled change nothing, so generation stops there.

Links are judged by the sets, so weights must not part what the sets have in common. They grow with the count of a
shingle in the text, but from 1 to less than HEAVIEST. A register then agrees for each common shingle i with probability
1 / sum_j max(a_j / a_i, b_j / b_i), no term of which is above HEAVIEST: whatever repeats, the weighted similarity is at
least the sets' similarity divided by HEAVIEST. Bands of BAND registers give keys; a pair at 0.8 has at least 0.8 /
HEAVIEST = 0.762 and shares none of the BANDS keys with a probability of at most (1 - 0.762^4)^31 = 2.9e-6.

Equal texts are one node before banding. Under a key every member is first paired with the smallest node and with one
drawn by a hash of node and key: these pairs grow with the members, not with their square. Pairs are verified by the
exact Jaccard similarity of their shingle sets, and verified pairs make classes. Then the members of keys that still hold
several classes meet again, so that no two nodes that share a key stay apart unless they cannot be alike. They do not
meet under the key but under shingles: put in one order, rare ones first, two alike sets have a shingle in common within
the first 11% of the smaller and the first 20% of the larger one (at 0.8). A template that many texts share fills the
later places, so texts that are alike below the limit through a template never meet. A shingle whose members are one
class makes no pair, the largest class under a shingle meets the others only, and a frequent shingle is cut into blocks
of ROWS members, each pair of blocks a join key of its own. Sizes and parities rule pairs out inside the join: a set's
parity is PARITY words of bits in which every element flips one, so two sets differ in at least as many elements as their
parities in bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from tempora.llm.bits import key_table, present
from tempora.llm.components import components
from tempora.llm.hashing import mix, parts, shingles, slices
from tempora.llm.text import text_key
from tempora.session import materialize

SHINGLE = 5
SIMILARITY = 0.8
#: What the weights of shingles stay below; a shingle that stands once weighs 1.
HEAVIEST = 1.05
BANDS = 31
BAND = 4
REGISTERS = BANDS * BAND
#: 64-bit words of the parity of a shingle set.
PARITY = 8
#: Counters of the sketch that puts shingles in order, and how many of them make one block of it.
CELLS = 1 << 20
CELL_BLOCK = 1 << 16
#: Members of a shingle that make one block of its pairs.
ROWS = 2000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = (1 << 64) - 1


def weights_of(counts: np.ndarray) -> np.ndarray:
    """The weights of shingles by their counts in the text: 1 for one, growing towards HEAVIEST."""
    return HEAVIEST - (HEAVIEST - 1) / counts


def signature(elements: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The first element to arrive in each register. elements: distinct 64-bit hashes; none gives empty registers."""
    first = np.full(registers, np.inf)
    owner = np.full(registers, _EMPTY, np.uint64)
    if not len(elements):
        return owner
    time, arrival = np.zeros(len(elements)), 0
    # so many arrivals fill all registers as a rule; then few are left to follow
    block = max(1, int(np.ceil(1.3 * registers * np.log(registers) / len(elements))))
    while len(elements):
        turn = np.arange(arrival + 1, arrival + block + 1, dtype=np.uint64) * _STEP
        draw = mix(elements[:, None] + turn)
        gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[:, None]
        at = time[:, None] + np.cumsum(gap, 1)
        place = (mix(draw) % np.uint64(registers)).astype(np.int64)
        time, who = at[:, -1], np.broadcast_to(elements[:, None], at.shape)
        early = at < first[place]
        at_, place_, who_ = at[early], place[early], who[early]
        order = np.argsort(-at_, kind="stable")  # the earliest is written last
        first[place_[order]] = at_[order]
        owner[place_[order]] = who_[order]
        on = time < first.max()
        elements, weights, time = elements[on], weights[on], time[on]
        arrival += block
        block = max(1, block // 4)
    return owner


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, keys) of every row: the keys of its bands."""
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEP
        for batch in batches:
            for part in slices(batch, "text"):
                keys = []
                for own in parts(*shingles(part.column("text"), SHINGLE)):
                    element, n = np.unique(own, return_counts=True)
                    rows = mix(signature(element, weights_of(n))).reshape(BANDS, BAND)
                    key = band.copy()
                    for j in range(BAND):
                        key = mix(key + rows[:, j])
                    keys.append(key.view(np.int64) if len(own) else np.empty(0, np.int64))
                flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
                ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "k1", "k2")),
                                                  pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=schema)

    return docs.mapInArrow(sign, "doc_id long, k1 long, k2 long, keys array<long>")


def leaders(nodes: DataFrame) -> DataFrame:
    """(key, low, drawn) of the keys that several of the nodes (node, keys) share."""
    return nodes.select("node", F.explode("keys").alias("key")).groupBy("key") \
        .agg(F.min("node").alias("low"), F.max("node").alias("high"), F.min_by("node", F.xxhash64("node", "key")).alias("drawn")) \
        .where("low < high").drop("high")


def candidates(nodes: DataFrame, led: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes (node, keys) that meet under a key: each with two of its key's nodes."""
    met = nodes.select("node", F.explode("keys").alias("key")).join(led, "key") \
        .select("node", F.explode(F.array_distinct(F.array("low", "drawn"))).alias("other")).where("node <> other")
    return met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def parity(elements: np.ndarray) -> np.ndarray:
    """PARITY 64-bit words; each of the distinct 32-bit elements flips one bit of them."""
    count = np.bincount(mix(elements.astype(np.uint64)) % np.uint64(64 * PARITY), minlength=64 * PARITY)
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64)


def _members(nodes: DataFrame, led: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of the nodes under keys that hold several roots."""
    under = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.explode("keys").alias("key")) \
        .join(led.select("key", "low"), "key").where("node <> low")
    mixed = under.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r < s").select("key")
    return under.join(mixed, "key", "left_semi").select("node", "root").distinct()


def _frequencies(sets: DataFrame) -> Broadcast:
    """One byte for each of CELLS cells of shingles: the number of bits of its count over the sets."""
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(CELL_BLOCK, np.uint8)
        out[pdf["cell"].to_numpy() % CELL_BLOCK] = np.ceil(np.log2(pdf["count"].to_numpy() + 1.0))
        return pd.DataFrame({"block": [pdf["cell"].iloc[0] // CELL_BLOCK], "bits": [out.tobytes()]})

    counts = sets.select(F.explode("shingles").alias("shingle")).groupBy(F.pmod("shingle", F.lit(CELLS)).alias("cell")).count()
    blocks = counts.groupBy(F.floor(F.col("cell") / CELL_BLOCK)).applyInPandas(fold, "block long, bits binary")
    table = np.zeros(CELLS, np.uint8)
    for row in blocks.toLocalIterator():
        table[row["block"] * CELL_BLOCK:(row["block"] + 1) * CELL_BLOCK] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return sets.sparkSession.sparkContext.broadcast(table)


def prefix_lengths(n: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """How many first shingles of a set of n, as the smaller and as the larger one, hold one of any set alike to it."""
    small = n - np.ceil(2 * n * similarity / (1 + similarity) - 1e-6) + 1
    large = n - np.ceil(n * similarity - 1e-6) + 1
    return np.minimum(small, n).astype(np.int64), np.minimum(large, n).astype(np.int64)


def _prefixes(own: DataFrame, similarity: float) -> DataFrame:
    """(node, root, n, parity, shingle, small) of the first shingles of the sets (node, root, shingles, parity)."""
    order = _frequencies(own)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = order.value
        for batch in batches:
            firsts, smalls, sizes = [], [], []
            for values in batch.column("shingles"):
                s = values.values.to_numpy()
                s = s[np.lexsort((s, table[s.view(np.uint32) % np.uint32(CELLS)]))]
                small, large = prefix_lengths(np.int64(len(s)), similarity)
                firsts.append(s[:large])
                smalls.append(int(small))
                sizes.append(len(s))
            ends = pa.array(np.cumsum([0, *map(len, firsts)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*firsts, np.empty(0, np.int32)])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "root", "parity")), pa.array(sizes, pa.int64()), pa.array(smalls, pa.int64()), lists],
                                             ["node", "root", "parity", "n", "smalls", "first"])

    return own.mapInArrow(cut, "node long, root long, parity array<long>, n long, smalls long, first array<int>") \
        .select("node", "root", "n", "parity", "smalls", F.posexplode("first").alias("place", "shingle")) \
        .select("node", "root", "n", "parity", "shingle", (F.col("place") < F.col("smalls")).alias("small"))


def _meetings(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join under shingles with several roots, and the columns at, side, i, j that they meet on.

    Rows of the largest class under a shingle meet the rows of other classes only.
    """
    held = prefixes.groupBy("shingle", "root").count().groupBy("shingle") \
        .agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.sum("count").alias("rows"), F.count("*").alias("roots")).where("roots > 1") \
        .select("shingle", "main", F.ceil(F.col("rows") / ROWS).cast("int").alias("blocks"))
    rows = prefixes.join(held, "shingle").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("every", F.expr("sequence(0, blocks - 1)"))
    main = F.col("root") == F.col("main")
    at = ["node", "root", "n", "parity"]
    low = rows.where("small").withColumn("side", F.explode(F.when(main, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1))))) \
        .select(*at, "shingle", "side", F.col("own").alias("i"), F.explode("every").alias("j"))
    high = rows.select(*[F.col(c).alias(f"{c}_") for c in at], "shingle", F.when(main, 1).otherwise(0).alias("side"), F.explode("every").alias("i"), F.col("own").alias("j"))
    return low, high


def _apart(members: DataFrame, tested: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) not yet tested of the members (node, root) that have different roots and may be alike."""
    own = members.join(sets, "node").select("node", "root", "shingles", "parity")
    low, high = _meetings(materialize(_prefixes(materialize(own, "mixed"), similarity), "prefixes"))
    sizes = (F.col("n") <= F.col("n_")) & (F.col("n") >= F.col("n_") * similarity - 1e-6)
    # sets with N elements together are alike if no more than N (1 - s) / (1 + s) of them are in one set only
    differ = sum((F.bit_count(F.col("parity")[i].bitwiseXOR(F.col("parity_")[i])) for i in range(PARITY)), F.lit(0))
    few = differ <= (F.col("n") + F.col("n_")) * ((1 - similarity) / (1 + similarity)) + 1e-6
    met = low.join(high, ["shingle", "side", "i", "j"]).where((F.col("root") != F.col("root_")) & sizes & few)
    pairs = met.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b")).distinct()
    return pairs.join(tested, ["a", "b"], "left_anti")


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, common, every): the pairs' counts of common and of all shingles."""
    common = F.size(F.array_intersect("sa", "sb"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a") \
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b") \
        .select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).alias("sizes"))
    return both.select("a", "b", "common", (F.col("sizes") - F.col("common")).alias("every"))


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles, parity) of the wanted nodes; texts of others are left out before any shuffle."""
    bits, n_bits = key_table(wanted, F.xxhash64("k1"), wanted.count())
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("shingles", pa.list_(pa.int32())), ("parity", pa.list_(pa.int64()))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            hit = present(table, batch.column("hash").to_numpy().view(np.uint64) % np.uint64(n_bits))
            for part in slices(batch.filter(pa.array(hit)), "text"):
                sets = [np.unique((s >> np.uint64(32)).astype(np.uint32)) for s in parts(*shingles(part.column("text"), SHINGLE))]
                bit_words = [parity(s) for s in sets]
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32)), pa.array(np.concatenate(own).view(kind)))
                         for own, kind in ((sets, np.int32), (bit_words, np.int64))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("k1", "k2")), *lists], schema=schema)

    found = docs.withColumn("hash", F.xxhash64("k1")).select("k1", "k2", "hash", "text").mapInArrow(gather, "k1 long, k2 long, shingles array<int>, parity array<long>")
    return found.join(wanted.select("node", "k1", "k2"), ["k1", "k2"]).dropDuplicates(["node"]).select("node", "shingles", "parity")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, k1, k2, root, class_id) of every row: k1 and k2 name its text, root its class, class_id is the smallest doc_id there.

    Classes are of texts and connected: a text is in a class if a chain of pairs at ``similarity`` or more leads there.
    NULL text counts as empty; texts without words are alike only if equal. Different texts under one doc_id are texts of
    their own: the id appears in each of their classes, whose class_id it may be. A class without any doc_id is named by
    a hash of its texts. Other columns are not read; an empty table gives no rows.
    """
    k1, k2 = text_key(F.col("text"))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    signed = materialize(_signed(source), "signatures")
    same = materialize(signed.groupBy("k1", "k2").agg(F.min("doc_id").alias("low_id"), F.first("keys").alias("keys"))
                       .withColumn("node", F.monotonically_increasing_id()), "texts")  # ids hold because they are read back
    led = materialize(leaders(same), "keys")
    pairs = materialize(candidates(same, led), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = materialize(same.drop("low_id").join(ends, "node"), "ends")
    sets = materialize(_sets(source, wanted.drop("keys")), "shingles")
    alike = F.col("common") >= similarity * F.col("every")
    tested = materialize(_distances(pairs, sets), "distances")
    roots = materialize(components(tested.where(alike).select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots")
    rest = materialize(_apart(_members(wanted, led, roots), tested, sets, similarity), "rest")
    found = materialize(_distances(rest, sets).where(alike).select("a", "b"), "found")
    if not found.isEmpty():
        # classes become nodes: the links found join them to larger ones
        links = found.join(roots.withColumnsRenamed({"node": "a", "root": "u"}), "a", "left").join(roots.withColumnsRenamed({"node": "b", "root": "v"}), "b", "left") \
            .select(F.coalesce("u", "a").alias("u"), F.coalesce("v", "b").alias("v"))
        joined = materialize(components(links).select(F.col("node").alias("root"), F.col("root").alias("top")), "joined")
        known = roots.unionByName(joined.select(F.col("root").alias("node"), "root")).distinct()
        roots = known.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    named = same.select("k1", "k2", "node", "low_id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.coalesce(F.min("low_id"), F.min("k1")).alias("class_id"))
    return signed.select("doc_id", "k1", "k2").join(named.join(lowest, "root").select("k1", "k2", "root", "class_id"), ["k1", "k2"])


def class_table(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id) of every row, NULL, empty and repeated ones included as :func:`classes` has them."""
    return classes(docs).select("doc_id", "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one with the smallest doc_id, unchanged.

    Of several texts with that doc_id in one class the first by hash stays, of repeated rows any one; a row without a
    doc_id stays only where its class has none. A doc_id with texts in two classes stays in both.
    """
    k1, k2 = text_key(F.col("text"))
    kept = classes(docs).groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "k1", "k2")).alias("k")).select("k.doc_id", "k.k1", "k.k2")
    rows = docs.select(F.struct(*docs.columns).alias("row"), k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("long").alias("id"))
    found = rows.join(kept, ["k1", "k2"]).where(F.col("id").eqNullSafe(F.col("doc_id")))
    return found.groupBy("k1", "k2").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
