"""Exact Jaccard join of documents by their n-grams, as a sparse product of the incidence matrix with itself.

Rows of the matrix are distinct shingle sets (documents with equal sets are one row), columns are shingles. All rows of
a product of such a matrix are never needed: two sets with x and y elements are linked only if they have at least
need(x, y) = ceil(P (x + y) / (100 + P)) in common, so with any one order of the columns they must meet within the first
x - ceil(P x / 100) + 1 columns of each. Columns are ordered by frequency, rare ones first: a bounded count sketch over
all shingles of all documents gives each its class, so frequent columns are left out of the product wherever a bound
allows. The sketch decides the order only; any order gives the same links.

Most columns of a prefix belong to one row only and never leave the task that reads the row: tasks send the sorted cells
of their columns, a few bytes each and each once, and a bit table of the cells that come twice says which entries to give
out. Cells and bits can be shared by chance, so some columns of one row pass; they make no pair. Prefixes are never
written: they are cut from the text of one row of each set, once for the cells and once for the entries.

The product is taken in two steps, because a column of m near copies has m^2 entries:

1. Pivots. Every column has one row for a pivot, the one with the largest share of its prefix in columns that others have
   too, which in a group of near copies is the text nearest to all others. Every row meets the one pivot that it shares
   most columns with, of those that its size and parity (below) allow; its overlap is counted in full, and linked rows
   become one component. This leaves a group of near
   copies as one component, or nearly so, with as many overlaps counted as it has rows.
2. Blocks. What is left are columns with rows of several components. More than ROWS rows are cut into blocks of half as
   many; each two blocks are one join key, so no key holds more than about ROWS^2 pairs however frequent the column. The join lets only
   pairs through that are in different components, have fitting sizes, and whose parities allow it: every element flips
   one bit of its set's parity, so sets differ in at least as many elements as their parities in bits, and linked sets
   differ in at most (x + y) (100 - P) / (100 + P). These pairs add up their common columns; a pair goes on only if its
   count and all that lies beyond its prefixes can reach need(x, y). The survivors' overlaps are counted in full; full sets
   are read from the text again, only those of pairs, and shuffled without being written.

Components of the links are found by stars. A shingle is a 64-bit hash of its words, a set is named by two 64-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tempora.llm.bits import key_table, present
from tempora.llm.components import components
from tempora.llm.hashing import mix, parts, shingles, slices
from tempora.session import materialize

SHINGLE = 5
PERCENT = 80
#: Counters of the frequency sketch, and how many of them make one block of it.
CELLS = 1 << 22
BLOCK = 1 << 16
#: Rounds of pivots.
ROUNDS = 1
#: Rows of a column that need no blocks, and of two blocks.
ROWS = 2000
#: Texts are shingled in slices of about so many bytes.
SLICE_BYTES = 1 << 18
#: 64-bit words of a set's parity.
PARITY = 8
#: Columns are told apart by so many bits when those of several rows are looked for; a task sends so many at once.
CELL_BITS = 40
SEND = 1 << 20
_SECOND = np.uint64(0xA24BAED4963EE407)


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """How many first columns of a set of n must hold one in common with any linked set."""
    return n + (-percent * n // 100) + 1


def need(x: Column, y: Column, percent: int = PERCENT) -> Column:
    """The least overlap of linked sets with x and y elements."""
    return F.ceil((x + y) * percent / (100 + percent) - 1e-9)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Small parts of a batch in lower case: the arrays of a part are about a hundred times its text."""
    for part in slices(batch, "text", SLICE_BYTES):
        lower = pc.ascii_lower(pc.fill_null(part.column("text"), ""))
        yield part.set_column(part.schema.get_field_index("text"), "text", lower)


def _sets_of(part: pa.RecordBatch, k: int) -> Iterator[np.ndarray]:
    for own in parts(*shingles(part.column("text"), k)):
        yield np.unique(own)


def _planes(x: np.ndarray) -> bytes:
    """32-bit values, all first bytes before all second ones: small values take little room when compressed."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplaned(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def frequency_classes(docs: DataFrame, k: int = SHINGLE, cells: int | None = None) -> tuple[Broadcast, int]:
    """One byte a cell, the number of bits of its count over all documents; every document counts a shingle once."""
    if cells is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        cells = int(min(CELLS, max(BLOCK, 1 << int(np.ceil(np.log2(max(2.0, size / 4)))))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint32)
        for batch in batches:
            for part in _slices(batch):
                for own in _sets_of(part, k):
                    np.add.at(total, own % np.uint64(cells), 1)
        blocks = [b for b in range(cells // BLOCK) if total[b * BLOCK:(b + 1) * BLOCK].any()]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([zlib.compress(_planes(total[b * BLOCK:(b + 1) * BLOCK]), 1) for b in blocks], pa.binary())], ["block", "counts"])

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.uint64)
        for own in pdf["counts"]:
            total += _unplaned(zlib.decompress(own))
        bits = np.ceil(np.log2(total.astype(np.float64) + 1)).astype(np.uint8)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [bits.tobytes()]})

    out = np.zeros(cells, np.uint8)
    blocks = docs.select("text").mapInArrow(count, "block int, counts binary").groupBy("block").applyInPandas(merge, "block int, bits binary")
    for row in blocks.toLocalIterator():
        out[row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return docs.sparkSession.sparkContext.broadcast(out), cells


def set_keys(own: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set of shingle hashes."""
    a = mix(own.sum(dtype=np.uint64, keepdims=True) + np.uint64(len(own)))
    b = mix(mix(own ^ _SECOND).sum(dtype=np.uint64, keepdims=True))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def parity(own: np.ndarray) -> np.ndarray:
    """PARITY words; each of the distinct elements flips one bit of them."""
    count = np.bincount((mix(own ^ _SECOND) % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY)
    return np.packbits((count & 1).astype(np.uint8)).view(np.int64)


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, th, k1, k2, n, parity) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("parity", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                keys, sizes, bits = [], [], []
                for own in _sets_of(part, k):
                    keys.append(set_keys(own))
                    sizes.append(len(own))
                    bits.append(parity(own))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), pa.array(sizes, pa.int64()),
                                                  pa.ListArray.from_arrays(pa.array(np.arange(len(bits) + 1, dtype=np.int32) * PARITY), pa.array(np.concatenate(bits)))], schema=schema)

    return docs.mapInArrow(sign, "doc_id long, th long, k1 long, k2 long, n long, parity array<long>")


def _prefixes(docs: DataFrame, nodes: DataFrame, classes: Broadcast, cells: int, k: int, percent: int) -> DataFrame:
    """(k1, k2, n, prefix) of the rows that nodes name, and by chance of some others with the same sets."""
    bits, n_bits = key_table(nodes, F.col("th"), nodes.count())
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, named = classes.value, bits.value
        for batch in batches:
            hit = present(named, batch.column("th").to_numpy().view(np.uint64) % np.uint64(n_bits))
            for part in _slices(batch.filter(pa.array(hit))):
                found = {set_keys(own): own for own in _sets_of(part, k) if len(own)}
                sizes = np.array([len(own) for own in found.values()], np.int64)
                firsts = [own[np.lexsort((own, table[own % np.uint64(cells)]))][:n] for own, n in zip(found.values(), prefix_length(sizes, percent).tolist())]
                ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
                flat = np.concatenate([*firsts, np.empty(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=schema)

    return docs.select("th", "text").mapInArrow(cut, "k1 long, k2 long, n long, prefix array<long>")


def _values(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)


def _shared_cells(nodes: DataFrame, total: int) -> DataFrame:
    """(cell) of every column that prefixes of several rows have; they have about ``total`` elements."""
    width = CELL_BITS - int(min(16, max(8, np.ceil(np.log2(max(1.0, total / (1 << 18)))))))

    def packed(cells: np.ndarray) -> pa.RecordBatch:
        found, counts = np.unique(cells, return_counts=True)
        cells = np.repeat(found, np.minimum(counts, 2))
        blocks, at = np.unique(cells >> np.uint64(width), return_index=True)
        rows = [zlib.compress(_planes(np.diff(own - np.uint64(block << width), prepend=np.uint64(0))), 1) for block, own in zip(blocks.tolist(), np.split(cells, at[1:]))]
        return pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int32), pa.int32()), pa.array(rows, pa.binary())], ["block", "cells"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(_values(batch.column("prefix")) & np.uint64((1 << CELL_BITS) - 1))
            n += len(held[-1])
            if n >= SEND:
                yield packed(np.concatenate(held))
                held, n = [], 0
        if n:
            yield packed(np.concatenate(held))

    def several(pdf: pd.DataFrame) -> pd.DataFrame:
        found, counts = np.unique(np.concatenate([np.cumsum(_unplaned(zlib.decompress(x)), dtype=np.int64) for x in pdf["cells"]]), return_counts=True)
        return pd.DataFrame({"cell": found[counts > 1] + (int(pdf["block"].iloc[0]) << width)})

    return nodes.select("prefix").mapInArrow(send, "block int, cells binary").groupBy("block").applyInPandas(several, "cell long")


def shared_prefixes(nodes: DataFrame, total: int) -> DataFrame:
    """``nodes`` (prefix, others) with (columns, places, common) for the prefix, those that have any.

    columns are those that several rows have, and by chance some others, places their places in the row's order, common
    their share of the row's prefix. All prefixes have about ``total`` elements. ``nodes`` is computed twice.
    """
    cells = materialize(_shared_cells(nodes, total), "cells")
    bits, n_bits = key_table(cells, F.col("cell"), 4 * cells.count())
    kept = [c for c in nodes.columns if c != "prefix"]
    out = T.StructType([nodes.schema[c] for c in kept] + [T.StructField("columns", T.ArrayType(T.LongType())), T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("common", T.DoubleType())])

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            sizes = batch.column("prefix").value_lengths().to_numpy()
            values = _values(batch.column("prefix"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            at = np.flatnonzero(present(table, (values & np.uint64((1 << CELL_BITS) - 1)) % np.uint64(n_bits)))
            given = np.bincount(row[at], minlength=len(sizes))
            some = np.flatnonzero(given)
            ends = pa.array(np.cumsum([0, *given[some]]).astype(np.int32))
            arrays = [batch.column(c).take(pa.array(some)) for c in kept]
            arrays += [pa.ListArray.from_arrays(ends, pa.array(values[at].view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(place[at].astype(np.int32))), pa.array(given[some] / sizes[some])]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "columns", "places", "common"])

    return nodes.mapInArrow(give, out)


def _entries(shared: DataFrame) -> DataFrame:
    """A row for each of the columns: (g, i) for (columns, places)."""
    kept = [c for c in shared.columns if c not in ("columns", "places")]
    return shared.select(*kept, F.explode(F.arrays_zip("columns", "places")).alias("e")).select(F.col("e.columns").alias("g"), *kept, F.col("e.places").alias("i"))


def prefix_entries(nodes: DataFrame) -> DataFrame:
    """(g, node, n, i, common) of the prefixes' columns that several rows have, and by chance some others.

    i is the place of the column in the row's order, common the share of the row's prefix that is given out.
    """
    total = nodes.agg(F.sum(F.size("prefix"))).first()[0] or 0
    return _entries(shared_prefixes(nodes.select("node", "n", "prefix"), total)).select("g", "node", "n", "i", "common")


def _full_sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(k1, k2, node, elements) of the wanted nodes; texts of others are left out before any shuffle, all but one in sixty."""
    bits, n_bits = key_table(wanted, F.col("th"), 8 * wanted.count())
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("elements", pa.list_(pa.int64()))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            hit = present(table, batch.column("th").to_numpy().view(np.uint64) % np.uint64(n_bits))
            seen: set[tuple[int, int]] = set()
            for part in _slices(batch.filter(pa.array(hit))):
                found = {}
                for own in _sets_of(part, k):
                    key = set_keys(own)
                    if key not in seen:
                        seen.add(key)
                        found[key] = own
                ends = np.cumsum([0, *map(len, found.values())]).astype(np.int32)
                flat = np.concatenate([*found.values(), np.empty(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], schema=schema)

    found = docs.select("th", "text").mapInArrow(gather, "k1 long, k2 long, elements array<long>")
    once = found.groupBy("k1", "k2").agg(F.max("elements").alias("elements"))
    return once.join(wanted.select("k1", "k2", "node"), ["k1", "k2"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked, by their full overlap; both are named by the keys of the sets."""
    sets = sets.select("k1", "k2", "elements")
    both = pairs.join(sets.toDF("a1", "a2", "ea"), ["a1", "a2"]).join(sets.toDF("b1", "b2", "eb"), ["b1", "b2"])
    common = F.size(F.array_intersect("ea", "eb"))
    sizes = F.size("ea") + F.size("eb")
    return both.where(100 * common >= percent * (sizes - common)).select("a", "b")


def _fits(percent: int) -> Column:
    return 100 * F.least("n", "n_") >= percent * F.greatest("n", "n_")


def _few(n: Column, n_: Column, parity: Column, parity_: Column, percent: int) -> Column:
    """Whether sets of these sizes and parities can be linked."""
    differ = sum((F.bit_count(parity[i].bitwiseXOR(parity_[i])) for i in range(PARITY)), F.lit(0))
    return (100 + percent) * differ <= (100 - percent) * (n + n_)


def pivot_pairs(columns: DataFrame, parities: DataFrame, round_: int, percent: int = PERCENT) -> DataFrame:
    """(a, b): each row with the pivot of another component that it shares most columns with, if the bounds allow.

    ``columns`` (g, node, root, n, i, common) are the entries of the prefixes, i the place of the column in the row's
    order, common the share of the row's prefix in columns that other rows have too. Ties are drawn by a hash of the root.
    ``parities`` (node, parity).
    """
    column = Window.partitionBy("g")
    own = F.struct((-F.col("common")).alias("own"), F.xxhash64(F.col("root"), F.lit(round_)).alias("draw"), F.col("root").alias("root_"), F.col("node").alias("node_"), F.col("n").alias("n_"), F.col("i").alias("i_"))
    # dealt first, so that the structs are made where the columns meet and are not shuffled
    met = columns.withColumn("common", F.ceil(100 * F.col("common")).cast("byte")).repartition("g").withColumn("p", F.min(own).over(column)).select("node", "root", "n", "i", "p.root_", "p.node_", "p.n_", "p.i_").where((F.col("root") != F.col("root_")) & _fits(percent))
    # the first column that two sets share leaves no more overlap than lies behind it
    reach = F.least(F.col("n") - F.col("i"), F.col("n_") - F.col("i_"))
    counted = met.where(reach >= need(F.col("n"), F.col("n_"), percent)).groupBy("node", "node_", "n", "n_").agg(F.count(F.lit(1)).alias("c"))
    counted = counted.join(parities.withColumnsRenamed({"node": "node_", "parity": "parity_"}), "node_").join(parities, "node") \
        .where(_few(F.col("n"), F.col("n_"), F.col("parity"), F.col("parity_"), percent))
    best = counted.groupBy("node").agg(F.max_by("node_", F.struct("c", "node_")).alias("other"))
    return best.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def block_pairs(columns: DataFrame, parities: DataFrame, percent: int = PERCENT, rows: int = ROWS) -> DataFrame:
    """(a, b, common): pairs of different components by blocks, with their common prefix columns, that can still be linked.

    ``parities`` (node, parity). A column of more than ``rows`` rows is cut into blocks of about half as many, so two of
    them are no more than that. Both sides of the join are the same rows, which are shuffled once.
    """
    column = Window.partitionBy("g")
    sized = columns.select("g", "node", "root", "n", F.count(F.lit(1)).over(column).alias("m"), F.min("root").over(column).alias("low"), F.max("root").over(column).alias("high")).where("low < high")
    blocks = F.when(F.col("m") <= rows, 1).otherwise(F.ceil(2 * F.col("m") / rows)).cast("int")
    entries = sized.select("g", "node", "root", "n", blocks.alias("blocks")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(parities, "node")
    dealt = entries.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("g", F.least("block", "to").alias("low"), F.greatest("block", "to").alias("high"), "block", "node", "root", "n", "parity")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    once = (x("block") < y("block")) | ((x("low") == y("high")) & (x("node") < y("node")))
    fits = 100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))
    met = dealt.alias("x").join(dealt.alias("y"), (x("g") == y("g")) & (x("low") == y("low")) & (x("high") == y("high")) & once & (x("root") != y("root")) & fits
                                & _few(x("n"), y("n"), x("parity"), y("parity"), percent))
    ordered = x("node") < y("node")
    pair = met.select(F.least(x("node"), y("node")).alias("a"), F.greatest(x("node"), y("node")).alias("b"), F.when(ordered, x("n")).otherwise(y("n")).alias("n"),
                      F.when(ordered, y("n")).otherwise(x("n")).alias("n_"))
    counted = pair.groupBy("a", "b", "n", "n_").agg(F.count(F.lit(1)).alias("common"))
    # what two sets share beyond both prefixes lies behind the prefix that ends first
    behind = lambda n: F.ceil(n * percent / 100 - 1e-9) - 1  # noqa: E731  n - prefix_length(n)
    return counted.where(F.col("common") + F.greatest(behind(F.col("n")), behind(F.col("n_"))) >= need(F.col("n"), F.col("n_"), percent)).select("a", "b", "common")


def _merge(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after more links (a, b) between nodes of the components known so far."""
    if roots is None:
        return components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    known = links.join(roots.withColumnsRenamed({"node": "a", "root": "u"}), "a", "left").join(roots.withColumnsRenamed({"node": "b", "root": "v"}), "b", "left") \
        .select(F.coalesce("u", "a").alias("u"), F.coalesce("v", "b").alias("v"))
    joined = materialize(components(known).select(F.col("node").alias("root"), F.col("root").alias("top")), "joined")
    every = roots.unionByName(joined.select(F.col("root").alias("node"), "root")).distinct()
    return every.join(joined, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def join_documents(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, rows: int = ROWS, rounds: int = ROUNDS, cells: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    A to Z count as their lower-case letters. A text of fewer than ``k`` words is one shingle; one without words, NULL
    included, has none, is linked with nothing and has its own doc_id for a component. Rows are sets, whatever their
    doc_id: a doc_id with two texts is in the components of both, and a row without a doc_id links others but names none
    (its component is NULL if no row there has one). Repeated rows have the same result. Other columns are not read; an
    empty table gives no rows.
    """
    doc_id = F.col("doc_id").cast("long")
    source = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, "text").alias("th"), F.col("text"))
    classes, cells = frequency_classes(source, k, cells)
    signed = materialize(_signed(source, k), "sets")
    grouped = signed.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("low_id"), F.min("th").alias("th"), F.first("n").alias("n"), F.first("parity").alias("parity"))
    # ids are unique because they are read back from the table they were written to
    nodes = materialize(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    parities = nodes.select("node", "parity")
    # prefixes are cut twice instead of being written: they are several times as long as what is given out of them
    total = (nodes.agg(F.sum("n")).first()[0] or 0) * (100 - percent) // 100
    given = shared_prefixes(_prefixes(source, nodes, classes, cells, k, percent), total)
    once = given.groupBy("k1", "k2").agg(*[F.first(c).alias(c) for c in ("n", "columns", "places", "common")])
    shared = materialize(once.join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).drop("k1", "k2"), "columns")
    roots, tested = None, None
    round_ = 0
    while round_ <= rounds:
        rooted = shared.withColumn("root", F.col("node")) if roots is None else shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        columns = _entries(rooted)
        last = round_ == rounds
        pairs = (block_pairs(columns, parities, percent, rows) if last else pivot_pairs(columns, parities, round_, percent)).select("a", "b")
        pairs = materialize(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = None
        if not pairs.isEmpty():
            wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "k1", "k2", "th"), "node"), "ends")
            keys = wanted.select("node", "k1", "k2")
            keyed = pairs.join(keys.toDF("a", "a1", "a2"), "a").join(keys.toDF("b", "b1", "b2"), "b")
            # elements are long: they are shuffled by the keys of their sets once, and not written
            links = materialize(_linked(keyed, _full_sets(source, wanted, k), percent), "linked")
        if links is None or links.isEmpty():
            round_ = rounds + 1 if last else rounds  # other pivots would not help much: on to the blocks
            continue
        roots = materialize(_merge(roots, links), "roots")
        round_ += 1
    named = nodes.select("k1", "k2", "node", "low_id")
    named = named.withColumn("root", F.col("node")) if roots is None else named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    lowest = named.groupBy("root").agg(F.min("low_id").alias("component_id"))
    named = named.join(lowest, "root").select("k1", "k2", "component_id")
    found = signed.where("n > 0").join(named, ["k1", "k2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return found.unionByName(signed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


SQL = r"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY 1"""
