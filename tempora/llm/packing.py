"""Best-fit packing of tokenized documents into sequences by a grouping genetic algorithm on islands.

Pieces shorter than a sequence are dealt by hash into blocks of about BLOCK pieces. A block is a bin packing problem
of a bounded size that ISLANDS islands work on, each a row of its own that any task can take. An island's solutions
are lists of bins. Crossover injects well-filled bins of one parent whole into the other, removes the bins that share
pieces with them, and best-fits the displaced pieces, longest first. After each epoch an island's elite moves to the
next island through a join. A block is done as soon as its bins reach the least number that its tokens need.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tempora.session import materialize

LENGTH = 1024
END = 2
BLOCK = 4096
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 5
POPULATION = 4
#: Entries of a task's table from word to token ids; words beyond it are encoded each time.
KNOWN_WORDS = 300_000


class Encoder:
    """Ids of byte-level BPE as little-endian 32-bit values, by way of a table of words.

    A text is cut before each blank or line end that stands alone between other characters: pieces of the tokenizer's
    pattern never cross such a place, so the ids of the parts are the parts of the ids. Texts with other white space
    after a blank or line end are encoded whole. Texts that spell a token which the file adds to its vocabulary go to the
    tokenizer as it comes, which gives that token's id.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._known: dict[str, bytes] = {}
        self._fast = None

    def use_ranks(self, ranks_path: str, pattern: str) -> Encoder:
        """Encode by the same vocabulary given as ranks, which is faster."""
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return self

    def _encode(self, text: str) -> bytes:
        ids = self._fast.encode_ordinary(text) if self._fast else self._tokenizer.encode(text, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        ids = self._encode(word if word[:1] == "\n" else " " + word)
        if len(self._known) < KNOWN_WORDS:
            self._known[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        from re import search

        if any(t in text for t in self._added):
            return np.asarray(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if search(r"[ \n](?:\s|\Z)", text):
            return self._encode(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        known = self._known
        return b"".join([self._encode(first), *[known[w] if w in known else self._word(w) for w in rest]])


def default_encoder() -> Encoder:
    import public_tokenizers as public

    return Encoder(public.path("byte_bpe_50k.json")).use_ranks(public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    head = n % length
    return ([(0, head)] if head else []) + [(s, length) for s in range(head, n, length)]


def pieces(docs: DataFrame, length: int = LENGTH, make_encoder=default_encoder, with_ids: bool = False) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32[, ids]) of the pieces of every row; uid is unique in this run."""
    names = ["uid", "doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, uid = make_encoder(), TaskContext.get().partitionId() << 40
        end = array("I", [END]).tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = encoder.ids(text.as_py() or "") + end
                for i, (start, n) in enumerate(cut(len(ids) // 4, length)):
                    own = ids[4 * start:4 * (start + n)]
                    rows.append((uid, doc, i, start, n, zlib.crc32(own)) + (own,) * with_ids)
                    uid += 1
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    schema = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


class Solution:
    """Bins as lists of pieces, and their fill."""

    __slots__ = ("bins", "fill")

    def __init__(self, bins: list[list[int]], fill: list[int]):
        self.bins, self.fill = bins, fill

    def worth(self, length: int) -> tuple[int, int]:
        """Smaller is better: the number of bins, then how evenly they are filled."""
        return len(self.bins), -sum(f * f for f in self.fill) // length


def best_fit(solution: Solution, items: list[int], lengths: list[int], length: int) -> Solution:
    """Put the items into the bins that they fill up best, in the given order; new bins where none has room."""
    bins, fill = solution.bins, solution.fill
    with_room: list[list[int]] = [[] for _ in range(length + 1)]
    mask = 0
    for b, f in enumerate(fill):
        with_room[length - f].append(b)
        mask |= 1 << (length - f)
    for i in items:
        n = lengths[i]
        fitting = mask >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                mask ^= 1 << room
            bins[b].append(i)
            fill[b] += n
        else:
            room, b = length, len(bins)
            bins.append([i])
            fill.append(n)
        with_room[room - n].append(b)
        mask |= 1 << (room - n)
    return solution


def cross(a: Solution, b: Solution, lengths: list[int], length: int, rng: np.random.Generator) -> Solution:
    """Some of b's fullest bins whole, a's bins that share no piece with them, and the displaced pieces by best fit."""
    score = np.array(b.fill) + rng.random(len(b.fill)) * length * 0.1
    chosen = np.argsort(-score)[:max(1, int(len(b.bins) * rng.uniform(0.1, 0.4)))].tolist()
    taken = {i for c in chosen for i in b.bins[c]}
    bins, fill, displaced = [list(b.bins[c]) for c in chosen], [b.fill[c] for c in chosen], []
    worst = min(a.fill) + 1 if a.fill else 0
    for own, f in zip(a.bins, a.fill):
        if f <= worst or not taken.isdisjoint(own):
            displaced += [i for i in own if i not in taken]
        else:
            bins.append(list(own))
            fill.append(f)
    displaced.sort(key=lambda i: -lengths[i])
    return best_fit(Solution(bins, fill), displaced, lengths, length)


def evolve(lengths: list[int], length: int, elites: list[np.ndarray], seed: int, generations: int = GENERATIONS,
           population: int = POPULATION) -> tuple[np.ndarray, int]:
    """The bin of each piece in the best solution found, and its number of bins. elites: such arrays from before."""
    rng, n = np.random.default_rng(seed), len(lengths)
    least = -(-sum(lengths) // length)

    def decode(bin_of: np.ndarray) -> Solution:
        bins: list[list[int]] = [[] for _ in range(int(bin_of.max()) + 1 if n else 0)]
        for i, b in enumerate(bin_of.tolist()):
            bins[b].append(i)
        return Solution(bins, [sum(lengths[i] for i in own) for own in bins])

    pool = [decode(e) for e in elites]
    sizes = np.array(lengths, float)
    while len(pool) < population and not (pool and min(len(s.bins) for s in pool) <= least):
        noise = rng.normal(0, 0.03 * length, n) if pool or seed else np.zeros(n)
        pool.append(best_fit(Solution([], []), np.argsort(-(sizes + noise), kind="stable").tolist(), lengths, length))
    for _ in range(generations):
        pool.sort(key=lambda s: s.worth(length))
        if len(pool[0].bins) <= least or len(pool) < 2:
            break
        children = []
        for _ in range(population // 2):
            i, j = sorted(rng.choice(len(pool), 2, replace=False).tolist())
            children += [cross(pool[i], pool[j], lengths, length, rng), cross(pool[j], pool[i], lengths, length, rng)]
        pool = sorted(pool + children, key=lambda s: s.worth(length))[:population]
    best = min(pool, key=lambda s: s.worth(length))
    out = np.zeros(n, np.int32)
    for b, own in enumerate(best.bins):
        out[own] = b
    return out, len(best.bins)


def _epoch(islands: DataFrame, length: int, epoch: int) -> DataFrame:
    """(block, island, elite, bins) after an epoch, from (block, island, lengths, elites)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for block, island, lengths, elites in pdf.itertuples(index=False):
                own = [np.frombuffer(e, np.int32) for e in (elites if elites is not None else [])]
                elite, bins = evolve([int(v) for v in lengths], length, own, 1_000_003 * int(block) + 101 * epoch + int(island))
                rows.append((block, island, elite.tobytes(), bins))
            yield pd.DataFrame(rows, columns=["block", "island", "elite", "bins"])

    return islands.select("block", "island", "lengths", "elites").mapInPandas(run, "block int, island int, elite binary, bins int")


def pack(docs: DataFrame, length: int = LENGTH, make_encoder=default_encoder, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of all pieces of all rows.

    NULL text counts as empty: one piece that holds the end token. Repeated rows are documents each. Only documents
    longer than a sequence are cut. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut_ = materialize(pieces(docs, length, make_encoder, with_ids), "pieces")
    short = cut_.where(F.col("length") < length).select("uid", F.col("length").cast("int").alias("length"))
    n_blocks = max(1, -(-short.count() // BLOCK))
    blocks = short.groupBy(F.pmod(F.xxhash64("uid"), F.lit(n_blocks)).cast("int").alias("block")) \
        .agg(F.sort_array(F.collect_list(F.struct("length", "uid"))).alias("items")) \
        .select("block", F.col("items.uid").alias("uids"), F.col("items.length").alias("lengths"))
    # blocks are few and their work is long: one task for every few of them
    tasks = max(1, min(n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    blocks = materialize(blocks, "blocks")
    islands = blocks.select("block", "lengths", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    elites = None
    for epoch in range(EPOCHS):
        if elites is None:
            ready = islands.withColumn("elites", F.array().cast("array<binary>"))
        else:
            # an island starts from its own elite and its neighbour's
            sent = elites.select("block", F.explode(F.array("island", ((F.col("island") + 1) % ISLANDS))).alias("island"), "elite") \
                .groupBy("block", "island").agg(F.collect_list("elite").alias("elites"))
            ready = islands.join(sent, ["block", "island"])
        elites = materialize(_epoch(ready.repartition(tasks * ISLANDS, "block", "island"), length, epoch), "elites")
    best = elites.groupBy("block").agg(F.min(F.struct("bins", "island", "elite"))["elite"].alias("elite"))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for block, uids, lengths, elite in pdf.itertuples(index=False):
                bin_of, n = np.frombuffer(elite, np.int32), np.asarray(lengths, np.int64)
                order = np.argsort(bin_of, kind="stable")
                ends = np.cumsum(n[order])
                begin = ends - n[order]
                new = np.r_[True, np.diff(bin_of[order]) != 0] if len(order) else np.empty(0, bool)
                offset = begin - begin[new][np.cumsum(new) - 1]
                yield pd.DataFrame({"uid": np.asarray(uids)[order], "sequence_id": (int(block) << 24) + bin_of[order].astype(np.int64), "offset": offset})

    placed = blocks.join(best, "block").select("block", "uids", "lengths", "elite").mapInPandas(place, "uid long, sequence_id long, offset long")
    out = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] + ["ids"] * with_ids
    whole = cut_.where(F.col("length") == length).withColumns({"sequence_id": -F.col("uid") - 1, "offset": F.lit(0).cast("long")})
    return cut_.where(F.col("length") < length).join(placed, "uid").select(*out).unionByName(whole.select(*out))
