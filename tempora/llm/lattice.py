"""Language model scores by subword lattices.

A word is spelled by any sequence of pieces of a given vocabulary, closed by an end of word. Its spelling probability
is the sum over all segmentations, by a forward recursion in log space over the word's bytes. Words of the training
documents are one more arc each: from a word's start to its end with its discounted share of the training words; the
discount's mass goes to the spellings. A text is its words and an end. All of it is one distribution over texts.

Piece scores are estimated on the distinct training words by expectation-maximisation: a round takes every word's lattice
with the present scores, forward and backward, and adds up how often each piece is expected in it; these sums, one row a
piece, are the next scores. The first scores are frequencies in the words as cut by the vocabulary's own tokenizer, whose
file has merge ranks and no probabilities. Words of one length are taken together, one array operation an arc. Counts of the
most frequent WORDS words are sent to all tasks, with their scores; the occurrences of all other words, of which none
is frequent, meet their counts in a join. Every word of every document is so scored with its exact count.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tempora.session import materialize

#: Words whose counts are sent to every task.
WORDS = 200_000
#: Distinct words that a task counts before it hands its counts on.
HELD_WORDS = 500_000
#: Added to the count of every piece.
PIECE_COUNT = 0.5
#: Rounds of expectation-maximisation.
ROUNDS = 3
#: Words that are spelled together, and the fewest of one length and the longest (bytes) that share array operations.
POOL = 100_000
FEWEST = 30
LONGEST = 48
BASE = 0.1
_LN10 = math.log(10)


def default_pieces() -> str:
    import public_tokenizers as public

    return public.path("piece_bpe_32k.model")


def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


def arcs(path: str, counts: dict[int, int]) -> tuple[dict[bytes, float], float]:
    """Log probability of each piece by its bytes, a blank standing for the start of a word, and of the end of word.

    ``counts``: occurrences of pieces by id, of ends of words under -1. Single bytes can always be spelled.
    """
    sp = _processor(path)
    weight: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        piece = bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in piece[1:]:
            weight[piece] = weight.get(piece, 0.0) + counts.get(i, 0) + PIECE_COUNT
    end = counts.get(-1, 0) + PIECE_COUNT
    total = math.log(sum(weight.values()) + end)
    return {p: math.log(w) - total for p, w in weight.items()}, math.log(end) - total


def spelling(word: bytes, pieces: dict[bytes, float], end: float, longest: int) -> float:
    """Log of the summed probability of all segmentations of a word."""
    s = b" " + word
    forward = [0.0]
    get, exp, log = pieces.get, math.exp, math.log
    for i in range(1, len(s) + 1):
        into = [forward[j] + p for j in range(max(0, i - longest), i) if (p := get(s[j:i])) is not None]
        top = max(into)
        forward.append(top + log(sum([exp(v - top) for v in into])) if len(into) > 1 else top)
    return forward[-1] + end


def expected(word: bytes, pieces: dict[bytes, float], longest: int) -> dict[bytes, float]:
    """How often each piece is expected in a word, over all its segmentations by their probability."""
    s = b" " + word
    arcs_ = [(j, i, p) for i in range(1, len(s) + 1) for j in range(max(0, i - longest), i) if (p := pieces.get(s[j:i])) is not None]
    forward, backward = np.full(len(s) + 1, -np.inf), np.full(len(s) + 1, -np.inf)
    forward[0] = backward[-1] = 0.0
    for j, i, p in arcs_:
        forward[i] = np.logaddexp(forward[i], forward[j] + p)
    for j, i, p in sorted(arcs_, reverse=True):
        backward[j] = np.logaddexp(backward[j], backward[i] + p)
    out: dict[bytes, float] = {}
    for j, i, p in arcs_:
        out[s[j:i]] = out.get(s[j:i], 0.0) + math.exp(forward[j] + p + backward[i] - forward[-1])
    return out


def _sum_exp(rows: list[np.ndarray]) -> np.ndarray:
    """Log of the sum of exponentials over the rows, of which one at least is finite in every column."""
    if len(rows) == 1:
        return rows[0]
    stacked = np.array(rows)
    top = stacked.max(0)
    return top + np.log(np.exp(stacked - top).sum(0))


class Lattices:
    """The lattices of many words at once. ``pieces`` are found by a 64-bit hash of their bytes."""

    def __init__(self, pieces: dict[bytes, float]):
        self.pieces, self.longest = pieces, max(map(len, pieces))
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.scores = np.append(np.array(list(pieces.values()))[self.order], -np.inf)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[keys >> np.uint64(44)] = True

    @staticmethod
    def _step(key, byte):
        # odd factors keep every bit; the shift brings high bits down, so that long pieces do not lose their first bytes
        key = (key ^ byte) * np.uint64(0x9E3779B97F4A7C15)
        return key ^ (key >> np.uint64(29))

    @classmethod
    def _key(cls, piece: bytes) -> np.uint64:
        key = np.zeros(1, np.uint64)
        for b in piece:
            key = cls._step(key, np.uint64(b + 1))
        return key[0]

    def _arcs(self, text: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """The places in ``keys`` of the pieces from j to i in the rows of ``text``, -1 for none; arcs without any are left out."""
        out, size = {}, text.shape[0]
        wide = text.astype(np.uint64) + np.uint64(1)
        for j in range(size):
            key = np.zeros(text.shape[1], np.uint64)
            for i in range(j + 1, min(size, j + self.longest) + 1):
                key = self._step(key, wide[i - 1])
                hit = np.flatnonzero(self.maybe[key >> np.uint64(44)])
                if not len(hit):
                    continue
                at = np.minimum(np.searchsorted(self.keys, key[hit]), len(self.keys) - 1)
                same = self.keys[at] == key[hit]
                if same.any():
                    place = np.full(len(key), -1, np.int32)
                    place[hit[same]] = at[same]
                    out[j, i] = place
        return out

    def _groups(self, words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray | None]]:
        """Places of words of one length with their bytes, a row a position; None where they are taken one by one."""
        by_size: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_size.setdefault(len(w), []).append(k)
        for size, own in by_size.items():
            if size > LONGEST or len(own) < FEWEST:
                yield own, None
            else:
                for k in range(0, len(own), 10_000):
                    part = own[k:k + 10_000]
                    yield part, np.frombuffer(b"".join([b" " + words[i] for i in part]), np.uint8).reshape(len(part), size + 1).T

    def _forward(self, arcs_: dict[tuple[int, int], np.ndarray], size: int, width: int) -> list[np.ndarray]:
        forward = [np.zeros(width)]
        for i in range(1, size + 1):
            forward.append(_sum_exp([forward[j] + self.scores[arcs_[j, i]] for j in range(max(0, i - self.longest), i) if (j, i) in arcs_]))
        return forward

    def spelled(self, words: list[bytes], end: float) -> np.ndarray:
        """Log probability of the spellings of each word."""
        out = np.empty(len(words))
        for own, text in self._groups(words):
            out[own] = [spelling(words[k], self.pieces, end, self.longest) for k in own] if text is None \
                else self._forward(self._arcs(text), *text.shape)[-1] + end
        return out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """How often each piece, in the order of ``pieces``, is expected in all words together."""
        total = np.zeros(len(self.pieces))
        index = None
        for own, text in self._groups(words):
            if text is None:
                index = index or {p: k for k, p in enumerate(self.pieces)}
                for k in own:
                    for p, n in expected(words[k], self.pieces, self.longest).items():
                        total[index[p]] += n
                continue
            size, width = text.shape
            arcs_ = self._arcs(text)
            forward = self._forward(arcs_, size, width)
            backward = [np.zeros(width)] * (size + 1)
            for j in range(size - 1, -1, -1):
                rows = [backward[i] + self.scores[arcs_[j, i]] for i in range(j + 1, min(size, j + self.longest) + 1) if (j, i) in arcs_]
                backward[j] = _sum_exp(rows)
            for (j, i), place in arcs_.items():
                hit = np.flatnonzero(place >= 0)
                at = place[hit]
                share = np.exp(forward[j][hit] + self.scores[at] + backward[i][hit] - forward[-1][hit])
                total[self.order] += np.bincount(at, share, len(total))
        return total


class Model:
    """The counts that turn a word's count and spelling into probabilities."""

    def __init__(self, tokens: int, ends: int, types: int, once: int, twice: int):
        self.tokens, self.words, self.ends = tokens, tokens - ends, ends
        self.types = types + (ends > 0)
        self.discount = once / (once + 2 * twice) if once and twice else 0.5
        self.spelled = self.discount * types / self.words if self.words else 1.0
        self.end = (ends + 0.5) / (tokens + 1)

    def base(self, count: int) -> float:
        return math.log10((count + BASE) / (self.tokens + BASE * (self.types + 1)))

    def score(self, count: int, spelled: float) -> float:
        """log10 of a word's probability; in log space, as a long word's spelling may be below the smallest number."""
        low = math.log(self.spelled) + spelled
        if count > self.discount:
            seen = math.log((count - self.discount) / self.words)
            low = max(low, seen) + math.log1p(math.exp(-abs(low - seen)))
        return (math.log1p(-self.end) + low) / _LN10

    def end_score(self) -> float:
        return math.log10(self.end)


def _learns(doc_id) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 != 0


def _count(docs: DataFrame) -> DataFrame:
    """(word, count, seen) of all words: occurrences in training documents, and in all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: Counter = Counter()
        held: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            every = list(learned.keys() | held.keys())
            for k in range(0, len(every), 50_000):
                part = every[k:k + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part, pa.binary()).cast(pa.string()), pa.array([learned[w] for w in part], pa.int64()),
                     pa.array([learned[w] + held[w] for w in part], pa.int64())], ["word", "count", "seen"])
            learned.clear()
            held.clear()

        for batch in batches:
            for text, learns in zip(batch.column("text"), batch.column("learns").to_pylist()):
                (learned if learns else held).update((text.as_py() or "").encode().lower().split())
                if len(learned) + len(held) > HELD_WORDS:
                    yield from out()
        yield from out()

    return docs.select("text", "learns").mapInArrow(run, "word string, count long, seen long") \
        .groupBy("word").agg(F.sum("count").alias("count"), F.sum("seen").alias("seen"))


def _piece_counts(words: DataFrame, path: str) -> dict[int, int]:
    """Occurrences of pieces in the distinct training words, by id; as many rows as the vocabulary has pieces.

    Words count once, as spellings stand for words not seen before, which rare words resemble more than frequent ones.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp, total = _processor(path), Counter()
        for batch in batches:
            for ids in sp.encode(batch.column("word").to_pylist(), num_threads=1):
                total.update(ids)
            total[-1] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["piece", "n"])

    rows = words.where("count > 0").select("word").mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    return {r["piece"]: r["n"] for r in rows}


def _pools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= POOL:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _words(column: pa.ChunkedArray) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def reestimate(words: DataFrame, pieces: dict[bytes, float]) -> tuple[dict[bytes, float], float]:
    """Scores of pieces and of the end after one round over the distinct training words; the driver gets one row a piece."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, n = Lattices(shared.value), 0
        total = np.zeros(len(shared.value))
        for pool in _pools(batches):
            total += lattices.expected(_words(pool.column("word")))
            n += pool.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.float64())], ["piece", "n"])

    # sums in a fixed order of digits: reruns agree whatever order the parts come in
    n = F.sum(F.round(F.col("n") * 2.0**20).cast("long"))
    rows = words.where("count > 0").select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg((n / 2.0**20).alias("n")).collect()
    found = {r["piece"]: r["n"] for r in rows}
    weight = {p: found.get(k, 0.0) + PIECE_COUNT for k, p in enumerate(pieces)}
    end = found.get(-1, 0.0) + PIECE_COUNT
    total = math.log(sum(weight.values()) + end)
    return {p: math.log(w) - total for p, w in weight.items()}, math.log(end) - total


def _spelled(words: DataFrame, pieces: dict[bytes, float], end: float) -> DataFrame:
    """The words with ``spelled``."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(shared.value)
        for pool in _pools(batches):
            values = lattices.spelled(_words(pool.column("word")), end)
            yield from pool.append_column("spelled", pa.array(values, pa.float64())).combine_chunks().to_batches(10_000)

    return words.mapInArrow(run, "word string, count long, seen long, spelled double")


def score(docs: DataFrame, pieces_path: str | None = None, frequent: int = WORDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    NULL text counts as empty: its one token is the end. A NULL doc_id counts as the empty text in the split. Repeated
    rows count each. Other columns are not read; an empty table gives no rows.
    """
    path = pieces_path or default_pieces()
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _learns(F.col("doc_id")).alias("learns"))
    words = materialize(_count(source), "words")
    ends = source.where("learns").count()
    seen = words.where("count > 0").agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*"), F.count_if(F.col("count") == 1), F.count_if(F.col("count") == 2)).first()
    model = Model(seen[0] + ends, ends, *seen[1:])
    pieces, end = arcs(path, _piece_counts(words, path))
    for _ in range(rounds):
        pieces, end = reestimate(words, pieces)
    spelled = materialize(_spelled(words, pieces, end), "spelled")
    top = {r["word"].encode(): (int(r["count"] > 0), model.base(r["count"]), model.score(r["count"], r["spelled"]))
           for r in spelled.orderBy(F.col("seen").desc(), "word").limit(frequent).toLocalIterator()}
    shared = spark.sparkContext.broadcast(top)
    last = (int(ends > 0), model.base(ends), model.end_score())
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("word", pa.string()), ("n", pa.int64()),
                        ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, uid = shared.value, TaskContext.get().partitionId() << 40

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

        for batch in batches:
            rows: list[tuple] = []
            for doc, text, learns in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("learns").to_pylist()):
                total, (known, base, score_) = 1, last
                for w, n in Counter((text.as_py() or "").encode().lower().split()).items():
                    total += n
                    if (found := table.get(w)) is None:
                        rows.append((uid, None, None, w.decode(), n, None, None, None))
                    else:
                        known += n * found[0]
                        base += n * found[1]
                        score_ += n * found[2]
                rows.append((uid, doc, not learns, None, total, known, base, score_))
                uid += 1
                if len(rows) > 50_000:
                    yield out(rows)
                    rows = []
            if rows:
                yield out(rows)

    scored = materialize(source.mapInArrow(run, "uid long, doc_id long, held_out boolean, word string, n long, n_known long, base double, score double"), "scores")
    m = model
    count = F.col("count")
    base = F.log10((count + BASE) / (m.tokens + BASE * (m.types + 1)))
    low = F.lit(math.log(m.spelled)) + F.col("spelled") if m.spelled > 0 else F.lit(-math.inf)
    high = F.log((count - m.discount) / max(1, m.words))
    one = (F.when(count > m.discount, F.greatest(low, high) + F.log1p(F.exp(-F.abs(low - high)))).otherwise(low) + math.log1p(-m.end)) / _LN10
    rare = scored.where("word IS NOT NULL").select("uid", "word", "n").join(spelled.select("word", "count", "spelled"), "word") \
        .groupBy("uid").agg(F.sum(F.when(count > 0, F.col("n")).otherwise(0)).alias("r_known"), F.sum(F.col("n") * base).alias("r_base"), F.sum(F.col("n") * one).alias("r_score"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored.where("word IS NULL").drop("word").join(rare, "uid", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("n_known") + zero("r_known")).alias("n_known"),
        F.lit(m.tokens).cast("long").alias("train_tokens"), (F.col("base") + zero("r_base")).alias("base_score"), (F.col("score") + zero("r_score")).alias("score"))
