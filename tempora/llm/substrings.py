"""Removal of long passages that an earlier document has too, behind a count-min prefilter.

A window is WINDOW consecutive words of one document. A word goes if a window that covers it also starts in a
document with a smaller doc_id. Three passes over the texts, each a scan:

1. Every window names an anchor: the ANCHOR-word run with the smallest hash inside it. Equal windows have equal
   anchors, so an anchor's count bounds the count of each window that names it, and there are about
   2 / (WINDOW - ANCHOR + 2) anchors a word instead of one window a word. Tasks count the documents of their anchors
   in count-min rows, sparse and saturated at two; the sketches of all tasks are added up block by block. What goes
   back to the tasks is one bit a cell, set at two or more: at most ROWS * MAX_BITS bits.
2. Windows whose anchor is estimated repeated in every row are grouped exactly, by 128 bits of hash of their words,
   to the smallest document. A window missed here would need a count below its anchor's, which count-min never gives.
3. The same windows meet the repeated ones again; what starts in a later document is removed from its text. Only
   documents that lose words are shuffled with their texts, found by a bounded bit table and an exact join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tempora.llm.bits import BLOCK, bits_for, gather, key_table, present
from tempora.llm.hashing import mix, sequence_keys, sliding, slices, windows, word_hashes
from tempora.session import materialize

WINDOW = 50
ANCHOR = 16
#: Rows of the count-min sketch.
ROWS = 2
_SECOND = 0xA24BAED4963EE407


def _anchors(h: np.ndarray, at: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """The anchor of each window: the smallest anchor hash inside it."""
    if not len(at):  # the words of all texts together may be fewer than a window
        return np.empty(0, np.uint64)
    low, span = sliding(h, anchor), window - anchor + 1
    width = 1
    while 2 * width <= span:
        n = len(low) - width
        low = np.minimum(low[:n], low[width:])
        width *= 2
    # two overlapping runs of a power of two cover the span
    return np.minimum(low[at], low[at + span - width])


def _cells(anchors: np.ndarray, row: int, n_bits: int) -> np.ndarray:
    return mix(anchors + np.uint64((row + 1) * _SECOND & (1 << 64) - 1)) & np.uint64(n_bits - 1)


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    """Add the sketches of one block up; keep which cells reach two."""
    total = np.zeros(BLOCK, np.uint8)
    for once, more in zip(pdf["once"], pdf["more"]):
        own = np.frombuffer(once, np.uint16)
        total[own] = np.minimum(total[own] + 1, 2)
        total[np.frombuffer(more, np.uint16)] = 2
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [np.packbits(total >= 2, bitorder="little").tobytes()]})


def repeated_anchors(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, n_bits: int | None = None):
    """Broadcast bits of the count-min cells that reach two documents, and the bits of a row."""
    if n_bits is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_bits = bits_for(size / 6 * 2 / (window - anchor + 2))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[list[np.ndarray]] = [[] for _ in range(ROWS)]

        def sketch() -> Iterator[pa.RecordBatch]:
            for row, cells in enumerate(seen):
                if not cells:
                    continue
                cell, n = np.unique(np.concatenate(cells), return_counts=True)
                cells.clear()
                block = (cell // BLOCK).astype(np.int64)
                cuts = np.flatnonzero(np.diff(block)) + 1
                out: dict = {"block": [], "once": [], "more": []}
                for own, times in zip(np.split(cell, cuts), np.split(n, cuts)):
                    low = (own % BLOCK).astype(np.uint16)
                    out["block"].append(int(own[0] // BLOCK) + row * n_bits // BLOCK)
                    out["once"].append(low[times == 1].tobytes())
                    out["more"].append(low[times > 1].tobytes())
                yield pa.RecordBatch.from_pydict(out, pa.schema([("block", pa.int32()), ("once", pa.binary()), ("more", pa.binary())]))

        held = 0
        for batch in batches:
            for part in slices(batch, "text"):
                h, counts = word_hashes(part.column("text"))
                at, n = windows(counts, window)
                named = _anchors(h, at, window, anchor)
                if not len(named):
                    continue
                doc = np.repeat(np.arange(len(n)), n)
                new = np.ones(len(named), bool)
                new[1:] = (named[1:] != named[:-1]) | (doc[1:] != doc[:-1])
                named, doc = named[new], doc[new]
                order = np.lexsort((named, doc))
                named, doc = named[order], doc[order]
                new = np.ones(len(named), bool)
                new[1:] = (named[1:] != named[:-1]) | (doc[1:] != doc[:-1])
                for row in range(ROWS):
                    seen[row].append(_cells(named[new], row, n_bits).astype(np.uint32))
                held += int(new.sum())
            if held > 4_000_000:
                yield from sketch()
                held = 0
        yield from sketch()

    blocks = docs.select("text").mapInArrow(count, "block int, once binary, more binary") \
        .groupBy("block").applyInPandas(_merge, "block int, bits binary")
    return gather(blocks, n_bits, ROWS), n_bits


def _candidates(docs: DataFrame, bits, n_bits: int, window: int, anchor: int) -> DataFrame:
    """(h1, h2, doc_id, row_key, start) of the windows whose anchor is estimated repeated."""
    schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("row_key", pa.int64()), ("start", pa.int32())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = bits.value
        for batch in batches:
            for part in slices(batch, "text"):
                h, counts = word_hashes(part.column("text"))
                at, n = windows(counts, window)
                named = _anchors(h, at, window, anchor)
                hit = np.ones(len(named), bool)
                for row in range(ROWS):
                    hit &= present(table[row * n_bits // 8:(row + 1) * n_bits // 8], _cells(named, row, n_bits))
                if not hit.any():
                    continue
                other, _ = word_hashes(part.column("text"), 1)
                doc = np.repeat(np.arange(len(n)), n)[hit]
                at = at[hit]
                start = at - (np.cumsum(counts) - counts)[doc]
                key = sequence_keys(h, counts)[0].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sliding(h, window)[at].view(np.int64)), pa.array(sliding(other, window, _SECOND)[at].view(np.int64)),
                     part.column("doc_id").take(pa.array(doc)), pa.array(key[doc]), pa.array(start.astype(np.int32))],
                    schema=schema)

    return docs.mapInArrow(find, "h1 long, h2 long, doc_id long, row_key long, start int")


def _covered(n: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of n words lie in a window with one of the starts."""
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + window, n), -1)
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, n_bits: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row: its text without the words that earlier documents have.

    NULL text has no words. Rows with one doc_id are one document to each other: they lose nothing to themselves and
    the same to documents before them. A NULL doc_id comes after all others. Windows that repeat within one document
    only stay. Other columns are not read; an empty table gives no rows.
    """
    last = (1 << 63) - 1
    source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bits, n_bits = repeated_anchors(source, window, anchor, n_bits)
    candidates = _candidates(source, bits, n_bits, window, anchor)
    repeated = materialize(candidates.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                           .where("first < last").drop("last"), "windows")
    later = materialize(
        candidates.join(repeated, ["h1", "h2"]).where(F.col("doc_id") > F.col("first"))
        .groupBy("doc_id", "row_key").agg(F.collect_list("start").alias("starts")), "removals")
    losing, cells = key_table(later, F.xxhash64("doc_id"), later.count())

    def finish(rows: list[tuple], kept: Iterator[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.int64()), pa.array(kept, pa.large_string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                words = [t.encode().split() for t in texts]
                yield finish([(i, len(w), 0) for i, w in zip(ids, words)], [b" ".join(w).decode() for w in words])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = losing.value
        for batch in batches:
            hit = present(table, batch.column("hash").to_numpy().view(np.uint64) % np.uint64(cells))
            for part in slices(batch.filter(pa.array(hit)), "text"):
                h, counts = word_hashes(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text"), pa.array(sequence_keys(h, counts)[0].view(np.int64))], ["doc_id", "text", "row_key"])

    def unmarked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = losing.value
        for batch in batches:
            hit = present(table, batch.column("hash").to_numpy().view(np.uint64) % np.uint64(cells))
            yield from whole(iter([batch.filter(pa.array(~hit))]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows, kept = [], []
                for doc, text, starts in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "starts"))):
                    words = text.encode().split()
                    gone = _covered(len(words), np.array(starts or [], np.int64), window)
                    rows.append((doc, len(words), int(gone.sum())))
                    kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g]).decode())
                yield finish(rows, kept)

    hashed = source.withColumn("hash", F.xxhash64("doc_id"))
    out = "doc_id long, n_words long, n_removed long, kept_text string"
    clean = hashed.mapInArrow(unmarked, out)
    touched = hashed.mapInArrow(marked, "doc_id long, text string, row_key long").join(later, ["doc_id", "row_key"], "left") \
        .select("doc_id", "text", "starts").mapInArrow(cut, out)
    return clean.unionByName(touched).withColumn("doc_id", F.nullif("doc_id", F.lit(last)))


def digest(kept: DataFrame) -> DataFrame:
    """The result with the SHA-256 of the kept text in its place."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: The rule word for word, on windows written out as text.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 49), ' ') AS win
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM w WHERE len(words) >= 50)),
f AS (SELECT md5(win) AS win, min(doc_id) AS first FROM s GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
r AS (SELECT doc_id, i FROM s JOIN f ON md5(s.win) = f.win AND doc_id > first),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM r),
a AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY 1)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN words
           ELSE [words[j] FOR j IN range(1, len(words) + 1) IF NOT list_contains(gone, j)] END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN a USING (doc_id)
"""
