"""Document fingerprints: threshold-scaled sketches of five-word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash space, so sketches of long and short documents
are samples of one and the same random set of shingles: they merge by union, and the share of one sketch found in
another estimates how much of one document the other contains, however unequal they are. The smallest hash is kept
as well; it decides only where no hash of either text lies below the threshold.

A fingerprint is a string of 16 hexadecimal digits for each hash, ascending. A text without words has the empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tempora.llm.hashing import parts, shingles, slices

SHINGLE = 5
#: Fraction of all shingle hashes that a sketch keeps.
FRACTION = 1 / 8


def _threshold(fraction: float) -> np.uint64:
    return np.uint64(min(int(fraction * 2.0**64), (1 << 64) - 1))


def sketches(texts: pa.Array, fraction: float = FRACTION, k: int = SHINGLE) -> list[np.ndarray]:
    """The kept hashes of each text, ascending and distinct; NULL is empty."""
    h, n = shingles(texts, k)
    limit, out = _threshold(fraction), []
    for own in parts(h, n):
        kept = np.unique(own[own < limit])
        out.append(kept if len(kept) or not len(own) else own.min(keepdims=True))
    return out


def to_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def from_text(fingerprint: str | None) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint or ""), ">u8").astype(np.uint64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the shingle sets; 1 for two empty sketches, 0 if only one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def merge(sketches_: list[np.ndarray], fraction: float = FRACTION) -> np.ndarray:
    """The sketch of all texts together, from their sketches."""
    every = np.unique(np.concatenate([np.empty(0, np.uint64), *sketches_]))
    kept = every[every < _threshold(fraction)]
    return kept if len(kept) else every[:1]


def fingerprint(docs: DataFrame, id_: str = "doc_id", text: str = "text", fraction: float = FRACTION,
                k: int = SHINGLE) -> DataFrame:
    """(id, fingerprint) of every row; other columns are not read. NULL text counts as empty."""
    source = docs.select(F.col(id_).alias("id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                prints = [to_text(s) for s in sketches(part.column("text"), fraction, k)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(prints, pa.string())], ["id", "fingerprint"])

    schema = StructType([StructField("id", source.schema["id"].dataType), StructField("fingerprint", StringType())])
    return source.mapInArrow(run, schema).withColumnRenamed("id", id_)


EDITS = StructType([StructField("doc_id", LongType()), StructField("n_chars", LongType()),
                    StructField("edited_sha256", StringType()), StructField("fingerprint", StringType()),
                    StructField("edited_fingerprint", StringType()), StructField("near_edited", DoubleType()),
                    StructField("near_next", DoubleType()), StructField("contained_edited", DoubleType()),
                    StructField("contained_next", DoubleType())])


def _edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[:len(text) - k] + following[:k]


def _compare(rows: list[tuple], fraction: float, k: int) -> pa.RecordBatch:
    """Rows (doc_id, text, own sketch, next text, next sketch) compared with their edited text and the next one."""
    changed = [_edited(text, following) for _, text, _, following, _ in rows]
    out = []
    for (doc, text, own, _, after), edit, edited in zip(rows, changed, sketches(pa.array(changed, pa.large_string()), fraction, k)):
        out.append((doc, len(text), hashlib.sha256(edit.encode()).hexdigest(), to_text(own), to_text(edited),
                    likeness(own, edited), likeness(own, after), containment(own, edited), containment(own, after)))
    return pa.RecordBatch.from_pydict({f.name: list(c) for f, c in zip(EDITS, zip(*out))}, pa.schema(
        [(f.name, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[f.dataType.typeName()]) for f in EDITS]))


def fingerprint_edits(docs: DataFrame, fraction: float = FRACTION, k: int = SHINGLE) -> DataFrame:
    """Each row's fingerprint against those of its edited text and of the next row in descending doc_id.

    The edited text replaces the last third of the code points by the first ones of the next text; the last row is
    followed by the first. Rows are cut into ranges of doc_id at ids that occur, so a range is followed by the row at
    the next range's upper end, and only that row is sent twice. Texts are shuffled once.

    NULL text counts as empty. Rows with one doc_id follow each other in the order of a hash of their text, NULL ids
    come last. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = source.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] + [1.0], max(10_000, 20 * n)).alias("cuts"),
                     F.max("doc_id").alias("top")).first()
    cuts = sorted({*(cut["cuts"] or ()), *([] if cut["top"] is None else [cut["top"]])})
    # a row at a cut is the highest of its range and follows the last row of the range above; the very first follows the last
    up = {c: (i + 1) % len(cuts) for i, c in enumerate(cuts)}
    edges = np.array(cuts, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            of = np.searchsorted(edges, ids.fill_null(edges[0] if len(edges) else 0).to_numpy(zero_copy_only=False))
            again = [(i, up[v]) for i, v in enumerate(ids.to_pylist()) if v in up]
            rows = pa.array([*range(batch.num_rows), *(i for i, _ in again)], pa.int64())
            out = batch.take(rows)
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array([*of.tolist(), *(r for _, r in again)], pa.int32()),
                 pa.array([False] * batch.num_rows + [True] * len(again))], ["doc_id", "text", "range", "guest"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, place, head, done = None, None, None, False
        for batch in batches:
            for part in slices(batch, "text"):
                rows, own = [], sketches(part.column("text"), fraction, k)
                columns = [part.column(c).to_pylist() for c in ("doc_id", "text", "range", "guest")]
                for doc, text, range_, guest, sketch in zip(*columns, own):
                    if range_ != place:
                        if waiting and not done:
                            rows.append((*waiting, *head))
                        waiting, place, head, done = None, range_, (text, sketch), False
                    if waiting and not done:
                        rows.append((*waiting, text, sketch))
                    done = done or guest
                    if not guest:
                        waiting = (doc, text, sketch)
                if rows:
                    yield _compare(rows, fraction, k)
        if waiting and not done:
            yield _compare([(*waiting, *head)], fraction, k)

    dealt = source.mapInArrow(deal, "doc_id long, text string, range int, guest boolean") if cuts else \
        source.withColumns({"range": F.lit(0), "guest": F.lit(False)})
    order = [F.col("range"), F.col("guest"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    return dealt.repartitionById(max(1, len(cuts)), F.col("range")).sortWithinPartitions(*order).mapInArrow(compare, EDITS)
