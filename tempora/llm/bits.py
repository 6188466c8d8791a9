"""Bit tables of a bounded size that tell tasks which keys may matter.

A table has 2**b bits; a key sets the bit that its hash names. Tasks get the whole table, at most MAX_BITS / 8 bytes
whatever the input. Beyond that load more keys share bits: more rows pass, none is lost, and the results, which an
exact step makes afterwards, stay the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

MAX_BITS = 1 << 29
#: Bits of a row of the distributed form.
BLOCK = 1 << 16


def bits_for(expected: float) -> int:
    """Bits for so many keys at a load of about an eighth; a power of two from one block to MAX_BITS."""
    return int(min(MAX_BITS, max(BLOCK, 1 << int(np.ceil(np.log2(max(1.0, 8 * expected)))))))


def gather(blocks: DataFrame, n_bits: int, rows: int = 1) -> Broadcast:
    """Blocks (block, bits) as one broadcast table of rows x n_bits bits, in bytes of eight."""
    out = np.zeros(rows * n_bits // 8, np.uint8)
    for row in blocks.toLocalIterator():
        at = row["block"] * (BLOCK // 8)
        out[at:at + BLOCK // 8] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return blocks.sparkSession.sparkContext.broadcast(out)


def present(table: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Whether the bits of the cells are set."""
    return (table[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _fold(pdf: pd.DataFrame) -> pd.DataFrame:
    on = np.zeros(BLOCK, np.uint8)
    on[pdf["cell"].to_numpy()] = 1
    return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [np.packbits(on, bitorder="little").tobytes()]})


def key_table(keys: DataFrame, hash_: Column, expected: float) -> tuple[Broadcast, int]:
    """The bit table of a hash column (long), and its number of bits."""
    n_bits = bits_for(expected)
    cells = keys.select(F.expr("0L").alias("_"), F.pmod(hash_, F.lit(n_bits)).alias("at")).select(
        F.floor(F.col("at") / BLOCK).cast("int").alias("block"), F.pmod("at", F.lit(BLOCK)).cast("int").alias("cell"))
    return gather(cells.distinct().groupBy("block").applyInPandas(_fold, "block int, bits binary"), n_bits), n_bits
