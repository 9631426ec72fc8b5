"""Tables of bits of a fixed size that tell in advance what a join would drop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a table; it is broadcast (2 MB).
SIZE = 1 << 24

#: Rows of bits: a 32-bit word of the table and its bits.
BITS = "word long, bits long"


def bits_of(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    places = values % SIZE
    words, where = np.unique(places >> 5, return_inverse=True)
    bits = np.zeros(len(words), np.int64)
    np.bitwise_or.at(bits, where, np.int64(1) << (places & 31))
    yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits)], ["word", "bits"])


def bit_table(rows: DataFrame) -> Broadcast:
    """Rows of bits as one table, broadcast. Its size is fixed; a full one only lets more pass."""
    found = rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # at most SIZE / 32 rows
    table = np.zeros(SIZE >> 5, np.uint32)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return rows.sparkSession.sparkContext.broadcast(table)


def passes(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    places = values % SIZE
    return (table[places >> 5] >> (places & 31).astype(np.uint32) & 1).astype(bool)
