"""A Bloom filter of 64-bit keys as a Catalyst predicate: a size-bounded pre-filter in front of an exact join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a key, and the filter's largest size. Beyond it more rows pass; the join that follows stays exact.
BITS_PER_KEY = 12
MAX_BITS = 1 << 26
_HASHES = 3


def _places(key: Column, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(_HASHES)])


def build(keys: DataFrame, key: str, count: int) -> tuple[bytes, int]:
    """The filter of a column of keys, OR-ed byte by byte on the executors; at most MAX_BITS / 8 bytes come back."""
    bits = 1 << max(10, min(MAX_BITS, count * BITS_PER_KEY).bit_length())
    bits = min(bits, MAX_BITS)
    at = keys.filter(F.col(key).isNotNull()).select(F.explode(_places(F.col(key), bits)).alias("p"))
    # words of 64 bits, packed by task: the driver gets the filter's bytes and no row for each
    words = at.groupBy(F.expr("p div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    out = np.zeros(bits // 64, np.int64)
    for r in words.mapInArrow(_packed, "w binary, b binary").collect():
        out[np.frombuffer(r.w, np.int64)] = np.frombuffer(r.b, np.int64)
    return out.tobytes(), bits


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        yield pa.RecordBatch.from_arrays([pa.array([x.column(c).to_numpy().tobytes()]) for c in ("w", "b")], names=["w", "b"])


def may_contain(filter_: tuple[bytes, int], key: Column) -> Column:
    """False only for keys that the filter doesn't hold; null keys are not held."""
    data, bits = filter_
    lit = F.lit(data)
    hits = None
    for i in range(_HASHES):
        p = F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits))
        byte = F.conv(F.hex(F.substring(lit, (F.call_function("div", p, F.lit(8)) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        hit = F.call_function("shiftright", byte, (p % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
        hits = hit if hits is None else hits & hit
    return key.isNotNull() & hits
