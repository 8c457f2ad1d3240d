"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of driver-side lookup tables (sources, vocabulary, ...) that may be turned into a broadcast.
BROADCAST_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@dataclass
class Guarded:
    """Rows of an operator under names that can't clash with its own: see ``guarded``."""

    rows: DataFrame
    names: list[tuple[str, str]]

    def restored(self, df: DataFrame, *results: Column) -> DataFrame:
        return df.select(*[F.col(inner).alias(outer) for inner, outer in self.names], *results)

    @property
    def columns(self) -> list[str]:
        return [inner for inner, _ in self.names]


def guarded(df: DataFrame, needed: Sequence[str], results: Sequence[str]) -> Guarded:
    """The columns in ``needed`` keep their names, all others get ones that no operator uses (``in_0_``, ...), whatever they
    were called. ``restored`` brings the names back; those that clash with ``results`` become ``x_in``, ``x_in_in``, ..."""
    taken = {c.lower() for c in df.columns} | {n.lower() for n in results}
    clash = {n.lower() for n in results}
    keep = {n.lower(): n for n in needed}
    inner, outer = [], []
    for i, c in enumerate(df.columns):
        inner.append(keep.pop(c.lower(), f"in_{i}_"))
        new = c
        if c.lower() in clash:
            while new.lower() in taken:
                new += "_in"
            taken.add(new.lower())
        outer.append(new)
    if keep:
        raise ValueError(f"no column {', '.join(keep.values())}")
    return Guarded(df.toDF(*inner), list(zip(inner, outer)))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share; a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = os.path.join(tempfile.gettempdir(), "loomtext-shared")
    return f"{root.rstrip('/')}/loomtext-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Writes df to the shared folder (with a folder for each value of ``by``) and rereads it: cuts lineage, survives lost
    executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    (df.write.partitionBy(by) if by else df.write).parquet(path, compression="zstd")
    return spark.read.schema(df.schema).parquet(path)


def released() -> None:
    """Gives memory that a Python worker no longer uses back to the system: workers stay for the next task."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def hashed_unit(seed: int, *cols: Column) -> Column:
    """A uniform number in [0, 1) of 52 bits from md5; the same in every engine that has md5."""
    return hex_number(F.md5(hash_text(seed, *cols)), 13) / F.lit(float(1 << 52))


def hash_text(seed: int, *cols: Column) -> Column:
    return F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])


def hex_number(digest: Column, digits: int) -> Column:
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")
