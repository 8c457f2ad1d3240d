"""Parquet tables, spread over the cores where a few small files would leave most of them idle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes for each core up to which a table of fewer files than cores is spread: so little is shuffled in no time. Larger tables,
#: and those of many files, are read as their row groups lie, without a shuffle.
SPREAD_BYTES = 32 << 20
LEAST_BYTES = 200 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A row group is read by one task; the rows of a small file that is one row group are dealt out in turn. Columns and
    filters are still pushed into the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores, files = spark.sparkContext.defaultParallelism, df.inputFiles()
    if not 0 < len(files) < cores:
        return df
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    size = sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in map(path, files))
    return df.repartition(cores) if LEAST_BYTES * len(files) <= size <= SPREAD_BYTES * cores else df
