"""What the corpus operators share: reading tables, and cutting lineage in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handled at once inside Python workers; bounds their memory whatever Arrow's batch size is.
CHUNK_ROWS = 256
CHUNK_CHARS = 2_000_000
#: A table of facts that a join looks up is broadcast up to this many rows of a few numbers each.
LOOKUP_ROWS = 500_000
#: Shuffle files of a query go as soon as it has been written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: While a table is written: rows in a batch between the JVM and Python, so that long texts don't fill either.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_ROWS = 1000
_PATHS: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; where it is unset a session on one machine gets a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        found = "file://" + tempfile.mkdtemp(prefix="respira-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def write(df: DataFrame, path: str) -> None:
    """df as Parquet; its shuffle files are removed when it is written."""
    conf = df.sparkSession.conf
    before = {name: conf.get(name, None) for name in (CLEANUP, BATCH)}
    conf.set(CLEANUP, "true")
    conf.set(BATCH, str(min(BATCH_ROWS, int(before[BATCH] or BATCH_ROWS))))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def saved(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: later jobs survive lost executors and recompute nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/respira/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    write(df, path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def released(*tables: DataFrame) -> None:
    """Empties written tables that nothing reads any more. The rows of none come from the JVM: a list's would start Python workers of their own."""
    for df in tables:
        empty = df.sparkSession.range(0).select([F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
        empty.coalesce(1).write.mode("overwrite").parquet(_PATHS.pop(df))


def lookup(rows: DataFrame, facts: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """rows joined with facts, a written table with one row per key and few numbers in each.

    Up to LOOKUP_ROWS facts are broadcast, so rows stay where they are. Beyond it both sides are shuffled by the key, as a
    sort-merge join whose large partitions of rows adaptive execution splits.
    """
    small = facts.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    return rows.join(F.broadcast(facts) if small else facts.hint("shuffle_merge"), on, how)


def chunks(batches: Iterable[pd.DataFrame], text: str = "text") -> Iterator[pd.DataFrame]:
    """Batches cut so that no piece has over CHUNK_ROWS rows, nor (beyond one row) over CHUNK_CHARS characters of text.

    Without pandas' .str, which a column keeps and which keeps the column: batches would stay until Python collects cycles.
    """
    for pdf in batches:
        sizes = [len(t) if isinstance(t, str) else 0 for t in pdf[text]]
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and (i - start >= CHUNK_ROWS or total + size > CHUNK_CHARS):
                yield pdf.iloc[start:i].reset_index(drop=True)
                start, total = i, 0
            total += size
        if start < len(pdf):
            yield pdf.iloc[start:].reset_index(drop=True)


def text_bytes(value: object) -> bytes:
    return value.encode("utf-8", "surrogatepass") if isinstance(value, str) else b""


def id_crc(column: str = "doc_id"):
    """crc32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def lowest(df: DataFrame, rows: int) -> DataFrame:
    """`rows` rows of df at most, the lowest by a hash of doc_id: a bounded sample that any part of the data can be in.

    A first cut by the hash leaves a little more than that many, so that what is ordered doesn't grow with the data.
    """
    count = df.count()
    h = F.xxhash64("doc_id")
    if count > 2 * rows:
        df = df.filter(h < int(-(2**63) + 2**64 * min(1.0, (rows + 6 * rows**0.5) / count)))
    return df.orderBy(h, "doc_id").limit(rows)
