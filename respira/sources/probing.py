"""Probes of files kept between runs, and streams of a huge table's rows by sets of ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respira.sources.readers import latest_version

STAMP = ["path", "length", "modified"]
#: Bits of an id filter, at most: a broadcast row of a megabyte. More ids than it is made for let more rows through, never fewer.
FILTER_BITS = 1 << 23


def refreshed_probes(listing: DataFrame, probe: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """listing (path, length, modified) with what probe found of each file, probing only files that are new or changed.

    Probes are kept below `folder`, one version a run, keyed by path, length and time of change; files that are gone
    leave with the next version. Nothing is rewritten: a run that fails leaves the version before. probe gets STAMP rows
    and gives them back with its columns.
    """
    spark = listing.sparkSession
    files = listing.select(*STAMP)
    before = latest_version(spark, folder)
    if before is None:
        full = probe(files)
    else:
        known = spark.read.parquet(before)
        fresh = probe(files.join(known.select(*STAMP), STAMP, "left_anti"))
        full = known.join(files, STAMP, "left_semi").unionByName(fresh)
    number = 0 if before is None else int(before.rpartition("=")[2]) + 1
    target = f"{folder.rstrip('/')}/version={number:09d}"
    full.write.mode("errorifexists").option("compression", "zstd").parquet(target)
    return spark.read.parquet(target)


def id_filter(ids: DataFrame, column: str, bits_per_id: int = 12) -> DataFrame:
    """One row: words (longs) of a filter of the ids, sized from their count, and how many words there are."""
    n = max(1, ids.count())
    words = min(FILTER_BITS, 1 << max(6, (n * bits_per_id - 1).bit_length())) // 64
    hashes = F.array(*(F.xxhash64(F.lit(k), F.col(column).cast("string")) for k in range(3)))
    set_bits = ids.filter(F.col(column).isNotNull()).select(F.explode(hashes).alias("h"))
    word, bit = F.pmod(F.shiftright("h", 6), F.lit(words).cast("long")), F.expr("shiftleft(1L, cast(h & 63 as int))")
    per = set_bits.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("bits"))
    filled = per.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("bits")).unionByName(per).groupBy("w").agg(F.bit_or("bits").alias("bits"))
    return filled.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "bits"))), lambda x: x["bits"]).alias("words"), F.count(F.lit(1)).alias("n_words"))


def may_be_in(rows: DataFrame, column: str, found: DataFrame) -> DataFrame:
    """rows whose id the filter may hold: all that are in the set, and hardly any else. No row is shuffled."""
    one = found.select(F.col("words").alias("__words"), F.col("n_words").alias("__n"))
    bit = lambda k: f"shiftright(element_at(__words, cast(pmod(shiftright(xxhash64({k}, cast(`{column}` as string)), 6), __n) + 1 as int)), cast(xxhash64({k}, cast(`{column}` as string)) & 63 as int)) & 1L = 1L"
    return rows.join(F.broadcast(one)).filter(" AND ".join([f"`{column}` IS NOT NULL", *map(bit, range(3))])).drop("__words", "__n")


def rows_of_ids(rows: DataFrame, ids: DataFrame, column: str, items: DataFrame | None = None, item: str = "itemid", columns: list[str] | None = None) -> DataFrame:
    """The rows whose id is among ids (and whose item is among items), with `columns` of them: exactly, duplicates of ids aside.

    The set of items, a catalogue, is filtered like the ids; then the exact semi-joins see only what filters let pass.
    """
    out = may_be_in(rows, column, id_filter(ids, column))
    if items is not None:
        out = may_be_in(out, item, id_filter(items, item)).join(items.select(item).distinct(), item, "left_semi")
    out = out.join(ids.select(column).distinct(), column, "left_semi")
    return out.select(*(columns or rows.columns))


def per_patient(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """A folder with a Parquet file (or folder) per patient as one table; `patient` is the name without prefix and ending."""
    rows = spark.read.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{folder.rstrip('/')}/{prefix}*")
    name = F.regexp_extract(F.input_file_name(), rf"/{prefix}([^/]*?)(?:\.parquet)?(?:/[^/]*)?$", 1)
    return rows.withColumn("patient", name)
