"""Records of CSV files with line breaks inside quotes, read by many tasks a file.

Spark splits a file by bytes and hands out whole lines, but a line may begin inside
a quoted value. Whether it does follows from the parity of the quotes before it, as
an escaped quote is two quotes. So the parity is summed up twice: over the lines
of a split, and over the splits of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
_SPLIT = ("_file", "_block")


def _odd(count: Column) -> Column:
    return F.pmod(count, F.lit(2))


def _lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """Lines with their split, their order in it and their quotes."""
    raw = spark.read.option("lineSep", "\n").text(files)
    return raw.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
        F.col("value").alias("_line"),
        (F.length("value") - F.length(F.replace("value", F.lit(QUOTE), F.lit("")))).cast("long").alias("_quotes"),
    )


def _splits(lines: DataFrame) -> DataFrame:
    """For each split whether it begins inside quotes, and the records begun before it.

    The count of records begun in a split is known for either parity at its start,
    so one row a split is enough. A file that ends inside quotes stops the read.
    """
    counted = lines.groupBy(*_SPLIT).agg(
        F.sum("_quotes").alias("_quotes"),
        F.count_if(F.col("_odd") == 0).alias("_even_starts"),
        F.count_if(F.col("_odd") == 1).alias("_odd_starts"),
    )
    of_file = Window.partitionBy("_file")
    before = of_file.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = _odd(F.coalesce(F.sum("_quotes").over(before), F.lit(0)))
    begun = F.when(F.col("_inside") == 0, F.col("_even_starts")).otherwise(F.col("_odd_starts"))
    open_end = F.concat(F.lit("quotes are left open at the end of "), F.col("_file"))
    checked = F.when(_odd(F.sum("_quotes").over(of_file)) == 1, F.raise_error(open_end).cast("long"))
    told = counted.withColumn("_inside", F.coalesce(checked, inside)).withColumn("_begun", begun)
    return told.select(
        *_SPLIT,
        "_inside",
        _odd(F.col("_inside") + F.col("_quotes")).alias("_open"),
        F.coalesce(F.sum("_begun").over(before), F.lit(0)).alias("_earlier"),
    )


def _joined(pieces: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return pieces.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["t"]), "\n").alias("record"))


def csv_records(spark: SparkSession, files: list[str]) -> DataFrame:
    """One row per record: ``_file``, ``_number`` (from 1, the header) and ``record``.

    The lines are shuffled once, by split. Records that lie in one split are put
    together there; only the pieces of the others, two a split at most, meet in a
    second, small shuffle. Quotes are expected around whole values only and doubled
    inside them. Empty lines between records and an empty file give no record.
    """
    in_split = Window.partitionBy(*_SPLIT).orderBy("_seq")
    earlier = in_split.rowsBetween(Window.unboundedPreceding, -1)
    lines = _lines(spark, files).withColumn("_odd", _odd(F.coalesce(F.sum("_quotes").over(earlier), F.lit(0))))
    placed = lines.join(_splits(lines), list(_SPLIT))
    starts = F.col("_odd") == F.col("_inside")
    number = F.col("_earlier") + F.sum(starts.cast("long")).over(in_split)
    placed = placed.withColumn("_number", number)
    # A record goes on in the next split if it is the last one begun where quotes are open at the end.
    last = F.max("_number").over(Window.partitionBy(*_SPLIT))
    crossing = (F.col("_number") == F.col("_earlier")) | ((F.col("_open") == 1) & (F.col("_number") == last))
    placed = placed.withColumn("_crossing", crossing)

    keys = ["_file", "_block", "_number"]
    whole = _joined(placed.where(~F.col("_crossing")), keys, "_seq", "_line").drop("_block")
    pieces = _joined(placed.where("_crossing"), keys, "_seq", "_line")
    records = whole.unionByName(_joined(pieces, ["_file", "_number"], "_block", "record"))
    ended = records.withColumn("record", F.regexp_replace("record", "\r$", ""))
    return ended.where(F.trim("record") != "")
