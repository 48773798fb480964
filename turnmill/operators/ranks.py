"""Ranks, running sums and line numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from turnmill import session


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder."""
    return session.written(df, session.new_path(df.sparkSession, name))


#: monotonically_increasing_id() numbers a partition's rows in its low bits and the partition in those above.
ROW_BITS = 33


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """df in ranges of the order, each sorted and its rows numbered (_i), as a table: the numbers stay with the rows, whatever is done with them."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()), "ranked")


def ranked(df: DataFrame, order: list[Column], rank: str = "rank", mass: str | None = None, total: str = "running") -> DataFrame:
    """df with a 1-based rank by `order` and, given a column `mass`, its running sum up to the row.

    Rows are range-partitioned by the order and numbered where they lie; the ranges' sizes (a row for each) are added up before them. So no task holds more than
    its range, whatever the table's size, and a rank takes one shuffle. A running sum takes a second one, by range.
    """
    dealt = _placed(df, order)
    part = F.shiftright("_i", ROW_BITS)
    sums = [F.count("*").alias("_n"), *([F.sum(mass).alias("_m")] if mass else [])]
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(part.alias("_p")).agg(*sums)
    offsets = parts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *([F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_m0")] if mass else []))
    out = dealt.withColumn("_q", part)
    if mass:
        out = out.withColumn("_c", F.sum(mass).over(Window.partitionBy("_q").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))
    # one row for each partition: as many as spark.sql.shuffle.partitions
    out = out.join(F.broadcast(offsets), F.col("_q") == F.col("_p"))
    out = out.withColumn(rank, F.col("_n0") + F.col("_i").bitwiseAND((1 << ROW_BITS) - 1) + 1)
    if mass:
        out = out.withColumn(total, F.col("_m0") + F.col("_c"))
    return out.drop("_p", "_q", "_i", "_c", "_n0", "_m0")


def ranked_in(df: DataFrame, group: str, order: list[Column], rank: str = "rank", few_groups: bool = False) -> DataFrame:
    """df with a 1-based rank by `order` in each group. As `ranked`: a group that holds most rows is spread over many ranges.

    few_groups: the caller knows that groups are few (days, kinds), so the table of their parts, a row for each group and range that meet, is broadcast.
    """
    dealt = _placed(df, [F.col(group), *order])
    part = F.shiftright("_i", ROW_BITS)
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy(part.alias("_p"), F.col(group).alias("_g")).agg(F.count("*").alias("_n"), F.min("_i").alias("_i0"))
    offsets = parts.select("_p", "_g", "_i0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    out = dealt.withColumn("_q", part).join(F.broadcast(offsets) if few_groups else offsets, (F.col("_q") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return out.withColumn(rank, F.col("_n0") + F.col("_i") - F.col("_i0") + 1).drop("_p", "_q", "_i", "_i0", "_g", "_n0")


def top(df: DataFrame, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows by `order`, numbered from 1. Each task keeps n rows at most before they meet."""
    w = Window.orderBy(*order)
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(w).cast("bigint"))


def numbered(files: DataFrame, name: str = "line_no") -> DataFrame:
    """Rows read from files with 0-based numbers in the order of their files' names and of the lines in each.

    A row's place is its file, the start of its split, and its order in the split (rows of a split get rising numbers from one task). The splits' sizes and
    first numbers (a row for each, broadcast) give the rest, so no line is moved.
    """
    rows = files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_i"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col("_file").alias("_f"), F.col("_start").alias("_b")).agg(F.count("*").alias("_n"), F.min("_i").alias("_i0"))
    offsets = sizes.select("_f", "_b", "_i0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    out = rows.join(F.broadcast(offsets), (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_b")))
    return out.select(*files.columns, (F.col("_n0") + F.col("_i") - F.col("_i0")).cast("bigint").alias(name))
