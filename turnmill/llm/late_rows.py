"""Late rows into a table that is partitioned by day: deletion vectors, and an overwrite of the days that they touch.

Layout. A folder for each day (`day=<days since 1970>`, -1 where the time is null), in it Parquet files of `file_rows` rows, the last of a day with what is left. A day's rows are
sorted by time and key; of each key's rows the latest-arrived is kept. Files hold the table's own columns only, in their order.

Overwrite. The late rows' keys meet the stored keys with their files and `_metadata.row_index`; what goes is marked in a deletion vector, a bitmap of `BLOCK` positions per
row of a table in the shared folder. Days with a marked position or a kept late row are compacted: their stored rows are masked by the vectors, merged with the late rows by a
range-partitioned sort, cut into files anew, and take their days' places by a dynamic partition overwrite. Nothing else is read beyond its keys, or written.

Scale. Rows are dealt by ranges of (day, time, key), so a day with most of the rows lies in many tasks; a file's rows, which the layout demands whole, are streamed by one. A
key with most of the rows is reduced before the shuffle. What is broadcast or known to the driver are days, files, and a row for each range and day: their numbers follow from
the calendar, from the layout and from the session's shuffle partitions, not from the rows.

Recovery. What decides the new files (late rows, vectors, merged rows) is written before a day is touched, and the layout follows from the rows alone: a run that fails is repeated
from the start with the same result.

Defined results: a null arrival is earlier than any other; of rows with the same arrival the one that is greatest in time and then in the other columns (in their order, nulls
least) stays, and of equal rows one; null keys are one key; rows of a null time are day -1; an empty table gives no files; no late rows leave every file as it is; the rows' own
columns may have any names but that of the partition column.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructType

from turnmill.llm.common import arrow_map, cut, drop, table
from turnmill.operators.ranks import ranked_in
from turnmill.session import new_path

DAY = "day"
#: Positions of one bitmap: those of Spark's bitmap functions.
BLOCK = 32768
DAY_MICROS = 86_400_000_000


def day_of(time: Column) -> Column:
    """Whole days since 1970, -1 for null. A timestamp without a zone isn't moved by the session's zone."""
    return F.coalesce(F.unix_date(time.cast("date")), F.lit(-1)).cast("bigint")


def micros_of(time: Column) -> Column:
    """Microseconds since 1970 of a timestamp without a zone, from its fields: the session's zone takes no part."""
    seconds = F.hour(time) * 3600 + F.minute(time) * 60
    return F.unix_date(time.cast("date")).cast("bigint") * DAY_MICROS + seconds.cast("bigint") * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("bigint")


def latest(rows: DataFrame, key: str, time: str, arrived: str) -> DataFrame:
    """The kept row of each key, a maximum, so that repeated keys are reduced before they are shuffled."""
    order = [arrived, time, *[c for c in rows.columns if c not in (arrived, time, key)]]
    best = rows.groupBy(F.col(key).alias("_k")).agg(F.max(F.struct(*order)).alias("_b"))
    return best.select(*[(F.col("_k") if c == key else F.col(f"_b.`{c}`")).alias(c) for c in rows.columns])


def stored(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields]).add(DAY, LongType())).parquet(path)


def lay(rows: DataFrame, path: str, *, key: str, time: str, file_rows: int) -> list[int]:
    """Write rows (one per key, with their day) as files below path, in place of what their days hold there; the days written.

    Ranks in the day give the files; files, numbered through all days, are dealt to tasks in runs, and a task starts a new file after `file_rows` rows or with a new day.
    """
    spark = rows.sparkSession
    placed = ranked_in(rows, DAY, [F.col(time), F.col(key)], rank="_rank", few_groups=True)
    placed = placed.withColumn("_file", F.expr(f"(_rank - 1) div {file_rows}"))
    days = placed.groupBy(DAY).agg((F.max("_file") + 1).alias("_n")).orderBy(DAY).collect()  # a row for each day
    if not days:
        placed.select(*rows.columns).write.mode("append").partitionBy(DAY).parquet(path)  # the folder, if it isn't there
        return []
    first, files = {}, 0
    for d, n in days:
        first[d] = files
        files += n
    starts = spark.createDataFrame(list(first.items()), "_d bigint, _first bigint")
    tasks = min(files, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = placed.join(F.broadcast(starts), F.col(DAY) == F.col("_d")).withColumn("_to", F.expr(f"cast((_first + _file) * {tasks} div {files} as int)"))
    dealt = dealt.repartitionById(tasks, "_to").sortWithinPartitions(DAY, "_rank").drop("_rank", "_file", "_d", "_first", "_to")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", file_rows).partitionBy(DAY).parquet(path)
    return list(first)


def write_days(rows: DataFrame, path: str, *, key: str, time: str, arrived: str, file_rows: int) -> list[int]:
    """A new layout of rows below path; its days."""
    return lay(latest(rows, key, time, arrived).withColumn(DAY, day_of(F.col(time))), path, key=key, time=time, file_rows=file_rows)


def deletion_vectors(at: DataFrame) -> DataFrame:
    """(_path, _block, _bits) from (_path, _at): bitmaps of row positions."""
    return at.groupBy("_path", F.expr(f"_at div {BLOCK}").alias("_block")).agg(F.bitmap_construct_agg(F.col("_at") % BLOCK).alias("_bits"))


def marked(bits: Column, at: Column) -> Column:
    """Whether a position is set in its block's bitmap; without a bitmap none is."""
    place = at % BLOCK
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (place % 8).cast("int")).bitwiseAND(1) != 0, F.lit(False))


def overwrite_late(late: DataFrame, path: str, *, key: str, time: str, arrived: str, file_rows: int) -> list[int]:
    """Bring late rows into a layout; the days that were rewritten. A late row stays out where the stored row of its key has arrived later, or neither has a time of arrival."""
    spark = late.sparkSession
    names = late.columns
    old = stored(spark, path, late.schema)
    new = cut(latest(late, key, time, arrived), "late")
    lines = old.select(F.col(key).alias("_k"), F.col(arrived).alias("_a"), F.col(DAY).alias("_old"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
    # in one pass over the stored keys: the places of those that late rows replace, and the late rows that are no later than what is stored
    met = cut(lines.hint("shuffle_hash").join(new.select(F.col(key).alias("_n"), F.col(arrived).alias("_b")), F.col("_k").eqNullSafe(F.col("_n"))).select("_old", "_path", "_at", "_n", (F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.col("_b") >= F.col("_a")))).alias("_goes")), "met")
    stale = met.where("NOT _goes").select("_n")
    kept = new.join(stale, new[key].eqNullSafe(stale["_n"]), "left_anti").withColumn(DAY, day_of(F.col(time)))
    goes = met.where("_goes")
    vectors = cut(deletion_vectors(goes), "deletion-vectors")
    days = sorted(r[0] for r in kept.select(DAY).union(goes.select("_old")).distinct().collect())  # days, not rows
    if not days:
        return []
    touched = old.where(F.col(DAY).isin(days)).select("*", F.col("_metadata.file_path").alias("_p"), F.col("_metadata.row_index").alias("_at"))
    masked = touched.join(vectors.hint("shuffle_hash"), (F.col("_p") == F.col("_path")) & (F.expr(f"_at div {BLOCK}") == F.col("_block")), "left").where(~marked(F.col("_bits"), F.col("_at")))
    filled = lay(masked.select(*names, DAY).unionByName(kept.select(*names, DAY)), path, key=key, time=time, file_rows=file_rows)
    for d in set(days) - set(filled):  # all of its rows have gone to other days
        drop(spark, f"{path}/{DAY}={d}")
    return days


def file_digests(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(path, day, n_rows, cents, rows_crc, ids_sha256) of each file of a layout of sales. The ids are hashed in the file's order as they stream by; no file is held whole."""
    rows = stored(spark, path, schema)
    cents = F.coalesce(F.floor(100 * F.col("total") + 0.5), F.lit(0)).cast("bigint")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    crc = F.crc32(F.concat_ws(":", text(F.col("sale_id")), text(micros_of(F.col("sold_at"))), text(micros_of(F.col("arrived_at")))).cast("binary"))
    lines = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.row_index").alias("_at"), F.col(DAY), text(F.col("sale_id")).alias("_id"), cents.alias("_cents"), crc.alias("_crc"))
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path", "_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        seen = hashlib.sha256()
        for b in batches:
            paths = b.column("path").to_pylist()
            for here, run_of in itertools.groupby(range(b.num_rows), paths.__getitem__):
                at = next(run_of)
                part = b.slice(at, 1 + sum(1 for _ in run_of))
                new = not done or done[-1][0] != here
                if new:
                    if done:
                        done[-1][-1] = seen.hexdigest()
                    seen = hashlib.sha256()
                    done.append([here, part.column(DAY)[0].as_py(), 0, 0, 0, ""])
                seen.update(("," * (not new) + ",".join(part.column("_id").to_pylist())).encode())
                file = done[-1]
                file[2] += part.num_rows
                file[3] += pc.sum(part.column("_cents")).as_py()
                file[4] += pc.sum(part.column("_crc")).as_py()
        if done:
            done[-1][-1] = seen.hexdigest()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", DAY, "n_rows", "cents", "rows_crc", "ids_sha256"])

    return arrow_map(lines, run, f"path string, {DAY} bigint, n_rows bigint, cents bigint, rows_crc bigint, ids_sha256 string")


def file_numbers(files: DataFrame) -> DataFrame:
    """With file_no: a day's files are written by one job, so their tasks' numbers and the tasks' counters give their order."""
    order = [F.regexp_extract("path", r"/part-(\d+)-", 1).cast("bigint"), F.regexp_extract("path", r"\.c(\d+)\.", 1).cast("bigint")]
    return files.withColumn("file_no", F.row_number().over(Window.partitionBy(DAY).orderBy(*order)).cast("bigint") - 1)


LATE_FROM = datetime(2024, 4, 10)


def with_copies(sales: DataFrame) -> DataFrame:
    """The contract's rows: some sales of every seventh day come again, later and with another total."""
    h = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    days = lambda n: F.make_dt_interval(n.cast("int"))
    again = sales.where((h % 3 == 0) & (day_of(F.col("sold_at")) % 7 == 0))
    again = again.withColumns({"total": F.col("total") + 1, "sold_at": F.col("sold_at") + days(h % 2), "arrived_at": F.col("arrived_at") + days(1 + h % 97)})
    return sales.unionByName(again)


def op13_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["sale_id", "client_id", "status", "total", "sold_at", "arrived_at", "priority"]
    sales = table(spark, sf_dir, "sales").select(*names)
    spark = sales.sparkSession
    how = {"key": "sale_id", "time": "sold_at", "arrived": "arrived_at", "file_rows": 1 + sales.count() // 700}
    rows, early = with_copies(sales), F.coalesce(F.col("arrived_at") < F.lit(LATE_FROM).cast("timestamp_ntz"), F.lit(False))
    path = new_path(spark, "sales-by-day")
    write_days(rows.where(early), path, **how)
    before = cut(stored(spark, path, sales.schema).select(F.col("_metadata.file_path").alias("_old")).distinct(), "files-before")  # some 700 and one a day, whatever the size
    overwrite_late(rows.where(~early), path, **how)
    found = cut(file_digests(spark, path, sales.schema), "file-digests")
    columns = names if found.isEmpty() else spark.read.option("recursiveFileLookup", "true").option("mergeSchema", "true").parquet(path).columns
    return file_numbers(found.join(F.broadcast(before), F.col("path") == F.col("_old"), "left")).select(
        DAY, "file_no", "n_rows", "cents", "rows_crc", "path", F.lit(",".join(columns)).alias("columns"), "ids_sha256", F.col("_old").isNull().alias("rewritten"))
