"""Completion toggles as a stream: current completions and refreshed verdicts.

Each micro-batch folds its events into the table of latest toggles and re-evaluates the touched
students only.  The outcome depends on (ts, event_id), never on arrival order, and replaying a
batch changes nothing.

Students are dealt over buckets by the leading bits of a hash (extendible hashing).  A bucket that
would hold more than a bound of rows is split by as many further bits as that takes, so a batch
rewrites small files and its tasks grow with what it touches, however large the tables become.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trellis.operators.students import latest_toggles
from trellis.operators.verdicts import requirement_status
from trellis.session import stage

TOGGLE_SCHEMA = "student bigint, code string, done boolean, ts timestamp, event_id bigint"
STATUS_SCHEMA = "student bigint, code string, status string"
BUCKET_SCHEMA = "bucket string, batch bigint, rows bigint"
#: Rows that a bucket may hold before it is split.
BUCKET_ROWS = 500_000
#: Bits of a student's hash, and bits by which one step splits a bucket at most.
BITS, STEP = 60, 12


def _bits() -> Column:
    return F.lpad(F.bin(F.shiftrightunsigned(F.xxhash64("student"), 64 - BITS)), BITS, "0")


def _place(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` of students that lie in one of ``buckets``, with its name: "b" and the leading bits."""
    depths = sorted(r.depth for r in buckets.select((F.length("bucket") - 1).alias("depth")).distinct().collect())  # at most BITS + 1
    names = F.array(*(F.concat(F.lit("b"), F.substring(_bits(), 1, d)) for d in depths)).cast("array<string>")
    return rows.withColumn("bucket", F.explode(names)).join(buckets.select("bucket"), "bucket")


class ToggleTables:
    """Two tables written as versions ``<base>/<name>/batch=<id>/bucket=<bits>``.

    A batch writes complete new files for the buckets it touches and then ``<base>/<name>_buckets/batch=<id>``, which
    says for every bucket in which version it lies; readers take the newest that is complete.  A replayed batch starts
    from the buckets before it and overwrites its own version.
    """

    def __init__(self, spark: SparkSession, base: str, bucket_rows: int = BUCKET_ROWS):
        self.spark, self.base, self.bucket_rows = spark, base.rstrip("/"), bucket_rows

    def _glob(self, pattern: str) -> tuple:
        """The file system and the paths of a pattern."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{pattern}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs, [status.getPath() for status in fs.globStatus(path) or []]

    def buckets(self, name: str, before: int | None = None) -> DataFrame:
        """Every bucket with the version it lies in and its number of rows; at first one bucket of everybody."""
        _, marks = self._glob(f"{name}_buckets/batch=*/_SUCCESS")
        written = [int(m.getParent().getName().split("=")[1]) for m in marks]
        newest = max((n for n in written if before is None or n < before), default=None)
        if newest is None:
            return self.spark.createDataFrame([("b", -1, 0)], BUCKET_SCHEMA)
        return self.spark.read.schema(BUCKET_SCHEMA).parquet(f"{self.base}/{name}_buckets/batch={newest}")

    def _rows(self, name: str, schema: str, buckets: DataFrame) -> DataFrame:
        full = f"{schema}, batch bigint, bucket string"
        if not self._glob(f"{name}/batch=*")[1]:
            return self.spark.createDataFrame([], schema)
        held = self.spark.read.schema(full).parquet(f"{self.base}/{name}")
        return held.join(buckets.where("rows > 0").select("batch", "bucket"), ["batch", "bucket"], "left_semi").drop("batch", "bucket")

    def _split(self, rows: DataFrame, buckets: DataFrame) -> DataFrame:
        """``(bucket, rows)``: ``buckets`` with the sizes that ``rows`` give them, split until none is over the bound.

        One student's rows stay together; there are as many as courses, at most.
        """
        while True:
            sized = _place(rows, buckets).groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"), (F.min(_bits()) < F.max(_bits())).alias("several"))
            sizes = stage(buckets.select("bucket").join(sized, "bucket", "left").select("bucket", F.coalesce("rows", F.lit(0)).alias("rows"), "several"))
            full = F.col("several") & (F.col("rows") > self.bucket_rows) & (F.length("bucket") <= BITS)
            if sizes.where(full).isEmpty():
                return sizes.drop("several")
            wanted = F.ceil(F.log2(F.col("rows") / self.bucket_rows)).cast("int")
            more = F.when(full, F.greatest(F.lit(1), F.least(wanted, F.lit(STEP), F.lit(BITS + 1) - F.length("bucket")))).otherwise(0)
            ends = F.transform(F.sequence(F.lit(0), F.pow(F.lit(2), more).cast("int") - 1), lambda i: F.concat("bucket", F.lpad(F.bin(i), more, F.lit("0"))))
            buckets = sizes.select(F.explode(ends).alias("bucket"))

    def rewrite(self, name: str, schema: str, batch: int, touched: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Replace the buckets of the ``touched`` students: ``make(their rows before)`` gives their rows now, which are returned."""
        before = stage(self.buckets(name, batch))
        opened = stage(before.join(_place(touched, before).select("bucket").distinct(), "bucket", "left_semi"))
        rows = stage(make(self._rows(name, schema, opened)))
        sizes = self._split(rows, opened)
        placed = _place(rows, sizes).repartition("bucket")
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.base}/{name}/batch={batch}")
        others = before.join(opened, "bucket", "left_anti")
        now = others.unionByName(sizes.withColumn("batch", F.lit(batch).cast("bigint")))
        now.write.mode("overwrite").parquet(f"{self.base}/{name}_buckets/batch={batch}")
        return rows

    def drop_superseded(self, name: str, batch: int) -> None:
        """Remove versions older than ``batch`` that a replay of it would not start from.

        Compares names only: of the folders, and of the buckets in force before, one each.
        """
        needed = {(r.batch, r.bucket) for r in self.buckets(name, batch).select("batch", "bucket").collect()}
        fs, folders = self._glob(f"{name}/batch=*/bucket=*")
        for path in folders:
            at, bucket = int(path.getParent().getName().split("=")[1]), path.getName().split("=")[1]
            if at < batch and (at, bucket) not in needed:
                fs.delete(path, True)
        older = sorted((p for p in self._glob(f"{name}_buckets/batch=*")[1]), key=lambda p: int(p.getName().split("=")[1]))
        for path in [p for p in older if int(p.getName().split("=")[1]) < batch][:-1]:
            fs.delete(path, True)

    def toggles(self, before: int | None = None) -> DataFrame:
        return self._rows("toggles", TOGGLE_SCHEMA, self.buckets("toggles", before))

    def statuses(self, before: int | None = None) -> DataFrame:
        return self._rows("statuses", STATUS_SCHEMA, self.buckets("statuses", before))


def apply_batch(tables: ToggleTables, events: DataFrame, batch: int, targets: DataFrame, courses: DataFrame, req_nodes: DataFrame) -> None:
    """Fold one micro-batch in and refresh the verdicts of the students it touches."""
    events = events.select("student", "code", "done", "ts", "event_id")
    touched = stage(events.select("student").distinct())
    latest = tables.rewrite("toggles", TOGGLE_SCHEMA, batch, touched, lambda old: latest_toggles(old.unionByName(events)))
    now = latest.where("done").select("student", "code").join(touched, "student", "left_semi")
    fresh = requirement_status(targets.join(touched, "student", "left_semi"), courses, req_nodes, now).select("student", "code", "status")
    tables.rewrite("statuses", STATUS_SCHEMA, batch, touched, lambda old: old.join(touched, "student", "left_anti").unionByName(fresh))
    for name in ("toggles", "statuses"):
        tables.drop_superseded(name, batch)


def start(stream: DataFrame, tables: ToggleTables, checkpoint: str, targets: DataFrame, courses: DataFrame, req_nodes: DataFrame, **trigger) -> StreamingQuery:
    """Run :func:`apply_batch` on every micro-batch of a toggle stream."""

    def each(batch_df: DataFrame, batch_id: int) -> None:
        apply_batch(tables, batch_df, batch_id, targets, courses, req_nodes)

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
