"""Stored search index: short substrings of codes and titles with postings and counts.

An index is a folder::

    postings/version=<n>/shard=<s>/   gram, block, code, title: one row per course and distinct substring of 1, 2, 3, 6 and 12 characters
    counts/version=<n>/               gram, n, blocks, shard: how many postings a gram has, over how many blocks they are dealt, and where
    courses/version=<n>/              the records that came with version n
    gone/version=<n>/                 codes whose older postings and records no longer count
    COMMIT/<n>                        written last

An update writes the changed courses as a version of its own; nothing older is rewritten, and ``compact`` puts all
versions together again.  A course that contains a query has all the query's substrings of a size, so in each version a
query needs the postings of its rarest gram of its largest size only, and none where one of those grams has no postings.
Codes with the same four digits or letters share all short grams; the longer ones keep what a query meets near what it
hits, however many courses there are.  A search opens only the shards of those grams.  (Folders written with 1 to 3
characters alone must be written again.)  A gram with many postings is dealt over blocks of about ``BLOCK`` rows: the join key is (version, gram,
block), so no key holds more than that.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trellis.functions import text as T
from trellis.operators.catalog import _grams, search_limit
from trellis.session import stage
from trellis.sources.publication import Publication

POSTINGS = "gram string, block int, code string, title string, version int, shard int"
COUNTS = "gram string, n long, blocks int, shard int, version int"
#: Postings of one gram that one join key holds, and postings of a shard, about.
BLOCK, SHARD = 100_000, 4_000_000
#: Characters of the stored substrings.
SIZES = [1, 2, 3, 6, 12]


def _all_grams(c: Column) -> Column:
    return F.flatten(F.array(*[_grams(c, n) for n in SIZES]))


class SearchIndex(Publication):
    """A folder with an index over ``courses(code, title, ...)``; codes are unique within an update."""

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK, shard: int = SHARD):
        super().__init__(spark, path)
        self.block, self.shard = block, shard

    def _read(self, kind: str, schema: str, folders: list[str] | None = None) -> DataFrame:
        asked = [f"version={n}" for n in self.versions()] if folders is None else folders
        paths = [p for f in asked if self._exists(p := f"{self.path}/{kind}/{f}")]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths)

    def update(self, courses: DataFrame, removed: DataFrame | None = None) -> int:
        """Add or replace ``courses`` and take out ``removed(code)``; returns the new version.

        Courses without a code are left out; a title may be NULL.  A code that is in both is replaced.  All updates
        have the columns of the first.
        """
        version = self.version() + 1
        for kind in ("postings", "counts", "courses", "gone"):  # what an unfinished update may have left
            self._clear(f"{self.path}/{kind}/version={version}")
        fresh = stage(courses.where("code IS NOT NULL"))
        self._write(fresh, version)
        gone = fresh.select("code") if removed is None else fresh.select("code").union(removed.select("code")).where("code IS NOT NULL")
        if version > 1:
            gone.distinct().write.parquet(f"{self.path}/gone/version={version}")
        self._commit(version)
        return version

    def _write(self, courses: DataFrame, version: int) -> None:
        courses.write.parquet(f"{self.path}/courses/version={version}")
        code, title = F.upper("code"), F.upper(T._text("title"))
        grams = F.array_distinct(F.concat(F.array(F.lit("")), _all_grams(code), _all_grams(title)))
        spread = courses.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        rows = spread.select(F.explode(grams).alias("gram"), "code", title.alias("title"))
        counts = stage(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
        shards = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // self.shard))
        shard = F.pmod(F.xxhash64("gram"), F.lit(shards)).cast("int")
        counts = counts.withColumns({"blocks": F.ceil(F.col("n") / self.block).cast("int"), "shard": shard})
        counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{self.path}/counts/version={version}")
        dealt = rows.join(counts.where("blocks > 1").select("gram", "blocks"), "gram", "left")
        block = F.pmod(F.xxhash64("code"), F.coalesce("blocks", F.lit(1))).cast("int")
        placed = dealt.select(shard.alias("shard"), "gram", block.alias("block"), "code", "title")
        ordered = placed.repartitionByRange("shard", "gram", "block").sortWithinPartitions("shard", "gram", "block")
        ordered.write.partitionBy("shard").parquet(f"{self.path}/postings/version={version}")

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows ``(code, version, ...)`` that no later version replaced or removed."""
        if self.versions() == [1]:
            return rows
        later = self._read("gone", "code string, version int").groupBy("code").agg(F.max("version").alias("_gone"))
        met = rows.join(later, "code", "left")
        return met.where(F.coalesce("_gone", F.lit(0)) <= F.col("version")).drop("_gone")

    def courses(self) -> DataFrame:
        """The records in force; the index must have a version."""
        versions = [f"{self.path}/courses/version={n}" for n in self.versions()]
        return self._live(self.spark.read.option("basePath", f"{self.path}/courses").parquet(*versions)).drop("version")

    def compact(self) -> "SearchIndex":
        """One version of what is in force, in a folder of its own beside this one; this one stays readable."""
        whole = SearchIndex(self.spark, f"{self.path}-{uuid.uuid4().hex}", self.block, self.shard)
        whole.update(self.courses())
        return whole

    def plan(self, queries: DataFrame) -> DataFrame:
        """``(query, _q, version, gram, n, blocks, shard)``: each query's rarest gram in each version that has all its grams."""
        cleaned = F.upper(T.clean_text("query"))
        wanted = queries.select("query", F.coalesce(T.strict_code(cleaned), cleaned).alias("_q")).distinct()
        own = F.array("_q")  # the empty query has a gram of its own
        for n in SIZES:
            own = F.when(F.length("_q") >= n, _grams(F.col("_q"), n)).otherwise(own)
        asked = wanted.withColumn("_grams", own).withColumn("_of", F.size("_grams")).withColumn("gram", F.explode("_grams")).drop("_grams")
        met = asked.join(self._read("counts", COUNTS).hint("merge"), "gram")  # the grams are more than the planner takes them for
        rarest = F.min_by(F.struct("gram", "n", "blocks", "shard"), F.struct("n", "gram"))
        found = met.groupBy("query", "_q", "_of", "version").agg(F.count(F.lit(1)).alias("_met"), rarest.alias("g"))
        return found.where(F.col("_met") == F.col("_of")).select("query", "_q", "version", "g.*")

    def search(self, queries: DataFrame, limit=None) -> DataFrame:
        """The rows of :func:`trellis.operators.catalog.search`, from the stored postings.

        Ranks are cut to the limit within each task before the shuffle by query.
        """
        if not self.version():
            raise ValueError(f"no index at {self.path}")
        plan = stage(self.plan(queries))
        folders = [f"version={r.version}/shard={r.shard}" for r in plan.select("version", "shard").distinct().collect()]  # at most the folders of the index
        spread = plan.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("n", "blocks", "shard")
        code = F.upper("code")
        hit = code.contains(F.col("_q")) | F.col("title").contains(F.col("_q"))
        met = self._read("postings", POSTINGS, folders).join(spread, ["version", "gram", "block"]).where(hit)
        rank = F.when(F.col("code") == F.col("_q"), 0).when(F.col("code").startswith(F.col("_q")), 1).otherwise(2)
        best = Window.partitionBy("query").orderBy("rank", "code")
        live = self._live(met.select("query", "code", "version", rank.alias("rank")))
        top = live.withColumn("position", F.row_number().over(best)).where(F.col("position") <= search_limit(limit))
        return self.courses().join(top.drop("version"), "code")
