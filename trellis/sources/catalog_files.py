"""Catalogs published in versions, read year by year from the newest copy that is whole.

A publication is a folder::

    lines/version=<n>/year=<y>/kind=<courses|subjects>/   one JSON record per line, of the years that changed with version n
    meta/version=<n>/                                     one entry per year written: stamp, source, counts, checksum of its lines
    COMMIT/<n>                                            written last

The checksum of a year is a sum over its lines, so it holds whatever order and files they lie in.  A reader compares
it with what it finds: a year whose newest copy is damaged, cut short or gone is read from the newest older copy that
is whole, and the other years are not touched by that.  A year without a whole copy is reported, not half read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.refresh import table_fingerprint
from trellis.session import stage
from trellis.sources.documents import REQUIREMENT, _catalog_parts, catalog_records
from trellis.sources.publication import Publication

META = "year string, generated_at string, source string, source_hash string, courses long, subjects long"
RECORD = (
    "code string, subject string, number string, title string, credits string, description string, source_url string, "
    f"requirements map<string,{REQUIREMENT}>, year string"
)
SUBJECT_RECORD = "code string, name string, source_url string, fetched boolean, year string"
YEARS = "year string, version int, state string"


def _lines(rows: DataFrame, kind: str) -> DataFrame:
    value = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    return rows.select("year", F.lit(kind).alias("kind"), value.alias("value"))


def _checked(lines: DataFrame) -> DataFrame:
    """``(year, source_hash, courses, subjects)`` of lines."""
    counts = [F.count_if(F.col("kind") == kind).alias(kind) for kind in ("courses", "subjects")]
    prints = table_fingerprint(lines.select("year", "kind", "value"), [], ["year"]).withColumnRenamed("fingerprint", "source_hash")
    return prints.join(lines.groupBy("year").agg(*counts), "year")


class CatalogFiles(Publication):
    """A folder of published catalogs."""

    def copies(self) -> DataFrame:
        """Entries of all committed versions: one row per year and version that has it, with ``version``."""
        versions = self.versions()
        if not versions:
            return self.spark.createDataFrame([], f"{META}, version int")
        found = self.spark.read.schema(f"{META}, version int").option("basePath", f"{self.path}/meta").json([f"{self.path}/meta/version={n}" for n in versions])
        return found.where("year IS NOT NULL")

    def _read_lines(self, picked: list[tuple[str, int]]) -> DataFrame:
        """Lines of the given (year, version) copies; folders that are gone give none."""
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        paths = [f"{self.path}/lines/version={n}/year={escape(year)}" for year, n in picked]
        paths = [p for p in paths if self._exists(p)]
        schema = "value string, version int, year string, kind string"
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/lines").text(paths)

    def _choose(self) -> list[tuple[str, int | None, str]]:
        """(year, version, state) of every year: its newest whole copy, by rounds from new to old.

        Collected are entries, one row per year and version; lines are only summed up.  A round reads each year that
        is still open once, so whole newest copies cost one scan.
        """
        older: dict[str, list] = {}
        for r in self.copies().select("year", "version", "source_hash").collect():
            older.setdefault(r.year, []).append((r.version, r.source_hash))
        for found in older.values():
            found.sort()
        newest = {year: found[-1][0] for year, found in older.items()}
        chosen = []
        while older:
            tried = {year: found.pop() for year, found in older.items()}
            lines = self._read_lines([(year, version) for year, (version, _) in tried.items()])
            seen = {r.year: r.source_hash for r in _checked(lines).select("year", "source_hash").collect()}
            for year, (version, stated) in tried.items():
                if seen.get(year) == stated:
                    chosen.append((year, version, "current" if version == newest[year] else "fallback"))
                    del older[year]
                elif not older[year]:
                    chosen.append((year, None, "unreadable"))
                    del older[year]
        return chosen

    def years(self) -> DataFrame:
        """``(year, version, state)``: current, fallback (an older copy is in force) or unreadable (version NULL)."""
        return self.spark.createDataFrame(self._choose(), YEARS)

    def publish(self, courses: DataFrame, subjects: DataFrame, requirements: DataFrame, req_nodes: DataFrame, source: str, generated_at: str, check: bool = False) -> DataFrame:
        """``(year, state)`` with added / changed / unchanged / rejected / kept; writes what differs, unless ``check``.

        A year without courses is rejected and a year that is not given is kept: both stay as last published.  A year
        whose newest copy is no longer whole is written again, as changed.  Nothing is written if nothing differs.
        """
        records = catalog_records(courses, requirements, req_nodes)
        lines = stage(_lines(records, "courses").unionByName(_lines(subjects.select(*(c.split()[0] for c in SUBJECT_RECORD.split(", "))), "subjects")))
        now = stage(_checked(lines))
        sound = self.years().where("state = 'current'").select("year", "version")
        before = self.copies().join(sound, ["year", "version"], "left_semi").select("year", F.col("source_hash").alias("old"))
        known = self.copies().select("year").distinct().withColumn("known", F.lit(True))
        state = (
            F.when(F.col("source_hash").isNull(), "kept").when(F.col("courses") == 0, "rejected").when(F.col("known").isNull(), "added")
            .when(F.col("old") == F.col("source_hash"), "unchanged").otherwise("changed")
        )
        states = stage(now.join(known, "year", "full").join(before, "year", "left").select("year", state.alias("state")))
        fresh = states.where("state IN ('added', 'changed')").select("year")
        if not check and not fresh.isEmpty():
            self._write(lines.join(fresh, "year", "left_semi"), now.join(fresh, "year", "left_semi"), source, generated_at)
        return states

    def _write(self, lines: DataFrame, now: DataFrame, source: str, generated_at: str) -> None:
        version = self.version() + 1
        for kind in ("lines", "meta"):  # what an unfinished refresh may have left
            self._clear(f"{self.path}/{kind}/version={version}")
        ordered = lines.repartitionByRange("year", "kind", "value").sortWithinPartitions("year", "kind", "value")
        ordered.write.partitionBy("year", "kind").text(f"{self.path}/lines/version={version}")
        entries = now.withColumns({"generated_at": F.lit(generated_at), "source": F.lit(source)}).select(*(c.split()[0] for c in META.split(", ")))
        entries.write.json(f"{self.path}/meta/version={version}")
        self._commit(version)

    def read(self) -> dict[str, DataFrame]:
        """``subjects, courses, requirements, req_nodes, meta, years`` of each year's newest whole copy."""
        chosen = self._choose()
        lines = self._read_lines([(year, version) for year, version, _ in chosen if version is not None])
        years = self.spark.createDataFrame(chosen, YEARS)

        def parsed(kind: str, schema: str) -> DataFrame:
            return lines.where(F.col("kind") == kind).select(F.from_json("value", schema).alias("r")).select("r.*")

        meta = self.copies().join(years.select("year", "version"), ["year", "version"], "left_semi").drop("courses", "subjects")
        return dict(subjects=parsed("subjects", SUBJECT_RECORD), meta=meta, years=years, **_catalog_parts(parsed("courses", RECORD)))
