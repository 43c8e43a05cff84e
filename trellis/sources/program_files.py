"""Nested program documents and their manifest, published in versions.

A publication is a folder::

    documents/version=<n>/   one JSON document per line, of the programs that changed with version n
    manifest/version=<n>/    one JSON entry per program: header, counts, content hash, and where its document lies
    COMMIT/<n>               written last; a version without it was never finished and is not read

A refresh assembles the documents from the program tables, writes those whose content differs from the manifest's
hash, and then the manifest of all programs, which points to the old folders for the rest.  Readers take the newest
committed version and open only the document folders that its manifest names, so an unfinished or failed refresh
leaves the last good copy in force.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.session import stage
from trellis.sources.documents import PROGRAM, program_tables, tree_json
from trellis.sources.publication import Publication

# ---- fixed values ---------------------------------------------------------------------------
SCHEMA_VERSION = 2
COUNTS = ["sections", "branches", "courses", "relations"]
# ---------------------------------------------------------------------------------------------
MANIFEST = (
    "id string, programCode string, program string, intake string, catalogYear string, totalCredits string, sourceUrl string, sourceHash string, "
    "sections long, branches long, courses long, relations long, contentHash string, file string, documentVersion int"
)


def _listed(rows: DataFrame, name: str, order: list[Column], fields: list[Column]) -> DataFrame:
    """``(program, name)``: a program's rows as one ordered list.

    A program's own parts make one document, which a reader takes whole; nothing else is gathered.
    """
    entry = F.struct(F.struct(*order).alias("at"), F.struct(*fields).alias("x"))
    return rows.groupBy("program").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["x"]).alias(name))


def program_documents(
    headers: DataFrame, sections: DataFrame, tree: DataFrame, groups: DataFrame, courses: DataFrame, context: DataFrame, branches: DataFrame, branch_courses: DataFrame,
    relations: DataFrame, generated_at: str, layout: str = "auto",
) -> DataFrame:
    """``(program, id, document, contentHash)``: every program as one nested JSON document.

    Lists are in document order: sections and branches by place, courses by section and first row, context courses by
    code, relations by target, relation, group and position.  The hash covers everything but the generation stamp.
    """
    col = F.col
    whole = tree.where(F.size("steps") > 1).unionByName(
        # The section's own AND stands above its items.
        sections.select("program", "section_at", F.lit("0").alias("path"), F.array(F.lit(0)).alias("steps"), F.lit("and").alias("kind"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("note")),
        allowMissingColumns=True,
    )
    fields = {c: F.lit(None).cast(t) for c, t in (("qualifier", "string"), ("pat_subject", "string"), ("pat_min_level", "int"), ("text", "string"))}
    trees = tree_json(whole.withColumns(fields | {"ordinal": F.element_at("steps", -1)}), ["program", "section_at"], "kind").withColumnRenamed("expression", "tree")
    parts = [
        _listed(sections.join(trees, ["program", "section_at"], "left"), "sections", [col("section_at")], [
            col("id"), col("label").alias("pdfSection"), col("eyebrow"), col("title"), col("root_group").alias("rootGroup"), col("tree"), col("copy"), col("source_link").alias("sourceLink"), col("credits"),
        ]),
        _listed(groups, "groups", [col("id")], [col("id"), col("label"), col("kind"), col("parent")]),
        _listed(courses, "courses", [col("section_at"), col("first_at"), col("code")], [col("code"), col("title"), col("credits"), col("parent"), col("section")]),
        _listed(context, "contextCourses", [col("code")], [col("code"), col("title")]),
        _listed(
            branches.join(_listed_branch_courses(branch_courses), ["program", "branch_at"], "left"), "branches", [col("number")],
            [col("id"), col("kind"), col("title"), col("parent"), col("group"), col("rule"), col("credits"), F.coalesce("own", F.array().cast("array<struct<code:string,title:string,credits:string>>")).alias("courses")],
        ),
        _listed(relations, "relations", [col("target"), col("relation"), col("group"), col("position")], [col("source"), col("target"), col("relation"), col("group"), col("raw")]),
    ]
    out = headers
    for part in parts:
        out = out.join(part, "program", "left")
    shown = ["id", "pdfSection", "eyebrow", "title", "rootGroup", "copy", "sourceLink", "credits"]
    nested = F.transform("sections", lambda x: F.struct(*(x[c].alias(c) for c in shown), F.parse_json(x["tree"]).alias("tree")))
    out = out.withColumn("sections", nested)
    named = {
        "id": "id", "programCode": "program_code", "program": "title", "intake": "intake", "catalogYear": "catalog_year", "totalCredits": "total_credits",
        "sourceUrl": "source_url", "sourceHash": "source_hash",
    }
    lists = ["sections", "groups", "courses", "contextCourses", "branches", "relations"]
    body = [F.lit(SCHEMA_VERSION).alias("schemaVersion"), *(col(c).alias(n) for n, c in named.items()), F.lit(layout).alias("layout"), *(col(c) for c in lists)]
    counts = [F.coalesce(F.size(c), F.lit(0)).cast("long").alias(c) for c in COUNTS]
    keep = {"ignoreNullFields": "false"}
    return out.select(
        col("program").alias("key"), *(col(c).alias(n) for n, c in named.items()), *counts,
        F.to_json(F.struct(*body, F.lit(generated_at).alias("generatedAt")), keep).alias("document"), F.sha2(F.to_json(F.struct(*body), keep), 256).alias("contentHash"),
    )


def _listed_branch_courses(branch_courses: DataFrame) -> DataFrame:
    entry = F.struct("line_no", F.struct("code", "title", "credits").alias("x"))
    return branch_courses.groupBy("program", "branch_at").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["x"]).alias("own"))


class ProgramFiles(Publication):
    """A folder of published program documents."""

    def manifest(self) -> DataFrame:
        """Entries of all programs, as of the newest committed version."""
        n = self.version()
        if not n:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).json(f"{self.path}/manifest/version={n}")

    def publish(self, documents: DataFrame, check: bool = False) -> DataFrame:
        """``(id, state)`` with unchanged / changed / added / removed; writes what differs, unless ``check``.

        Nothing is written if nothing differs.  Documents without an id or with one that repeats are an error.
        """
        documents = stage(documents)
        wrong = documents.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("id IS NULL OR n > 1").limit(1).collect()
        if wrong:
            raise ValueError(f"a document's id is missing or repeats: {wrong[0].id}")
        before = self.manifest().select("id", F.col("contentHash").alias("old"), F.col("documentVersion").alias("lies"))
        both = documents.join(before, "id", "full")
        state = F.when(F.col("old").isNull(), "added").when(F.col("contentHash").isNull(), "removed").when(F.col("old") == F.col("contentHash"), "unchanged").otherwise("changed")
        states = stage(both.select("id", state.alias("state"), "lies"))
        if not check and not states.where("state <> 'unchanged'").isEmpty():
            self._write(documents.join(states.where("state <> 'removed'"), "id"), self.version() + 1)
        return states.select("id", "state")

    def _write(self, documents: DataFrame, version: int) -> None:
        for kind in ("documents", "manifest"):  # what an unfinished refresh may have left
            self._clear(f"{self.path}/{kind}/version={version}")
        fresh = documents.where("state <> 'unchanged'")
        fresh.repartitionByRange("id").select(F.col("document").alias("value")).write.text(f"{self.path}/documents/version={version}")
        lies = F.when(F.col("state") == "unchanged", F.col("lies")).otherwise(version)
        fields = [c for c in self.spark.createDataFrame([], MANIFEST).columns if c not in ("file", "documentVersion")]
        entries = documents.select(*fields, F.format_string("documents/version=%d", lies).alias("file"), lies.cast("int").alias("documentVersion"))
        entries.repartitionByRange("id").sortWithinPartitions("id").write.option("ignoreNullFields", "false").json(f"{self.path}/manifest/version={version}")
        self._commit(version)

    def read(self) -> dict[str, DataFrame]:
        """The tables of :func:`read_programs`, of the documents that the newest manifest names."""
        entries = stage(self.manifest())
        versions = [r.documentVersion for r in entries.select("documentVersion").distinct().collect()]  # one row per version that is still in use
        if not versions:
            return program_tables(self.spark.createDataFrame([], PROGRAM))
        lines = None
        for n in versions:
            own = self.spark.read.text(f"{self.path}/documents/version={n}").select(F.from_json("value", PROGRAM).alias("d"), F.lit(n).alias("documentVersion"))
            lines = own if lines is None else lines.unionByName(own)
        current = lines.select("d.*", "documentVersion").join(entries.select("id", "documentVersion"), ["id", "documentVersion"], "left_semi")
        return program_tables(stage(current.drop("documentVersion")))
