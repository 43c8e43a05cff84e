"""JSON documents at the edge: catalogs, programs and the recursive trees inside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators.refresh import table_fingerprint
from trellis.operators.requirements import RELATIONS
from trellis.session import Staged, stage

REQUIREMENT = "struct<relation:string,raw:string,status:string,warnings:array<string>,expression:string>"
COURSE = (
    "struct<year:string,code:string,subject:string,number:string,title:string,credits:string,description:string,"
    f"source_url:string,requirements:map<string,{REQUIREMENT}>>"
)
SUBJECT = "struct<code:string,name:string,source_url:string,fetched:boolean>"
CATALOG = f"year string, generatedAt string, source string, sourceHash string, subjects array<{SUBJECT}>, courses map<string,{COURSE}>"
PROGRAM_COURSE = "struct<code:string,title:string,credits:string,parent:string,section:string>"
PROGRAM = (
    "schemaVersion int, id string, programCode string, program string, intake string, catalogYear string, totalCredits string, "
    "sourceUrl string, sourceHash string, generatedAt string, layout string, "
    "sections array<struct<id:string,pdfSection:string,eyebrow:string,title:string,rootGroup:string,tree:string,copy:string,sourceLink:string,credits:string>>, "
    "groups array<struct<id:string,label:string,kind:string,parent:string>>, "
    f"courses array<{PROGRAM_COURSE}>, contextCourses array<{PROGRAM_COURSE}>, "
    "branches array<struct<id:string,kind:string,title:string,parent:string,group:string,rule:string,credits:string,"
    "courses:array<struct<code:string,title:string,credits:string>>>>, "
    "relations array<struct<source:string,target:string,relation:string,group:int,raw:string>>"
)


def tree_rows(trees: DataFrame, keys: list[str], column: str, kind_field: str = "type") -> DataFrame:
    """Recursive JSON trees -> node rows, one round per nesting level.

    ``kind_field`` is "type" for requirement expressions and "kind" for program trees.
    """
    schema = (
        f"{kind_field} string, code string, qualifier string, subject string, minimumLevel int, text string, note string, items array<string>"
    )

    def opened(rows: DataFrame) -> DataFrame:
        return rows.withColumn("n", F.from_json("json", schema)).drop("json")

    store = Staged(trees.sparkSession)
    front = opened(trees.where(F.col(column).isNotNull()).select(
        *keys, F.col(column).alias("json"), F.array(F.lit(0)).alias("steps"), F.array().cast("array<string>").alias("kinds")
    ))
    children = F.coalesce(F.sum(F.size("n.items")), F.lit(0)).alias("children")
    while store.append(front, children)["children"] > 0:
        wide = store.last().where(F.size("n.items") > 0)
        front = opened(wide.select(
            *keys, F.posexplode("n.items").alias("at", "json"), "steps", F.concat("kinds", F.array(F.col(f"n.{kind_field}"))).alias("kinds")
        ).select(*keys, "json", F.concat("steps", F.array("at")).alias("steps"), "kinds"))
    any_above = F.exists("kinds", lambda k: k.isin("any", "or"))
    return store.all().select(
        *keys, F.array_join("steps", ".").alias("path"),
        F.when(F.size("steps") > 1, F.array_join(F.slice("steps", 1, F.size("steps") - 1), ".")).alias("parent_path"),
        F.element_at("steps", -1).alias("ordinal"), F.size("kinds").alias("depth"), "steps", "kinds",
        F.col(f"n.{kind_field}").alias("kind"), "n.code", "n.qualifier", F.col("n.subject").alias("pat_subject"),
        F.col("n.minimumLevel").alias("pat_min_level"), "n.text", "n.note", (~any_above).alias("mandatory"),
    )


def tree_json(nodes: DataFrame, keys: list[str], kind_field: str = "type") -> DataFrame:
    """Node rows -> ``(keys..., expression)``: the recursive JSON of each tree, children first."""
    base = nodes.select(
        *keys, "steps", F.size("steps").alias("level"),
        F.to_json(F.struct(
            F.col("kind").alias(kind_field), "code", "qualifier", F.col("pat_subject").alias("subject"),
            F.col("pat_min_level").alias("minimumLevel"), "text", *(["note"] if "note" in nodes.columns else []),
        )).alias("json"),
    )
    base = stage(base)
    deepest = base.agg(F.max("level")).first()[0] or 1
    below = None
    for level in range(deepest, 0, -1):
        here = base.where(F.col("level") == level)
        if below is not None:
            # The arms of one junction of one text.
            arms = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "json"))), lambda a: a["json"]), ",")
            grouped = below.groupBy(*keys, "steps").agg(arms.alias("arms"))
            inside = F.concat(F.expr("left(json, length(json) - 1)"), F.lit(',"items":['), F.col("arms"), F.lit("]}"))
            here = here.join(grouped, [*keys, "steps"], "left").withColumn("json", F.when(F.col("arms").isNotNull(), inside).otherwise(F.col("json")))
        below = here.select(*keys, F.slice("steps", 1, level - 1).alias("steps") if level > 1 else F.array().cast("array<int>").alias("steps"),
                            F.element_at("steps", -1).alias("ordinal"), "json")
    return below.select(*keys, F.col("json").alias("expression"))


def _documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document per file."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema).alias("d"), "value")


def read_catalog(spark: SparkSession, path: str, fallback: str | None = None) -> dict[str, DataFrame]:
    """Catalog documents -> ``subjects, courses, requirements, req_nodes, meta, rejected``.

    A document without a ``courses`` object is rejected.  If nothing readable is left, the last good
    copy at ``fallback`` is read instead.
    """
    docs = _documents(spark, path, CATALOG)
    usable = F.col("d.courses").isNotNull()
    if fallback is not None and docs.where(usable).isEmpty():
        return read_catalog(spark, fallback)
    good = docs.where(usable).select("d.*")
    courses = good.select("year", F.explode("courses").alias("code", "c"))
    courses = courses.select(
        F.coalesce("c.year", "year").alias("year"), "code", "c.subject", "c.number", "c.title", "c.credits", "c.description", "c.source_url",
        "c.requirements",
    )
    subjects = good.select("year", F.inline("subjects"))
    meta = good.select("year", F.col("generatedAt").alias("generated_at"), "source", F.col("sourceHash").alias("source_hash"))
    rejected = docs.where(~usable).select("file", F.lit("catalog has no courses").alias("reason"))
    return dict(subjects=subjects, meta=meta, rejected=rejected, **_catalog_parts(courses))


def _catalog_parts(courses: DataFrame) -> dict[str, DataFrame]:
    stated = courses.select("year", F.col("code").alias("owner"), F.explode("requirements").alias("relation", "r")).where(F.col("r").isNotNull())
    requirements = stated.select(
        "year", "owner", "relation", "r.raw", "r.status", F.coalesce("r.warnings", F.array().cast("array<string>")).alias("warnings")
    )
    nodes = tree_rows(stated.select("year", "owner", "relation", "r.expression"), ["year", "owner", "relation"], "expression").drop("note")
    return dict(courses=courses.drop("requirements"), requirements=requirements, req_nodes=nodes)


def read_catalog_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Read back what :func:`write_catalog` wrote; any number of tasks share the courses of a year."""
    record = f"code string, subject string, number string, title string, credits string, description string, source_url string, requirements map<string,{REQUIREMENT}>, year string"
    courses = spark.read.schema(record).json(f"{path}/courses")
    subjects = spark.read.schema("code string, name string, source_url string, fetched boolean, year string").json(f"{path}/subjects")
    meta = spark.read.schema("year string, generated_at string, source string, source_hash string").json(f"{path}/meta")
    return dict(subjects=subjects, meta=meta, **_catalog_parts(courses))


def catalog_records(courses: DataFrame, requirements: DataFrame, req_nodes: DataFrame) -> DataFrame:
    """One record per course with all three relations, NULL where absent."""
    keys = ["year", "owner", "relation"]
    record = F.struct("relation", "raw", "status", "warnings", "expression")
    full = requirements.join(tree_json(req_nodes, keys), keys, "left").withColumn("r", record)
    wide = full.groupBy("year", F.col("owner").alias("code")).agg(*[
        F.max_by("r", F.when(F.col("relation") == r, F.lit(1))).alias(r) for r in RELATIONS
    ])
    joined = courses.join(wide, ["year", "code"], "left")
    return joined.select(
        "year", "code", "subject", "number", "title", "credits", "description", "source_url", F.struct(*RELATIONS).alias("requirements")
    )


def write_catalog(path: str, courses: DataFrame, subjects: DataFrame, requirements: DataFrame, req_nodes: DataFrame, source: str, generated_at: str) -> DataFrame:
    """Write a catalog as JSON-lines tables partitioned by year; returns its ``meta`` rows.

    Courses are range-sorted by code, so a year of any size is written by many tasks.  The
    fingerprint covers parsed content only.
    """
    records = stage(catalog_records(courses, requirements, req_nodes))
    ordered = records.repartitionByRange("year", "code").sortWithinPartitions("year", "code")
    ordered.write.mode("overwrite").partitionBy("year").option("ignoreNullFields", "false").json(f"{path}/courses")
    subjects.write.mode("overwrite").partitionBy("year").json(f"{path}/subjects")
    prints = table_fingerprint(records, [], ["year"]).withColumnRenamed("fingerprint", "a").join(
        table_fingerprint(subjects, [], ["year"]).withColumnRenamed("fingerprint", "b"), "year", "left"
    )
    meta = prints.select(
        "year", F.lit(generated_at).alias("generated_at"), F.lit(source).alias("source"), F.sha2(F.concat_ws("|", "a", "b"), 256).alias("source_hash")
    )
    meta.write.mode("overwrite").json(f"{path}/meta")
    return meta


def read_programs(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Program documents, one per file -> one table per part, keyed by ``program`` (the document id)."""
    return program_tables(_documents(spark, path, PROGRAM).where(F.col("d.id").isNotNull()).select("d.*"))


def program_tables(documents: DataFrame) -> dict[str, DataFrame]:
    """Documents with the fields of ``PROGRAM`` -> one table per part, keyed by ``program`` (the document id)."""
    docs = documents.withColumnRenamed("program", "title").withColumnRenamed("id", "program")

    def part(column: str) -> DataFrame:
        return docs.select("program", F.posexplode(column).alias("position", "x")).select("program", "position", "x.*")

    bare = F.regexp_replace(F.coalesce("credits", F.lit("")), r"(?i)\s*credits?$", "")
    sections = part("sections").withColumnRenamed("position", "section_at").withColumnRenamed("pdfSection", "label")
    sections = sections.withColumnRenamed("rootGroup", "root_group").withColumnRenamed("sourceLink", "source_link")
    tree = tree_rows(sections.select("program", "section_at", "tree"), ["program", "section_at"], "tree", "kind")
    branches = part("branches")
    header = docs.select(
        "program", F.col("program").alias("id"), F.col("programCode").alias("program_code"), "title", "intake", F.col("catalogYear").alias("catalog_year"),
        F.col("totalCredits").alias("total_credits"), F.col("sourceUrl").alias("source_url"), F.col("sourceHash").alias("source_hash"),
        F.col("generatedAt").alias("generated_at"),
    )
    return dict(
        headers=header,
        sections=sections.drop("tree").withColumn("credit_range", bare),
        tree=tree.where(F.col("depth") > 0).select("program", "section_at", "path", "parent_path", "steps", "kinds", "kind", "code", "note"),
        groups=part("groups").drop("position"),
        courses=part("courses"),
        context=part("contextCourses").select("program", "code", "title", "credits", F.col("position").alias("old_at")),
        branches=branches.drop("courses").withColumnRenamed("position", "branch_at"),
        branch_courses=branches.select("program", F.col("position").alias("branch_at"), F.posexplode("courses").alias("line_no", "c")).select("program", "branch_at", "line_no", "c.*"),
        relations=part("relations"),
    )


def parsed_from_documents(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The parse result a stored document stands for, so it can be refreshed without its source text."""
    sections = tables["sections"].select(
        "program", "section_at", F.coalesce("label", "id").alias("title"), F.col("credit_range").alias("credits"), "id"
    )
    member = tables["courses"].select("program", F.col("section").alias("id"), "code", F.array("position").alias("first_at"), "title", "credits")
    courses = member.join(sections.select("program", "id", "section_at"), ["program", "id"]).drop("id")
    return dict(sections=sections.drop("id"), courses=courses, tree=tables["tree"], branches=tables["branches"], branch_courses=tables["branch_courses"])
