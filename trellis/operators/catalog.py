"""Relational queries over a catalog: search, lookup, metadata, warnings, references, crawl closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import text as T
from trellis.operators.requirements import RELATIONS
from trellis.session import Staged, stage

# ---- fixed values ---------------------------------------------------------------------------
DEFAULT_LIMIT, MAX_LIMIT = 30, 100
SEED_SUBJECTS = ["COMP", "MATH", "ELEC"]
PARTIAL_NOTE = "{} was only partially parsed."
#: Characters of a query that it meets courses by.
LONGEST_GRAM = 16
# ---------------------------------------------------------------------------------------------


def search_limit(limit) -> int:
    """Clamp to 1..100; missing, zero or unreadable limits mean 30."""
    try:
        n = DEFAULT_LIMIT if limit is None else int(float(limit))
    except (TypeError, ValueError):
        n = 0
    return max(1, min(n or DEFAULT_LIMIT, MAX_LIMIT))


def _grams(c, size: int):
    """Distinct substrings of a fixed length."""
    spots = F.when(F.length(c) >= size, F.sequence(F.lit(1), F.length(c) - (size - 1)))
    spots = F.coalesce(spots, F.array().cast("array<int>"))
    return F.array_distinct(F.transform(spots, lambda i: F.substring(c, i, F.lit(size))))


def _meetings(courses: DataFrame, queries: DataFrame) -> DataFrame:
    """``courses`` with each ``query`` (and ``_q``, how it is compared) whose first characters they contain."""
    cleaned = F.upper(T.clean_text("query"))
    wanted = queries.select("query", F.coalesce(T.strict_code(cleaned), cleaned).alias("_q")).distinct()
    wanted = stage(wanted.withColumn("_gram", F.left("_q", F.lit(LONGEST_GRAM))))
    sizes = [r[0] for r in wanted.select(F.length("_gram")).distinct().collect()]  # at most LONGEST_GRAM + 1 numbers
    code, title = F.upper("code"), F.upper(T._text("title"))
    pieces = [F.array(F.lit("")) if n == 0 else _grams(c, n) for n in sizes for c in (code, title)]
    grams = F.array_distinct(F.flatten(F.array(*pieces))) if pieces else F.array().cast("array<string>")
    # The planner takes the substrings for as small as the courses, so it is told to merge.
    spread = courses.repartition(int(courses.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.withColumn("_gram", F.explode(grams)).join(wanted.hint("merge"), "_gram")


def search(courses: DataFrame, queries: DataFrame, limit=None) -> DataFrame:
    """Top matches per query: exact code first, then code prefix, then any hit in code or title.

    ``queries(query)``.  A course that contains the query contains its first ``LONGEST_GRAM`` characters, so
    queries meet courses in an equi join on substrings of the queries' own lengths; up to that length only hits
    meet, longer ones are verified.  The rank limit is applied per task before the shuffle, so a query that hits
    everything stays cheap.
    """
    code, title = F.upper("code"), F.upper(T._text("title"))
    hit = code.contains(F.col("_q")) | title.contains(F.col("_q"))
    rank = F.when(F.col("code") == F.col("_q"), 0).when(F.col("code").startswith(F.col("_q")), 1).otherwise(2)
    hits = _meetings(courses, queries).where(hit).withColumn("rank", rank)
    best = Window.partitionBy("query").orderBy("rank", "code")
    top = hits.withColumn("position", F.row_number().over(best)).where(F.col("position") <= search_limit(limit))
    return top.drop("_q", "_gram")


def lookup(courses: DataFrame, parsed: DataFrame, codes: DataFrame) -> DataFrame:
    """Catalog records of the asked ``codes(code)`` with the three relations, NULL where absent."""
    asked = codes.select(T.strict_code("code").alias("code")).where(F.col("code").isNotNull()).distinct()
    found = courses.join(asked, "code", "left_semi")
    record = F.struct("relation", "raw", "status", "warnings")
    relations = parsed.withColumnRenamed("owner", "code").join(asked, "code", "left_semi").groupBy("code").agg(
        *[F.max(F.when(F.col("relation") == r, record)).alias(r) for r in RELATIONS]
    )
    return found.join(relations, "code", "left")


def metadata(courses: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per catalog year: number of courses and of fetched subjects."""
    counted = courses.groupBy("year").agg(F.count(F.lit(1)).alias("course_count"))
    fetched = subjects.groupBy("year").agg(F.count_if("fetched").alias("subject_count"))
    joined = counted.join(fetched, "year", "full")
    return joined.select(
        "year", F.coalesce("course_count", F.lit(0)).alias("course_count"),
        F.coalesce("subject_count", F.lit(0)).alias("subject_count"), F.lit("ready").alias("status"),
    )


def course_warnings(parsed: DataFrame) -> DataFrame:
    """``(owner, warnings)``: distinct warnings of the three relations in relation order."""
    order = F.array_position(F.array(*map(F.lit, RELATIONS)), F.col("relation"))
    note = F.when(F.col("status") == "partial", F.concat(F.initcap("relation"), F.lit(PARTIAL_NOTE.format(""))))
    notes = F.filter(F.concat("warnings", F.array(note)), lambda w: w.isNotNull() & (w != ""))
    listed = parsed.where(F.size(notes) > 0).groupBy("owner").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("at"), notes.alias("notes")))).alias("all")
    )
    return listed.select("owner", F.array_distinct(F.flatten("all.notes")).alias("warnings"))


def reference_edges(req_nodes: DataFrame) -> DataFrame:
    """Distinct ``(owner, relation, ref)``."""
    hit = (F.col("kind") == "course") & F.col("code").isNotNull()
    return req_nodes.where(hit).select("owner", "relation", F.col("code").alias("ref")).distinct()


def dependents(req_nodes: DataFrame) -> DataFrame:
    """Inverse prerequisite index: distinct ``(reference, dependent)``."""
    edges = reference_edges(req_nodes.where(F.col("relation") == "prerequisite"))
    return edges.select(F.col("ref").alias("reference"), F.col("owner").alias("dependent"))


def subject_edges(req_nodes: DataFrame) -> DataFrame:
    """``(subject, ref_subject, first_at)``: which subjects the courses of a subject mention.

    ``first_at`` orders mentions by course, relation and place in the text.
    """
    order = F.array_position(F.array(*map(F.lit, RELATIONS)), F.col("relation")).cast("int")
    mention = F.when(F.col("kind") == "course", F.split_part("code", F.lit(" "), F.lit(1))).otherwise(F.col("pat_subject"))
    mentions = req_nodes.where(F.col("kind").isin("course", "coursePattern")).select(
        F.split_part("owner", F.lit(" "), F.lit(1)).alias("subject"),
        mention.alias("ref_subject"),
        F.struct(F.col("owner").alias("owner"), order.alias("relation"), F.col("steps").alias("steps")).alias("at"),
    )
    return mentions.groupBy("subject", "ref_subject").agg(F.min("at").alias("first_at"))


def crawl_closure(subjects: DataFrame, edges: DataFrame, seeds=None, max_subjects: int | None = None) -> DataFrame:
    """Subjects a first-in-first-out crawl fetches: ``(subject, fetched, crawl_order)``.

    Starts from the known ``seeds``, follows mentions of known subjects, stops after
    ``max_subjects``.  The queue order of one round is a global row number; it runs over at most
    26**4 subject codes, however large the catalog.
    """
    seeds = list(seeds or SEED_SUBJECTS)
    spark = subjects.sparkSession
    known = subjects.select(F.col("code").alias("subject")).distinct()
    start = spark.createDataFrame(list(enumerate(seeds)), "at int, subject string").join(known, "subject", "left_semi")
    store = Staged(spark)
    by_seed = Window.orderBy("at")
    taken = store.append(start.select("subject", F.row_number().over(by_seed).alias("crawl_order")))["rows"]
    grown = taken
    while grown and (max_subjects is None or taken < max_subjects):
        front = store.last().where(F.lit(max_subjects is None) | (F.col("crawl_order") <= (max_subjects or 0)))
        found = front.join(edges, "subject").groupBy("ref_subject").agg(F.min(F.struct("crawl_order", "first_at")).alias("at"))
        fresh = found.withColumnRenamed("ref_subject", "subject").join(known, "subject", "left_semi")
        fresh = fresh.join(store.all().select("subject"), "subject", "left_anti")
        number = F.row_number().over(Window.orderBy("at")) + F.lit(taken)
        grown = store.append(fresh.select("subject", number.cast("int").alias("crawl_order")))["rows"]
        taken += grown
    queued = store.all()
    fetched = queued if max_subjects is None else queued.where(F.col("crawl_order") <= max_subjects)
    order = known.join(fetched, "subject", "left")
    return order.select("subject", F.col("crawl_order").isNotNull().alias("fetched"), "crawl_order")
