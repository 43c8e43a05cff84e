import pytest
from helpers import rows
from pyspark.sql import functions as F

from trellis.functions import text as T
from trellis.operators import catalog, requirements, search_index
from trellis.plans.queries import QUERIES
from trellis.plans.workspace import Workspace


def test_text_functions(spark):
    nbsp, dash = chr(0xA0), chr(0x2013)
    df = spark.createDataFrame([(f"  a{nbsp}b {dash} c\n", "comp4211", "  COMP-4211  ", "not a code", "c omp 1", "xx 1234z")], "a string, b string, c string, d string, e string, f string")
    r = df.select(
        T.clean_text("a"), T.strict_code("b"), T.strict_code("c"), T.strict_code("d"), T.loose_code("e"), T.valid_code("f"), T.strict_code("f"),
        T.clean_text(F.lit(None)), T.decode_entities(F.lit("&amp;lt; &#39;x&#039; &rsquo;")), T.strip_marks(F.lit("4901B**")),
        T.table_code(F.lit("COMP/ELEC"), F.lit("2012H - 2013***")), T.slug(F.lit("--!")), T.course_level(F.lit("COMP 4211")), T.is_year(F.lit("2026-27")),
        T.numeric_level(F.lit("")), T.numeric_level(F.lit("2.5")), T.numeric_level(F.lit("NaN")), T.catalog_credits(F.lit("3 Credit(s) ")),
    ).first()
    assert tuple(r) == (
        "a b - c", "COMP 4211", "COMP 4211", None, "C OMP 1", "XX 1234Z", None, "", "< 'x' " + chr(0x2019), "4901B", "COMP 2012H", "section", 4, True, None, 2.5, None, "3",
    )


CASES = {
    "COMP 2011 AND (COMP 2711 OR MATH 2111)": "all(COMP 2011,any(COMP 2711,MATH 2111))",
    "(Grade A or above in COMP 1021) OR COMP 1022": "any(COMP 1021[Grade A or above],COMP 1022)",
    "OR COMP 1022": "COMP 1022[OR]",
    "A AND": "<A AND>",
    "COMP 1011 OR (COMP 1021 AND": "any(COMP 1011,COMP 1021[( AND])",
    "": "<Unspecified requirement>",
    "any comp course of 3000-level or above": "pattern(COMP,3)",
    "comp1011/COMP 1012 , HKDSE M1/M2": "all(any(COMP 1011,COMP 1012),<HKDSE M1/M2>)",
    "[(MATH 1013 OR (MATH 1023 OR MATH 1024)) AND MATH 2111]": "all(any(MATH 1013,MATH 1023,MATH 1024),MATH 2111)",
    "COMP 1011 (prior to 2022-23)": "COMP 1011[prior to 2022-23]",
    "Pass in COMP 1011 (since 2020)": "COMP 1011[Pass; since 2020]",
    "COMP 1011 COMP 1012": "all(COMP 1011,COMP 1012)",
    "((COMP 1011))": "COMP 1011",
    "()": "<>",
    "A) OR COMP 1011 (x OR y]": "any(<A)>,COMP 1011[(x OR y]])",
    "COMP 1011; COMP 1012, COMP 1013 OR COMP 1014": "any(all(COMP 1011,COMP 1012,COMP 1013),COMP 1014)",
    "Score 3 or higher AND COMP 1011": "all(<Score 3 or higher>,COMP 1011)",
    "FOR 12 ORANGE COMP 1011": "COMP 1011[FOR 12 ORANGE]",
}


def show(nodes):
    by = {n.path: n for n in nodes}
    kids = {}
    for n in sorted(nodes, key=lambda n: n.steps):
        kids.setdefault(n.parent_path, []).append(n.path)

    def draw(p):
        n = by[p]
        if n.kind in ("any", "all"):
            return f"{n.kind}({','.join(draw(c) for c in kids[p])})"
        if n.kind == "course":
            return n.code + (f"[{n.qualifier}]" if n.qualifier else "")
        return f"pattern({n.pat_subject},{n.pat_min_level})" if n.kind == "coursePattern" else f"<{n.text}>"

    return draw("0")


def test_line_ends_close_no_code(spark):
    """Java's $ matches before a line end that closes the text; a code ends with its last sign."""
    df = spark.createDataFrame([("COMP 1023\n",), ("COMP 1023\x85",), ("2026-27\n",)], "c string")
    got = df.select(T.valid_code("c"), T.strict_code("c"), T.loose_code("c"), T.is_year("c")).collect()
    assert [tuple(x) for x in got] == [
        ("COMP 1023", "COMP 1023", "COMP 1023", False), (None, None, "COMP 1023\x85", False), (None, None, "2026-27", False)
    ]


def test_scope_of_a_subject_that_ends_in_a_line_end(spark, tmp_path):
    parts = spark.createDataFrame([(612000, "Brand#20", "x"), (0, "Brand#10", "y")], "p_partkey long, p_brand string, p_name string")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    assert rows(QUERIES["h_manifest"](Workspace(spark, str(tmp_path)))) == [("ABAA", 9), ("ACA\x85", 1)]


def test_expressions(spark):
    df = spark.createDataFrame([(str(i), "prerequisite", raw) for i, raw in enumerate(CASES)], "owner string, relation string, raw string")
    nodes, parsed = requirements.parse_requirements(df)
    found = {}
    for n in nodes.collect():
        found.setdefault(n.owner, []).append(n)
    assert {raw: show(found[str(i)]) for i, raw in enumerate(CASES)} == CASES
    status = {r.raw: (r.status, list(r.warnings)) for r in parsed.collect()}
    assert status["COMP 1011 OR (COMP 1021 AND"] == ("partial", [requirements.WARN_GROUPING])
    assert status[""] == ("partial", [requirements.WARN_EMPTY])
    assert status["COMP 1011 COMP 1012"] == ("partial", [requirements.WARN_CONNECTOR])
    assert status["()"] == ("parsed", [])


def test_long_text_is_parsed_whole(spark):
    codes = [f"COMP {1000 + i}" for i in range(1500)]
    df = spark.createDataFrame([("X", "prerequisite", " OR ".join(codes))], "owner string, relation string, raw string")
    nodes, _ = requirements.parse_requirements(df)
    refs = requirements.course_references(nodes).orderBy("position").collect()
    assert [r.ref for r in refs] == codes


def test_search_and_lookup(spark):
    courses = spark.createDataFrame([("COMP 2011", "Data Structures"), ("COMP 4211", "Machine Learning"), ("MATH 4211", "About comp")], "code string, title string")
    found = catalog.search(courses, spark.createDataFrame([("4211",), ("comp4211",), ("comp",), ("",)], "query string"), 2)
    got = {}
    for r in found.orderBy("query", "position").collect():
        got.setdefault(r["query"], []).append(r["code"])
    assert got == {"4211": ["COMP 4211", "MATH 4211"], "comp4211": ["COMP 4211"], "comp": ["COMP 2011", "COMP 4211"], "": ["COMP 2011", "COMP 4211"]}
    assert [catalog.search_limit(x) for x in (None, 0, "x", 500, -4, 7)] == [30, 30, 30, 100, 1, 7]


def test_stored_search(spark, tmp_path):
    schema = "code string, title string, credits string"
    first = [("ARTS 2011", "Data Weaving", "3"), ("ARTS 4211", "Machine Knitting", "3"), ("DRAW 4211", "About arts", "4"), ("DRAW 1010", None, "4"), (None, "lost", "1")]
    asked = spark.createDataFrame([("4211",), ("arts4211",), ("arts",), ("",), (None,), ("w",), ("weaving d",), ("KNIT",), ("dra",)], "query string")
    # Blocks and shards of a few postings: every common gram is dealt over several.
    index = search_index.SearchIndex(spark, str(tmp_path / "index"), block=2, shard=40)
    with pytest.raises(ValueError, match="no index"):
        index.search(asked)
    index.update(spark.createDataFrame(first, schema))

    def same(courses, limit=2):
        plain = catalog.search(spark.createDataFrame(courses, schema), asked, limit)
        columns = ["query", "code", "title", "credits", "rank", "position"]
        assert rows(index.search(asked, limit), *columns) == rows(plain, *columns)

    kept = first[:4]
    same(kept)
    same(kept, 30)
    assert rows(index.plan(asked).where("query = 'KNIT'"), "n") == [(1,)] and index.plan(asked).where("query = 'weaving d'").isEmpty()
    # A replaced title is found by the new one only, a removed course not at all, one taken in again is found.
    index.update(spark.createDataFrame([("ARTS 4211", "Paper", "2")], schema), spark.createDataFrame([("DRAW 4211",), ("ARTS 4211",), (None,)], "code string"))
    kept = [kept[0], ("ARTS 4211", "Paper", "2"), kept[3]]
    same(kept, 30)
    index.update(spark.createDataFrame([("DRAW 4211", "Knitting", "4")], schema))
    kept.append(("DRAW 4211", "Knitting", "4"))
    same(kept)
    before = index
    index = index.compact()
    assert index.version() == 1 and before.version() == 3 and rows(index.courses()) == rows(before.courses())
    same(kept)
    # An empty table gives an index without rows.
    index = search_index.SearchIndex(spark, str(tmp_path / "empty"))
    index.update(spark.createDataFrame([], schema))
    assert index.search(asked).isEmpty()


def test_codes_of_one_subject_meet_their_own_course(spark, tmp_path):
    courses = spark.range(300).select(F.format_string("COMP %d", F.col("id") * 7 + 1000).alias("code"), F.lit("Long introduction to computing").alias("title"))
    asked = courses.select(F.lower(F.replace("code", F.lit(" "), F.lit(""))).alias("query"))
    longer = asked.union(spark.createDataFrame([("COMP 1000 x",), ("introduction to nothing",), ("introduction to computing",)], "query string"))
    assert catalog._meetings(courses, asked).count() == 300
    found = catalog.search(courses, longer)
    assert found.where("rank = 0").count() == 300 and found.where("query = 'introduction to computing'").count() == 30 and found.count() == 330
    index = search_index.SearchIndex(spark, str(tmp_path / "index"))
    index.update(courses)
    assert index.plan(asked).agg(F.sum("n")).first()[0] == 300
    assert rows(index.search(longer), "query", "code", "rank", "position") == rows(found, "query", "code", "rank", "position")


def test_search_opens_only_asked_shards(spark, tmp_path):
    courses = spark.range(3000).select(F.format_string("C%05d", "id").alias("code"), F.sha2(F.col("id").cast("string"), 256).alias("title"))
    index = search_index.SearchIndex(spark, str(tmp_path / "index"), shard=10_000)
    index.update(courses)
    shards = len(list((tmp_path / "index/postings/version=1").glob("shard=*")))
    found = index.search(spark.createDataFrame([("C01234",)], "query string"))
    opened = {f.split("shard=")[1].split("/")[0] for f in found.inputFiles() if "shard=" in f}
    assert shards > 20 and len(opened) == 1 and rows(found, "code", "rank") == [("C01234", 0)]


def test_crawl_order_and_cap(spark):
    subjects = spark.createDataFrame([(c,) for c in ["COMP", "MATH", "ELEC", "PHYS", "CHEM", "LIFE"]], "code string")
    edges = spark.createDataFrame(
        [("COMP", "PHYS", ("COMP 1", 1, [0])), ("MATH", "CHEM", ("MATH 1", 1, [0])), ("COMP", "NOPE", ("COMP 1", 1, [1])), ("PHYS", "LIFE", ("P", 1, [0]))],
        "subject string, ref_subject string, first_at struct<owner:string,relation:int,steps:array<int>>",
    )
    everything = catalog.crawl_closure(subjects, edges).where("fetched").orderBy("crawl_order").collect()
    assert [r.subject for r in everything] == ["COMP", "MATH", "ELEC", "PHYS", "CHEM", "LIFE"]
    assert rows(catalog.crawl_closure(subjects, edges, max_subjects=4).where("fetched"), "subject") == [("COMP",), ("ELEC",), ("MATH",), ("PHYS",)]
