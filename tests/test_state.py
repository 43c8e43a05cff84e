"""Sources, student state, refresh and the toggle stream on small literal tables."""

import json

import pytest
from helpers import rows
from pyspark.sql import functions as F

from trellis.operators import ordered, program_sync, refresh, requirements, students
from trellis.plans.queries import QUERIES
from trellis.plans.workspace import Workspace
from trellis.sources import catalog_files, documents, pages, program_files, snapshots
from trellis.streaming import toggles

INDEX = """<html><h1 class="page-title">Undergraduate Courses 2026-27</h1><ul class="subject-list">
<li class="subject"><a href="/ugcourse/2026-27/COMP/"></a><div class="subject-code">comp</div><div class="subject-name">Computer &amp; Science</div></li>
<li class="subject"><div class="subject-code">MATH</div><div class="subject-name">no link</div></li></ul></html>"""
PAGE = """<h1 class="page-title">Fine Arts (2026-27)</h1><div class="subject-name"><span class="subject-code">ARTS</span></div>
<ul class="crse-list"><li class="crse accordion-item"><div class="crse-header x"><div class="crse-code">ARTS 2150</div><div class="crse-title">Woodcut &amp; Etching</div><div class="crse-unit">4</div></div>
<div class="crse-detail"><div class="data-row"><div class="header">Prerequisite(s)</div><div class="data"><div>ARTS 1100 OR <i>DRAW 1010</i></div></div></div>
<div class="data-row"><span><div class="header">Exclusion(s)</div></span><div class="x"><div class="data">ARTS 2160</div></div></div>
<div class="data-row long"><div class="header">Description</div><div class="data">Tools<ul><li>and plates</li></ul></div></div></div></li>
<li class="crse"><div class="crse-header"><div class="crse-code">DRAW 1010</div><div class="crse-title">Of another subject</div></div><div class="crse-detail"></div></li></ul>"""


def test_pages(spark):
    raw = spark.createDataFrame([("/i", "2026-27", INDEX), ("/j", "2025-26", INDEX)], "url string, year string, html string")
    found, bad = pages.extract_subjects(raw, "https://host")
    assert rows(found, "code", "name", "source_url") == [("COMP", "Computer & Science", "https://host/ugcourse/2026-27/COMP/")]
    assert rows(bad, "url") == [("/j",)]
    raw = spark.createDataFrame([("/c", "2026-27", "arts", PAGE), ("/d", "2026-27", "DRAW", PAGE)], "url string, year string, subject string, html string")
    courses, stated, rejected = pages.extract_courses(raw)
    assert rows(courses, "code", "title", "credits", "description", "source_url") == [("ARTS 2150", "Woodcut & Etching", "4", "Tools and plates", "/c")]
    # The exclusion's label and value are no direct children of their row.
    assert rows(stated, "owner", "relation", "raw") == [("ARTS 2150", "prerequisite", "ARTS 1100 OR DRAW 1010")]
    assert rows(rejected) == [("/d", "page of another subject")]


def test_documents(spark, tmp_path):
    expression = {"type": "all", "items": [{"type": "course", "code": "COMP 2011", "qualifier": "B+"}, {"type": "any", "items": [{"type": "course", "code": "MATH 1013"}, {"type": "condition", "text": "x"}]}]}
    course = {"year": "2026-27", "code": "COMP 4211", "subject": "COMP", "number": "4211", "title": "ML", "credits": "3", "description": "", "source_url": "",
              "requirements": {"prerequisite": {"relation": "prerequisite", "raw": "r", "status": "parsed", "warnings": [], "expression": expression}, "corequisite": None}}
    doc = {"year": "2026-27", "generatedAt": "t", "source": "s", "sourceHash": "h", "subjects": [{"code": "COMP", "name": "C", "source_url": "", "fetched": True}], "courses": {"COMP 4211": course}}
    (tmp_path / "good").mkdir()
    (tmp_path / "good" / "a.json").write_text(json.dumps(doc))
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "b.json").write_text('{"year": "2026-27"}')
    book = documents.read_catalog(spark, str(tmp_path / "broken"), fallback=str(tmp_path / "good"))
    assert rows(book["courses"], "code", "title") == [("COMP 4211", "ML")]
    assert rows(book["req_nodes"], "path", "kind", "code", "mandatory") == [
        ("0", "all", None, True), ("0.0", "course", "COMP 2011", True), ("0.1", "any", None, True), ("0.1.0", "course", "MATH 1013", False), ("0.1.1", "condition", None, False),
    ]
    program = {
        "id": "P-2025-26", "programCode": "P", "program": "Prog", "intake": "2025-26", "catalogYear": "2026-27", "totalCredits": "6", "sourceUrl": "", "sourceHash": "", "generatedAt": "t",
        "sections": [{"id": "req", "pdfSection": "Required Course(s)", "eyebrow": "e", "title": "t", "rootGroup": "group:req", "credits": "6 credits",
                      "tree": {"kind": "and", "items": [{"kind": "or", "note": "Note: 2 courses", "items": [{"kind": "course", "code": "A"}, {"kind": "course", "code": "B"}]}]}}],
        "groups": [], "courses": [{"code": "A", "title": "a", "credits": "3", "parent": "g", "section": "req"}],
        "branches": [{"id": "branch:01:area", "kind": "area", "title": "x", "parent": None, "group": None, "rule": "", "credits": None, "courses": [{"code": "C", "title": "c", "credits": "3"}]}],
        "contextCourses": [], "relations": [],
    }
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "p.json").write_text(json.dumps(program))
    tables = documents.read_programs(spark, str(tmp_path / "p"))
    assert rows(tables["tree"], "path", "kind", "code", "note") == [("0.0", "or", None, "Note: 2 courses"), ("0.0.0", "course", "A", None), ("0.0.1", "course", "B", None)]
    parsed = documents.parsed_from_documents(tables)
    assert rows(parsed["sections"], "title", "credits") == [("Required Course(s)", "6")]
    assert rows(parsed["courses"], "code", "section_at") == [("A", 0)]


def test_snapshots(spark):
    texts = {
        1: "not json", 2: "[1]", 3: '{"format":"other","years":{"2026-27":{}}}', 4: '{"unrelated":true}', 5: '{"format":"app"}',
        6: '{"targets":["comp 2211",7,null],"completed":["COMP 1023"]}', 7: '{"years":{"2026-27":{"targets":"x","completed":["MATH 1013"]},"bad":3},"major":"P1","preferences":{"theme":"pink","hideFulfilledPrereq":false}}',
    }
    got = snapshots.read_snapshots(spark.createDataFrame(list(texts.items()), "student int, text string"), "app")
    assert rows(got["rejected"]) == [(1, "not valid JSON"), (2, "not a snapshot"), (3, "exported by another application"), (4, "no usable data")]
    assert rows(got["codes"]) == [(6, "", "completed", "COMP 1023"), (6, "", "targets", "COMP 2211"), (7, "2026-27", "completed", "MATH 1013")]
    assert rows(got["programs"], "student", "id") == [(7, "P1")]
    assert rows(got["preferences"], "student", "hide_fulfilled", "theme") == [(5, None, None), (6, None, None), (7, False, None)]
    merged, summary, skipped = students.merge_snapshots(
        spark.createDataFrame([(6, "2026-27", "targets", "COMP 1023")], "student int, year string, kind string, code string"), got["codes"], "2026-27"
    )
    assert merged.count() == 4 and skipped.count() == 0
    assert rows(summary.where("student = 6")) == [(6, "2026-27", "completed", 1, 1), (6, "2026-27", "targets", 2, 1)]


def test_blocked_scans_cross_blocks(spark):
    df = spark.range(0, 1000).select((F.col("id") % 2).alias("k"), F.col("id").cast("int").alias("n"))
    event = F.when(F.col("n") % 97 == 0, F.struct(F.col("n").alias("v")))
    got = ordered.carry(df, ["k"], "n", {"last": event}, block=16)
    for r in got.collect():
        want = [x for x in range(0, r.n) if x % 97 == 0 and x % 2 == r.k]
        assert (r["last"]["v"] if r["last"] else None) == (want[-1] if want else None)
    sums = ordered.running_total(df, ["k"], "n", F.col("n"), "before", block=16)
    assert all(r.before == sum(x for x in range(r.n) if x % 2 == r.k) for r in sums.collect())


def test_scans_read_their_input_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(n):
        seen.add(1)
        return n

    df = spark.range(300).select(F.lit("a").alias("k"), F.udf(note, "long")("id").alias("n"))
    for block, times in ((16, 1), (8192, 2)):  # many blocks, and one
        got = rows(ordered.carry(df, ["k"], "n", {"last": F.when(F.col("n") % 7 == 0, F.col("n"))}, block=block), "n", "last")
        assert got == sorted(((n, (n - 1) // 7 * 7 if n else None) for n in range(300)), key=repr)
        assert seen.value == 300 * times


def test_program_relations_need_no_groups(spark, monkeypatch):
    def unwanted(*_):
        raise AssertionError("nothing of it is shown")

    w = Workspace(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(program_sync, "materialize_groups", unwanted)
    assert QUERIES["g_filter"](w).count() > 0
    monkeypatch.setattr(program_sync, "context_courses", unwanted)
    w = Workspace(spark, w.sf_dir)
    assert QUERIES["g_relation_diff"](w).count() > 0 and "parsed" not in w.__dict__



def test_parent_chains(spark):
    items = spark.createDataFrame([("p", f"n{i}", f"n{i - 1}" if i else None) for i in range(15)] + [("p", "x", "y"), ("p", "y", "x"), ("p", "z", "gone")], "program string, id string, parent string")
    depth = dict(rows(program_sync.parent_depths(items), "id", "depth"))
    assert depth["n0"] == 0 and depth["n7"] == 7 and depth["n14"] == 12 and depth["z"] == 0 and depth["x"] == 12
    assert rows(program_sync.ancestors(items).where("id = 'n2'"), "ancestor") == [("n0",), ("n1",)]


def test_write_if_changed(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "t0"), ("b", 2, "t0")], "program string, x int, generated_at string")
    new = spark.createDataFrame([("a", 1, "t1"), ("b", 3, "t1"), ("c", 4, "t1")], "program string, x int, generated_at string")
    path = str(tmp_path / "out")
    states = refresh.write_if_changed(old, new, ["program"], path, "program")
    assert rows(states) == [("a", "unchanged"), ("b", "changed"), ("c", "added")]
    assert rows(spark.read.parquet(path), "program", "x") == [("b", 3), ("c", 4)]


def test_toggle_stream_is_idempotent(spark, tmp_path):
    req = spark.createDataFrame([("COMP 2011", "prerequisite", "COMP 1021")], "owner string, relation string, raw string")
    nodes, _ = requirements.parse_requirements(req)
    nodes = nodes.persist()
    courses = spark.createDataFrame([("COMP 2011",), ("COMP 1021",)], "code string")
    targets = spark.createDataFrame([(1, "COMP 2011"), (2, "COMP 2011")], "student bigint, code string")

    def batch(*events):
        return spark.createDataFrame(list(events), "student bigint, code string, done boolean, ts string, event_id bigint").withColumn("ts", F.col("ts").cast("timestamp"))

    tables = toggles.ToggleTables(spark, str(tmp_path / "t"), 2)
    first = batch((1, "COMP 1021", True, "2026-01-02", 5), (2, "COMP 1021", True, "2026-01-01", 1))
    late = batch((1, "COMP 1021", False, "2026-01-01", 9), (2, "COMP 1021", False, "2026-01-03", 2))
    toggles.apply_batch(tables, first, 0, targets, courses, nodes)
    assert rows(tables.statuses()) == [(1, "COMP 2011", "met"), (2, "COMP 2011", "met")]
    for _ in range(2):  # a replay changes nothing
        toggles.apply_batch(tables, late, 1, targets, courses, nodes)
        assert rows(tables.statuses()) == [(1, "COMP 2011", "met"), (2, "COMP 2011", "unmet")]
    for n in (2, 3, 4):
        toggles.apply_batch(tables, batch((2, "COMP 1021", n % 2 == 0, f"2026-02-0{n}", 10 + n)), n, targets, courses, nodes)
    assert rows(tables.statuses()) == [(1, "COMP 2011", "met"), (2, "COMP 2011", "met")]
    assert tables.toggles().count() == 2
    kept = [p for p in (tmp_path / "t" / "statuses").glob("batch=*/bucket=*")]
    assert len(kept) <= 4


def test_toggle_buckets_split_with_the_data(spark, tmp_path):
    nodes, _ = requirements.parse_requirements(spark.createDataFrame([("COMP 2011", "prerequisite", "COMP 1021")], "owner string, relation string, raw string"))
    nodes = nodes.persist()
    courses = spark.createDataFrame([("COMP 2011",), ("COMP 1021",)], "code string")
    events = lambda lo, hi, done=True: spark.range(lo, hi).select(
        F.col("id").alias("student"), F.lit("COMP 1021").alias("code"), F.lit(done).alias("done"), F.lit(f"2026-01-{1 + lo % 9}").cast("timestamp").alias("ts"), F.col("id").alias("event_id"))
    targets = spark.range(2000).select(F.col("id").alias("student"), F.lit("COMP 2011").alias("code"))
    tables = toggles.ToggleTables(spark, str(tmp_path / "t"), 100)

    def sizes(before=None):
        return {r.bucket: r.rows for r in tables.buckets("toggles", before).collect()}

    # One student with more rows than the bound stays whole and does not hinder the others.
    own = spark.range(150).select(F.lit(7).cast("long").alias("student"), F.format_string("X %d", "id").alias("code"), F.lit(True).alias("done"), F.lit("2026-01-01").cast("timestamp").alias("ts"), "id").withColumnRenamed("id", "event_id")
    for n, one in enumerate([events(0, 60), events(60, 900), own, events(900, 2000), events(0, 2000).limit(0), events(5, 6, False)]):
        for _ in range(2 if n in (1, 5) else 1):  # a replay starts from the buckets before it
            toggles.apply_batch(tables, one, n, targets, courses, nodes)
        found = sizes()
        # The buckets cover every hash once, and hold what the files hold.
        assert sum(2.0 ** (1 - len(b)) for b in found) == 1 and sum(found.values()) == tables.toggles().count()
        assert sorted(v for v in found.values() if v > 100) in ([], [150], [151]) and (n or len(found) == 1)
    assert len(found) > 2150 / 100 and tables.toggles().count() == 2150
    assert rows(tables.statuses().groupBy("status").count()) == [("met", 1999), ("unmet", 1)]
    # A batch that touches one student rewrites one bucket, and older versions go.
    assert len(list((tmp_path / "t/toggles/batch=5").glob("bucket=*"))) == 1
    assert len(list((tmp_path / "t/toggles").glob("batch=*/bucket=*"))) <= len(found) + 1 and len(list((tmp_path / "t/toggles_buckets").glob("batch=*"))) == 2


def test_unique_ids_of_one_base(spark):
    """A hundred thousand sections of one name, between taken numbers."""
    n = 100_000
    sections = spark.range(n).select(F.lit("p").alias("program"), F.col("id").alias("at"), F.lit("core").alias("base"))
    sections = sections.unionByName(spark.createDataFrame([("p", 5, "free"), ("p", 6, "free"), ("q", 7, "core"), ("p", 8, "core-2")], "program string, at long, base string"))
    taken = ["core", "core-3", "core-4", "core-9", "core-9", f"core-{n}", "other-2", "core-x", "core-1"]
    used = spark.createDataFrame([("p", x) for x in taken], "program string, id string")
    got = {(r.program, r.base, r["at"]): r.id for r in program_sync.unique_ids(sections, used).collect()}
    numbers = (k for k in range(2, 2 * n) if k not in (3, 4, 9, n))
    assert [got["p", "core", k] for k in range(n)] == [f"core-{next(numbers)}" for _ in range(n)]
    assert (got["p", "free", 5], got["p", "free", 6], got["q", "core", 7], got["p", "core-2", 8]) == ("free", "free-2", "core", "core-2")


def program(spark, titles):
    """Tables of small programs, as the reconciliation gives them."""
    t = lambda rows_, schema: spark.createDataFrame(rows_, schema)
    ids = range(len(titles))
    return dict(
        headers=t([(i, f"P{i}-2025-26", f"P{i}", x, "2025-26", "2026-27", "7", "/doc", "h") for i, x in enumerate(titles)],
                  "program int, id string, program_code string, title string, intake string, catalog_year string, total_credits string, source_url string, source_hash string"),
        sections=t([(i, 3, "core", "CORE", "Core", "Core \"x\"", "group:core", None, None, "7 credits") for i in ids],
                   "program int, section_at int, id string, label string, eyebrow string, title string, root_group string, copy string, source_link string, credits string"),
        tree=t([(i, 3, p, s, k, c, n) for i in ids for p, s, k, c, n in [("0.0", [0, 0], "or", None, "Note: pick"), ("0.0.0", [0, 0, 0], "course", "ARTS 1100", None), ("0.0.1", [0, 0, 1], "course", "DRAW 1010", None), ("0.1", [0, 1], "course", "HIST 1500", None)]],
               "program int, section_at int, path string, steps array<int>, kind string, code string, note string"),
        groups=t([(i, "group:core", "Core | AND", "and", None) for i in ids], "program int, id string, label string, kind string, parent string"),
        courses=t([(i, 3, [k], c, c.lower(), "3", "group:core", "core") for i in ids for k, c in enumerate(["HIST 1500", "ARTS 1100", "DRAW 1010"])],
                  "program int, section_at int, first_at array<int>, code string, title string, credits string, parent string, section string"),
        context=t([(0, "MUSI 1000", "Song")], "program int, code string, title string"),
        branches=t([(0, 9, 1, "branch:01:area", "area", "Harbour Area", None, None, "", None)], "program int, branch_at int, number int, id string, kind string, title string, parent string, group string, rule string, credits string"),
        branch_courses=t([(0, 9, 2, "GEOG 4320", "Dunes", "3"), (0, 9, 1, "GEOG 4310", "Tides", "3")], "program int, branch_at int, line_no int, code string, title string, credits string"),
        relations=t([(i, "HIST 1500", "ARTS 1100", "prerequisite", 1, 0, "HIST 1500") for i in ids], "program int, source string, target string, relation string, group int, position int, raw string"),
    )


def test_program_files(spark, tmp_path):
    files = program_files.ProgramFiles(spark, str(tmp_path / "out"))
    made = lambda titles, stamp: program_files.program_documents(**program(spark, titles), generated_at=stamp)
    assert files.version() == 0 and files.manifest().count() == 0 and all(x.count() == 0 for x in files.read().values())
    assert rows(files.publish(made(["One", "Two"], "t1"), check=True)) == [("P0-2025-26", "added"), ("P1-2025-26", "added")] and files.version() == 0
    files.publish(made(["One", "Two"], "t1"))
    text = [json.loads(x) for f in (tmp_path / "out/documents/version=1").glob("part-*") for x in f.read_text().splitlines()]
    doc = next(d for d in text if d["id"] == "P0-2025-26")
    assert doc["sections"][0]["tree"] == {"kind": "and", "items": [{"kind": "or", "note": "Note: pick", "items": [{"kind": "course", "code": "ARTS 1100"}, {"kind": "course", "code": "DRAW 1010"}]}, {"kind": "course", "code": "HIST 1500"}]}
    assert [x["code"] for x in doc["courses"]] == ["HIST 1500", "ARTS 1100", "DRAW 1010"] and doc["sections"][0]["title"] == 'Core "x"'
    assert [x["code"] for x in doc["branches"][0]["courses"]] == ["GEOG 4310", "GEOG 4320"] and doc["generatedAt"] == "t1" and doc["schemaVersion"] == 2
    read = files.read()
    assert rows(read["tree"].where("program = 'P1-2025-26'"), "path", "kind", "code", "note") == rows(program(spark, ["x"])["tree"], "path", "kind", "code", "note")
    assert rows(read["branch_courses"], "line_no", "code") == [(0, "GEOG 4310"), (1, "GEOG 4320")] and rows(read["context"], "code") == [("MUSI 1000",)]
    # Another stamp alone changes nothing; a title moves one program, and a lost one goes.
    assert rows(files.publish(made(["One", "Two"], "t2"))) == [("P0-2025-26", "unchanged"), ("P1-2025-26", "unchanged")] and files.version() == 1
    assert rows(files.publish(made(["One", "Zwei", "Three"], "t3"))) == [("P0-2025-26", "unchanged"), ("P1-2025-26", "changed"), ("P2-2025-26", "added")]
    assert rows(files.manifest(), "id", "program", "documentVersion", "courses") == [("P0-2025-26", "One", 1, 3), ("P1-2025-26", "Zwei", 2, 3), ("P2-2025-26", "Three", 2, 3)]
    assert rows(files.read()["headers"], "title", "generated_at") == [("One", "t1"), ("Three", "t3"), ("Zwei", "t3")]
    # A refresh that did not finish is not read, and the next one takes its place.
    (tmp_path / "out/documents/version=3").mkdir()
    (tmp_path / "out/documents/version=3/part-0.txt").write_text("half a docum")
    assert rows(files.read()["headers"], "title") == [("One",), ("Three",), ("Zwei",)]
    assert rows(files.publish(made(["One"], "t4"))) == [("P0-2025-26", "unchanged"), ("P1-2025-26", "removed"), ("P2-2025-26", "removed")]
    assert files.version() == 3 and rows(files.read()["headers"], "title") == [("One",)]
    with pytest.raises(ValueError, match="repeats"):
        files.publish(made(["a"], "t").unionByName(made(["b"], "t")))


def catalog(spark, titles, years=("2024", "2025")):
    """One course and one subject per year, with a prerequisite tree of one leaf."""
    courses = [(y, f"ARTS {1000 + i}", "ARTS", str(1000 + i), t, "3", None, "") for i, (y, t) in enumerate(zip(years, titles))]
    keys = [(c[0], c[1], "prerequisite") for c in courses]
    nodes = [(*k, "0", [0], "course", "DRAW 1010", None, None, None, None, 0) for k in keys]
    return dict(
        courses=spark.createDataFrame(courses, "year string, code string, subject string, number string, title string, credits string, description string, source_url string"),
        subjects=spark.createDataFrame([(y, "ARTS", "Arts", "", True) for y in years], "year string, code string, name string, source_url string, fetched boolean"),
        requirements=spark.createDataFrame([(*k, "DRAW 1010", "parsed", []) for k in keys], "year string, owner string, relation string, raw string, status string, warnings array<string>"),
        req_nodes=spark.createDataFrame(nodes, "year string, owner string, relation string, path string, steps array<int>, kind string, code string, qualifier string, pat_subject string, pat_min_level int, text string, ordinal int"),
    )


def test_catalog_versions(spark, tmp_path):
    files = catalog_files.CatalogFiles(spark, str(tmp_path / "book"))
    publish = lambda titles, stamp, **kw: rows(files.publish(**catalog(spark, titles), source="s", generated_at=stamp, **kw))
    assert rows(files.years()) == [] and files.read()["courses"].count() == 0
    assert publish(["One", "Two"], "t1", check=True) == [("2024", "added"), ("2025", "added")] and files.version() == 0
    publish(["One", "Two"], "t1")
    assert publish(["One", "Two"], "t2") == [("2024", "unchanged"), ("2025", "unchanged")] and files.version() == 1
    assert publish(["Uno", "Two"], "t2") == [("2024", "changed"), ("2025", "unchanged")]
    book = files.read()
    assert rows(book["courses"], "year", "title") == [("2024", "Uno"), ("2025", "Two")]
    assert rows(book["req_nodes"], "year", "owner", "code") == [("2024", "ARTS 1000", "DRAW 1010"), ("2025", "ARTS 1001", "DRAW 1010")]
    assert rows(book["meta"], "year", "generated_at") == [("2024", "t2"), ("2025", "t1")] and rows(book["subjects"], "year", "name") == [("2024", "Arts"), ("2025", "Arts")]
    # A version that was never committed is not seen, and the next one takes its place.
    files._write(*(lambda l: (l, catalog_files._checked(l)))(files._read_lines([("2025", 1)]).drop("version")), "s", "t9")
    (tmp_path / "book/COMMIT/3").unlink()
    assert rows(files.years()) == [("2024", 2, "current"), ("2025", 1, "current")]
    # A line is lost in the newest copy of one year: the copy before it is read; the other year stays.
    newest = next((tmp_path / "book/lines/version=2/year=2024/kind=courses").glob("part-*"))
    newest.write_text("")
    for crc in newest.parent.glob(".part-*"):
        crc.unlink()
    book = files.read()
    assert rows(book["years"]) == [("2024", 1, "fallback"), ("2025", 1, "current")] and rows(book["courses"], "title") == [("One",), ("Two",)]
    # The next refresh writes the damaged year again, though its content is what was published.
    assert publish(["Uno", "Two"], "t3") == [("2024", "changed"), ("2025", "unchanged")]
    assert rows(files.years()) == [("2024", 3, "current"), ("2025", 1, "current")] and rows(files.read()["courses"], "title") == [("Two",), ("Uno",)]
    # Without courses a year is rejected, without any row it is kept.
    gone = catalog(spark, ["Uno", "Two"])
    gone["courses"] = gone["courses"].limit(0)
    gone["subjects"] = gone["subjects"].where("year = '2024'")
    assert rows(files.publish(**gone, source="s", generated_at="t4")) == [("2024", "rejected"), ("2025", "kept")] and files.version() == 3
    # No whole copy at all.
    for n in (1, 2, 3):
        files._clear(f"{files.path}/lines/version={n}/year=2024")
    assert rows(files.years()) == [("2024", None, "unreadable"), ("2025", 1, "current")] and rows(files.read()["courses"], "title") == [("Two",)]
