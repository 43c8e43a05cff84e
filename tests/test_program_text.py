from helpers import rows
from pyspark.sql import functions as F

from trellis.functions import text as T
from trellis.operators import program_text
from trellis.operators.notes import parse_notes
from trellis.operators.program_text import parse_programs, text_lines


def row(left, credits):
    return f"{left:<62}{credits:>4}"


TEXT = "\n".join([
    " Handbook of the year, with a line that only mentions Major Requirements in passing", " Major Requirements",
    " Field Study Course(s)",
    row(" GEOG                          Note: [GEOG 1200 OR GEOG 1250]", "2-5"),
    row("    GEOG       1200            Maps and Surveys", "2"), row("    GEOG       1250            Surveys by Satellite", "5"),
    " Required Course(s)", "",
    row(" ARTS                          Note: (ARTS 2100 AND ARTS 2200)", "7"),
    row("    ARTS       2100            Drawing from Life", "3"), row("    ARTS       2200            Printmaking Workshop", "4"),
    " Elective(s)", row(" MUSI          3000            Anything Musical", "3"),
    " River and Coast / Harbour Area", row(" GEOG          4310            Tides", "3"), "", row(" GEOG          4320            Dunes", "3"),
    " Track Study", " Museum Guide Track", row(" ARTS          4500            Exhibitions", "3"),
    " Remarks on course(s)", "",
])

TRICKY = "\r\n".join([
    "Major Requirements", " Required Course(s)",
    row(" ELEC/IEDA/                    Note: MATH 2411 OR", "3"),
    " MATH                          ELEC 2600 (any one)",
    row("    ELEC       2600            Signals", "4"),
    row(" COMP          2011            Programming", "4"),
    "                               with Data Structures",
    row(" COMP/ELEC     2012H           Honors", "5"),
    "            Page 2", "  Running header Course(s)",
    row(" COMP          2011            Programming again", "4"),
    row(" PHYS                          2 courses from the list below", "6"),
    row("    PHYS       1112            Mechanics", "3"),
    row("    PHYS       1114            Waves", "3"),
    row(" CHEM                          Note: Students should take CHEM 1010 or seek advice", "3"),
    " Stream(s)",
    row(" COMP          Area Courses [take any two]", "6"),
    "  Networking Area", row(" COMP          4621            Networks", "3"),
    " AI Option", " Robotics Area", row(" COMP          4901B-4901C**   Topics", "3"),
    "Students take at least one course here",
    " Remarks on course(s)",
])


def parse(spark):
    texts = spark.createDataFrame([("A", TEXT), ("B", TRICKY), ("C", "nothing here")], "program string, text string")
    return parse_programs(text_lines(texts))


def test_programs(spark):
    got = parse(spark)
    assert rows(got.failed, "program") == [("C",)]
    assert rows(got.sections.where("program = 'A'"), "title", "credits") == [("Field Study Course(s)", "2-5"), ("Required Course(s)", "7")]
    tree = got.tree.join(got.sections, ["program", "section_at"])
    a = rows(tree.where("program = 'A'"), "title", "path", "kind", "code", "note")
    assert a == sorted([
        ("Field Study Course(s)", "0.0", "or", None, "Note: [GEOG 1200 OR GEOG 1250]"),
        ("Field Study Course(s)", "0.0.0", "course", "GEOG 1200", None),
        ("Field Study Course(s)", "0.0.1", "course", "GEOG 1250", None),
        ("Required Course(s)", "0.0", "course", "ARTS 2100", None),
        ("Required Course(s)", "0.1", "course", "ARTS 2200", None),
    ], key=repr)
    assert rows(got.branches.where("program = 'A'"), "id", "kind", "title", "parent", "group") == [
        ("branch:01:area", "area", "River and Coast / Harbour Area", None, None),
        ("branch:02:track", "track", "Museum Guide Track", None, "Track Study"),
    ]
    assert rows(got.branch_courses.where("program = 'A'"), "code") == [("ARTS 4500",), ("GEOG 4310",), ("GEOG 4320",)]
    b = rows(tree.where("program = 'B'"), "path", "kind", "code")
    assert b == sorted([
        ("0.0", "or", None), ("0.0.0", "course", "MATH 2411"), ("0.0.1", "course", "ELEC 2600"),
        ("0.1", "course", "COMP 2011"), ("0.2", "course", "COMP 2012H"),
        ("0.3", "or", None), ("0.3.0", "course", "PHYS 1112"), ("0.3.1", "course", "PHYS 1114"),
        ("0.4", "course", "CHEM 1010"),
    ], key=repr)
    assert rows(got.sections.where("program = 'B'"), "credits") == [("25",)]
    assert ("ELEC 2600", "Signals", "4") in rows(got.courses.where("program = 'B'"), "code", "title", "credits")
    assert ("COMP 2011", "", "") in rows(got.courses.where("program = 'B'"), "code", "title", "credits")
    assert rows(got.branches.where("program = 'B'"), "id", "title", "parent", "group", "rule", "credits") == [
        ("branch:01:group", "Area Courses", None, "Stream(s)", "take any two", "6"),
        ("branch:02:area", "Networking Area", "branch:01:group", "Area Courses", "", None),
        ("branch:03:option", "AI Option", "branch:01:group", "Area Courses", "", None),
        ("branch:04:area", "Robotics Area", "branch:03:option", "Area Courses", "Students take at least one course here", None),
    ]
    assert rows(got.branch_courses.where("program = 'B'"), "branch_at", "code")[-1][1] == "COMP 4901B"


def test_notes(spark):
    notes = {
        "a": "Note: MATH 1003 OR MATH 1005 OR MATH 1006",
        "b": "Note: [(MATH 1013 OR MATH 1023) AND (MATH 1014 OR MATH 1024)] OR [MATH 1020]",
        "c": "Note: (COMP 2011 AND COMP 2012) OR COMP 2012H (2 courses out of 4)",
        "d": "Note: students may skip COMP 1021",
        "e": "Note: COMP 1021 COMP 1022",
        "f": "Note: (COMP 1021 OR COMP 1022",
        "g": "Note: COMP-1021",
        "h": "no note",
    }
    got = parse_notes(spark.createDataFrame(list(notes.items()), "id string, text string"), ["id"])
    out = {}
    for r in got.orderBy("id", "steps").collect():
        out.setdefault(r.id, []).append((r.path, r.code or r.kind))
    assert sorted(out) == ["a", "b", "c", "g"]
    assert out["a"] == [("0", "or"), ("0.0", "MATH 1003"), ("0.1", "MATH 1005"), ("0.2", "MATH 1006")]
    assert out["b"] == [
        ("0", "or"), ("0.0", "and"), ("0.0.0", "or"), ("0.0.0.0", "MATH 1013"), ("0.0.0.1", "MATH 1023"),
        ("0.0.1", "or"), ("0.0.1.0", "MATH 1014"), ("0.0.1.1", "MATH 1024"), ("0.1", "MATH 1020"),
    ]
    assert out["c"] == [("0", "or"), ("0.0", "and"), ("0.0.0", "COMP 2011"), ("0.0.1", "COMP 2012"), ("0.1", "COMP 2012H")]
    assert out["g"] == [("0", "COMP 1021")]


def test_branches_need_no_trees(spark, monkeypatch):
    def unwanted(*_):
        raise AssertionError("only branches were asked for")

    monkeypatch.setattr(program_text, "section_rows", unwanted)
    monkeypatch.setattr(program_text, "section_trees", unwanted)
    got = parse(spark)
    assert ("A", "Museum Guide Track") in rows(got.branches, "program", "title")


def test_trimming_takes_every_kind_of_space(spark):
    texts = ["", " ", "a", "\t a b　 \n", "﻿\xa0x\x0b", "​z​"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = rf"^{T.SPACE}+|{T.SPACE}+\z"
    got = df.select("t", T.trim_space("t"), T.trim_end(F.col("t")), F.regexp_replace("t", pattern, ""), F.regexp_replace("t", rf"{T.SPACE}+\z", "")).collect()
    assert all(r[1] == r[3] and r[2] == r[4] for r in got)
    assert {r[0]: r[1] for r in got} == dict(zip(texts, ["", "", "a", "a b", "x", "​z​"]))
