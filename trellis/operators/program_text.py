"""Program requirement text -> sections, AND/OR trees and branch tables.

Input ``lines(program, line_no, line)``, layout preserved.  State that runs down a document (current
section, open row, current branch) is carried by blocked scans; rows attach to it by joins.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import text as T
from trellis.operators.notes import parse_notes
from trellis.operators.ordered import carry, running_total
from trellis.session import stage

S = T.SPACE
# ---- fixed values ---------------------------------------------------------------------------
START = rf"^{S}*Major Requirements{S}*$"
REMARKS = rf"^{S}*\*{{0,3}}(?i:remarks on course\(s\))"
CORE_STOP = (
    rf"^{S}*(?i:(?:major{S}+)?(?:elective(?:s|\(s\)|{S}+courses?)?|restricted electives?|list of electives?"
    rf"|option\(s\)|track study|stream\(s\))){S}*$"
)
FOOTER = rf"(?i:page{S}+\d+{S}*$)"
CREDIT_HEADER = rf"^{S}*(?i:credit\(s\)|minimum|required|attained){S}*$"
# Indent, subjects (cross-listed with "/"), optional number(s), text, credits.
ROW = (
    rf"^([ ]*)([A-Z]{{4}}(?:{S}*/{S}*[A-Z]{{4}})*{S}*/?)[ ]+"
    rf"(?:(\d{{4}}[A-Za-z]*\*{{0,3}}(?:{S}*-{S}*\d{{4}}[A-Za-z]*\*{{0,3}})?)[ ]{{2,}})?"
    rf"(.*?)[ ]{{2,}}(\d+(?:\.\d+)?(?:-\d+(?:\.\d+)?)?\*{{0,3}}){S}*$"
)
HEADING = r"^[A-Za-z][A-Za-z0-9 ,/&()'" + chr(0x2019) + r".:-]*$"
HEADING_SUFFIX = r"(?i:course\(s\)|elective\(s\)|elective course\(s\))$"
BRANCH_SUFFIX = rf"(?i:area|track|stream|option|speciali[sz]ation|concentration|courses|others){S}*$"
CONTAINER = (
    r"^(?i:option\(s\)|track study|stream\(s\)|speciali[sz]ation\(s\)|concentration\(s\)|area courses"
    r"|study scheme|elective course\(s\)|elective\(s\))$"
)
NOT_A_BRANCH = (
    r"^(?i:required course\(s\)|elective course\(s\)|elective\(s\)|major pre-requisite course\(s\)"
    r"|engineering fundamental course\(s\)|fundamental course\(s\)|required courses?)$"
)
ELECTIVE_HEAD = rf"^(?i:.*(?<![A-Za-z0-9_])elective\(s\)|{S}*elective course\(s\))$"
GROUP_ROW = r"^(?i:area courses|stream\(s\)|speciali[sz]ation\(s\)|concentration\(s\)|study scheme)$"
AREA_CONTAINER = "Area Courses"
MAX_TITLE, MAX_WORDS, MAX_LOWER, MAX_INDENT = 95, 9, 4, 3
# ---------------------------------------------------------------------------------------------

_CUT = chr(0xFDD1)


class ProgramText:
    """The tables of all programs; each is worked out when it is first asked for."""

    def __init__(self, lines: DataFrame):
        self._given = lines

    @cached_property
    def _lines(self) -> DataFrame:
        return stage(self._given.select("program", "line_no", "line"))

    @cached_property
    def _regions(self) -> tuple[DataFrame, DataFrame]:
        return region_bounds(self._lines)

    @cached_property
    def _rows(self) -> tuple[DataFrame, DataFrame]:
        return section_rows(self._lines, self._regions[0])

    @cached_property
    def _trees(self) -> tuple[DataFrame, DataFrame]:
        return section_trees(self._rows[1])

    @cached_property
    def _branches(self) -> tuple[DataFrame, DataFrame]:
        return branch_tables(self._lines, self._regions[0])

    @cached_property
    def sections(self) -> DataFrame:
        """``(program, section_at, title, credits)``"""
        sections, rows = self._rows
        return sections.join(section_credits(rows), ["program", "section_at"], "left")

    @property
    def tree(self) -> DataFrame:
        """``(program, section_at, path, parent_path, steps, kinds, kind, code, note)``"""
        return self._trees[0]

    @property
    def courses(self) -> DataFrame:
        """``(program, section_at, code, first_at, title, credits)``"""
        return self._trees[1]

    @property
    def branches(self) -> DataFrame:
        """``(program, branch_at, number, id, kind, title, parent, group, rule, credits)``"""
        return self._branches[0]

    @property
    def branch_courses(self) -> DataFrame:
        """``(program, branch_at, line_no, code, title, credits)``"""
        return self._branches[1]

    @property
    def failed(self) -> DataFrame:
        """``(program, reason)``"""
        return self._regions[1]


def text_lines(texts: DataFrame) -> DataFrame:
    """``texts(program, text)`` -> ``(program, line_no, line)``, any line ending."""
    unix = F.regexp_replace("text", r"\r\n?", "\n")
    return texts.select("program", F.posexplode(F.split(unix, "\n")).alias("line_no", "line"))


def indent_of(line) -> Column:
    return F.length(F.regexp_extract(line, "^ *", 0))


def region_bounds(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(bounds(program, start, stop, finish), failed(program, reason))``.

    The region opens after the "Major Requirements" line and closes at the remarks; the first
    elective, option, track or stream heading ends its core.  Only marker lines are looked at twice.
    """
    marks = lines.select(
        "program", "line_no", F.col("line").rlike(START).alias("starts"),
        T.trim_space("line").rlike(REMARKS).alias("ends"), F.col("line").rlike(CORE_STOP).alias("stops"),
    ).where("starts OR ends OR stops")
    marks = stage(marks)
    start = marks.where("starts").groupBy("program").agg(F.min("line_no").alias("start"))
    after = marks.join(start, "program").where(F.col("line_no") > F.col("start"))
    finish = after.where("ends").groupBy("program").agg(F.min("line_no").alias("finish"))
    inside = after.where("stops").join(finish, "program", "left").where(
        F.col("finish").isNull() | (F.col("line_no") < F.col("finish"))
    )
    stop = inside.groupBy("program").agg(F.min("line_no").alias("stop"))
    bounds = start.join(finish, "program", "left").join(stop, "program", "left")
    failed = lines.select("program").distinct().join(start, "program", "left_anti")
    return stage(bounds), failed.select("program", F.lit("text has no requirements heading").alias("reason"))


def _prepared(lines: DataFrame) -> DataFrame:
    """Right-trimmed lines without page footers and the running header that follows each footer.

    Blank and footer lines stay as ``pause`` rows: they end an open table row.
    """
    flagged = lines.select("program", "line_no", T.trim_end("line").alias("text")).withColumn("footer", F.col("text").rlike(FOOTER))
    flagged = flagged.withColumn("pause", F.col("footer") | (F.col("text") == ""))
    seen = carry(flagged, ["program"], "line_no", {"after_footer": F.when(F.col("footer") | ~F.col("pause"), F.col("footer"))})
    header = ~F.col("pause") & F.coalesce("after_footer", F.lit(False))
    return seen.where(~header).drop("after_footer", "footer")


def _cells(lines: DataFrame) -> DataFrame:
    """Adds the cells of table rows: indent, subject, number (NULL if none), body, credits."""
    cut = F.split(F.regexp_replace("text", ROW, _CUT.join(["$1", "$2", "$3", "$4", "$5"])), _CUT)
    is_row = ~F.col("pause") & F.col("text").rlike(ROW)
    squeezed = lambda c: F.regexp_replace(c, f"{S}+", "")
    return lines.withColumn("is_row", is_row).withColumn("cell", F.when(F.col("is_row"), cut)).select(
        *lines.columns, "is_row", indent_of("text").alias("indent"),
        F.regexp_replace(F.col("cell")[1], f"{S}+", "").alias("subject"),
        F.nullif(squeezed(F.col("cell")[2]), F.lit("")).alias("number"),
        T.clean_text(F.when(F.col("is_row"), F.col("cell")[3])).alias("body"),
        T.strip_marks(F.when(F.col("is_row"), F.col("cell")[4])).alias("credits"),
    )


def section_rows(lines: DataFrame, bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(sections(program, section_at, title), rows)`` of the core region.

    ``rows(program, section_at, line_no, indent, child, subject, number, note, text, credits)``.
    """
    core = lines.join(bounds, "program").where(
        (F.col("line_no") > F.col("start"))
        & (F.col("line_no") < F.coalesce("stop", "finish", F.lit(2**31 - 1)))
    )
    marked = _cells(_prepared(core.select("program", "line_no", "line")))
    trimmed = T.trim_space("text")
    pause = F.col("pause") | F.col("text").rlike(CREDIT_HEADER)
    heading = ~pause & trimmed.rlike(HEADING) & trimmed.rlike(HEADING_SUFFIX)
    marked = marked.withColumn("stopper", pause).withColumn("heading", heading)
    marked = marked.withColumn("is_row", F.col("is_row") & ~F.col("stopper") & ~F.col("heading"))
    opened = F.when(F.col("is_row"), F.struct(F.col("line_no").alias("at"))).when(
        F.col("stopper") | F.col("heading"), F.struct(F.lit(None).cast("int").alias("at"))
    )
    run = carry(marked, ["program"], "line_no", {"section_at": F.when(F.col("heading"), F.col("line_no")), "open": opened})
    run = stage(run)
    sections = run.where("heading").select("program", F.col("line_no").alias("section_at"), T.clean_text("text").alias("title"))
    rows = run.where(F.col("is_row") & F.col("section_at").isNotNull()).select(
        "program", "section_at", "line_no", "indent", "subject", "number", F.col("body").rlike("(?i)^note:").alias("note"), "body", "credits"
    )
    more = run.where(~F.col("is_row") & ~F.col("stopper") & ~F.col("heading") & F.col("open.at").isNotNull())
    # A row's wrapped lines make up one cell of text.
    wraps = more.groupBy("program", F.col("open.at").alias("line_no")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("line_no").alias("at"), F.col("indent").alias("indent"), trimmed.alias("text")))).alias("wraps")
    )
    rows = rows.join(wraps, ["program", "line_no"], "left").withColumn("folded", _fold_wraps())
    base = rows.groupBy("program", "section_at").agg(F.min_by("indent", "line_no").alias("base"))
    rows = rows.join(base, ["program", "section_at"]).select(
        "program", "section_at", "line_no", "indent", (F.col("indent") > F.col("base")).alias("child"),
        F.col("folded.subject").alias("subject"), "number", "note", F.col("folded.text").alias("text"), "credits",
    )
    return sections, stage(rows)


def _fold_wraps() -> Column:
    """Wrapped lines joined to the row text; a cross-listed subject ending in "/" takes its rest back."""
    rest = rf"^([A-Z]{{4}}(?:{S}*/{S}*[A-Z]{{4}})*){S}+(.+)$"
    start = F.struct(F.col("subject").alias("subject"), F.col("body").alias("text"))

    def add(acc, wrap):
        takes = acc["subject"].endswith("/") & (wrap["indent"] <= F.col("indent") + 1) & wrap["text"].rlike(rest)
        subject = F.when(takes, F.concat(acc["subject"], F.regexp_extract(wrap["text"], rest, 1))).otherwise(acc["subject"])
        more = F.when(takes, F.regexp_extract(wrap["text"], rest, 2)).otherwise(wrap["text"])
        return F.struct(subject.alias("subject"), T.clean_text(F.concat_ws(" ", acc["text"], more)).alias("text"))

    return F.when(F.col("wraps").isNull(), start).otherwise(F.aggregate("wraps", start, add))


def section_credits(rows: DataFrame) -> DataFrame:
    """Credit sum per section over its own rows; alternatives below a row are already in it."""
    ranged = rows.where(~F.col("child")).withColumn("range", T.credit_range("credits")).where(F.col("range").isNotNull())
    summed = ranged.groupBy("program", "section_at").agg(F.sum("range.min").alias("low"), F.sum("range.max").alias("high"))
    return summed.select("program", "section_at", T.format_range(F.col("low"), F.col("high")).alias("credits"))


def section_trees(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(tree, courses)`` of the sections; a section is an AND of its items."""
    section = ["program", "section_at"]
    coded = stage(rows.withColumn("code", F.when(F.col("number").isNotNull(), T.table_code("subject", "number"))))
    children = coded.where(F.col("child") & F.col("number").isNotNull() & F.col("code").isNotNull())
    details = children.groupBy(*section, "code").agg(F.min_by(F.struct(F.col("text").alias("title"), "credits"), "line_no").alias("d"))

    top = coded.where(~F.col("child"))
    none = F.array().cast("array<int>")
    no_kinds = F.array().cast("array<string>")

    def item(rows: DataFrame, arm, steps, kinds, kind, code, note) -> DataFrame:
        return rows.select(
            *section, "line_no", arm.alias("arm"), steps.alias("steps"), kinds.alias("kinds"), kind.alias("kind"), code.alias("code"), note.alias("note")
        )

    blank = F.lit(None).cast("string")
    zero = F.lit(0)
    numbered = item(top.where(F.col("number").isNotNull()), zero, none, no_kinds, F.lit("course"), F.col("code"), blank)

    # Note rows with an expression; a top-level AND is spliced into the section.
    notes = top.where(F.col("number").isNull() & F.col("note"))
    parsed = stage(parse_notes(notes.select(*section, "line_no", "text"), [*section, "line_no"]))
    shaped = parsed.join(notes.select(*section, "line_no", F.col("text").alias("note_text")), [*section, "line_no"])
    root_and = F.when(F.size("kinds") > 0, F.col("kinds")[0]).otherwise(F.col("kind")) == "and"
    shaped = shaped.withColumn("spliced", root_and).where(~(F.col("spliced") & (F.size("steps") == 1)))
    cut = F.when(F.col("spliced"), 2).otherwise(1)
    arm = F.when(F.col("spliced"), F.get(F.col("steps"), F.lit(1))).otherwise(0)
    inner = F.slice("steps", cut + 1, F.greatest(F.size("steps") - cut, F.lit(0)))
    above = F.slice("kinds", cut, F.greatest(F.size("kinds") - cut + 1, F.lit(0)))
    own_note = F.when((F.size(inner) == 0) & (F.col("kind") != "course"), F.col("note_text"))
    note_items = item(shaped, arm, inner, above, F.col("kind"), F.col("code"), own_note)

    # Rows without number and without "Note:" are a choice of the child rows right below them.
    owners = carry(coded, section, "line_no", {"owner_at": F.when(~F.col("child"), F.col("line_no"))})
    kids = owners.where(F.col("child") & F.col("number").isNotNull())
    plain = top.where(F.col("number").isNull() & ~F.col("note"))
    members = kids.select(*section, F.col("owner_at").alias("line_no"), F.col("line_no").alias("member_at"), "code").join(
        plain.select(*section, "line_no", "text"), [*section, "line_no"]
    )
    members = stage(running_total(members, [*section, "line_no"], "member_at", F.lit(1), "n").withColumn("n", F.col("n").cast("int")))
    choice_leaves = item(members, zero, F.array("n"), F.array(F.lit("or")), F.lit("course"), F.col("code"), blank)
    choices = members.where("n = 0").withColumn("note", F.col("text"))
    choice_nodes = item(choices, zero, none, no_kinds, F.lit("or"), blank, F.col("note"))

    # Whatever is left contributes the codes its text spells out.
    used = shaped.select(*section, "line_no").union(choices.select(*section, "line_no")).distinct()
    prose = top.where(F.col("number").isNull()).join(used, [*section, "line_no"], "left_anti")
    spelled = prose.select("*", F.posexplode(T.distinct_course_refs("text")).alias("n", "spelled"))
    literal = item(spelled, F.col("n"), none, no_kinds, F.lit("course"), F.col("spelled"), blank)

    items = stage(numbered.unionByName(note_items).unionByName(choice_nodes).unionByName(choice_leaves).unionByName(literal))
    # A course stands directly in the section only where the section first mentions it.
    at = F.struct("line_no", "arm", "steps")
    firsts = items.where((F.col("kind") == "course") & F.col("code").isNotNull()).groupBy(*section, "code").agg(F.min(at).alias("first_at"))
    placed = items.join(firsts, [*section, "code"], "left")
    direct = (F.size("steps") == 0) & (F.col("kind") == "course") & F.col("code").isNotNull()
    kept = stage(placed.where(~direct | (at == F.col("first_at"))).drop("first_at"))

    arms = kept.select(*section, "line_no", "arm").distinct()
    per_line = Window.partitionBy(*section, "line_no").orderBy("arm")
    arms = arms.withColumn("in_line", F.row_number().over(per_line) - 1)
    lines = arms.groupBy(*section, "line_no").agg(F.count(F.lit(1)).alias("n"))
    offsets = running_total(lines, section, "line_no", F.col("n"), "before")
    numbers = arms.join(offsets.select(*section, "line_no", "before"), [*section, "line_no"])
    numbers = numbers.select(*section, "line_no", "arm", (F.col("before") + F.col("in_line")).cast("int").alias("item"))
    steps = F.concat(F.array(F.lit(0), F.col("item")), F.col("steps"))
    tree = kept.join(numbers, [*section, "line_no", "arm"]).withColumn("steps", steps).select(
        *section, F.array_join("steps", ".").alias("path"),
        F.array_join(F.slice("steps", 1, F.size("steps") - 1), ".").alias("parent_path"),
        "steps", F.concat(F.array(F.lit("and")), "kinds").alias("kinds"), "kind", "code", "note",
    )
    tree = stage(tree)
    named = tree.where((F.col("kind") == "course") & F.col("code").isNotNull())
    courses = named.groupBy(*section, "code").agg(F.min("steps").alias("first_at")).join(details, [*section, "code"], "left")
    courses = courses.select(
        *section, "code", "first_at", F.coalesce("d.title", F.lit("")).alias("title"), F.coalesce("d.credits", F.lit("")).alias("credits")
    )
    return tree, courses


def is_branch_heading(text: str = "text") -> Column:
    """Short heading-like line that ends in a branch word."""
    title = T.trim_space(text)
    words = F.split(title, f"{S}+")
    lower = F.size(F.filter(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: w.rlike("^[a-z]")))
    return (
        (title != "")
        & (indent_of(text) <= MAX_INDENT)
        & ~title.rlike(NOT_A_BRANCH)
        & ~title.rlike(ELECTIVE_HEAD)
        & title.rlike(BRANCH_SUFFIX)
        & (F.length(title) <= MAX_TITLE)
        & ~title.rlike(r"[.;:]$")
        & ~title.rlike(r"[\[\]\d]")
        & (F.size(words) <= MAX_WORDS)
        & (lower < MAX_LOWER)
    )


def _stripped_lead(c: Column) -> Column:
    return F.regexp_replace(c, rf"^[A-Z]{{4}}{S}+", "")


def branch_tables(lines: DataFrame, bounds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(branches, branch_courses)`` of the tables that follow the core.

    Every line is one event: a branch heading or group row opens a branch, a container line names
    the group and closes the branch, a numbered row adds a course, other rows and wrapped lines are
    rule text.  All state is "the last such event before", carried in one scan.
    """
    region = lines.join(bounds, "program").where(
        F.col("stop").isNotNull() & (F.col("line_no") >= F.col("stop")) & (F.col("line_no") < F.coalesce("finish", F.lit(2**31 - 1)))
    )
    cells = _cells(_prepared(region.select("program", "line_no", "line"))).where(~F.col("pause") & ~F.col("text").rlike(CREDIT_HEADER))
    trimmed = T.trim_space("text")
    head = T.trim_space(F.split_part("body", F.lit("["), F.lit(1)))
    event = (
        F.when(F.col("is_row") & F.col("number").isNotNull(), "course")
        .when(F.col("is_row") & head.rlike(GROUP_ROW), "group")
        .when(F.col("is_row"), "rule")
        .when(trimmed.rlike(HEADING_SUFFIX), "suffix")
        .when((indent_of("text") <= MAX_INDENT) & trimmed.rlike(CONTAINER), "container")
        .when(is_branch_heading(), "heading")
        .otherwise("text")
    )
    bracket = T.clean_text(F.regexp_extract("body", r"\[([^\]]*)\]*$", 1))
    lines = cells.withColumn("event", event).withColumn("title", F.when(F.col("event") == "group", head).otherwise(trimmed))
    kind = F.when(F.col("event") == "group", "group").when(F.col("event") == "heading", T.branch_kind("title"))
    lines = lines.withColumn("kind", kind).withColumn("bracket", F.when(F.col("event") == "group", bracket))
    entity = (F.col("event") == "heading") & ~F.col("kind").isin("area", "courses", "other")
    lines = lines.withColumn("entity", F.coalesce(entity, F.lit(False)))
    ev, no = F.col("event"), F.col("line_no")

    def point(cond: Column, value: Column) -> Column:
        return F.when(cond, F.struct(value.alias("v")))

    none = F.lit(None).cast("int")
    state = {
        "current": point(ev.isin("group", "heading"), no).when(ev == "container", F.struct(none.alias("v"))),
        "container": point(ev.isin("group", "container"), F.col("title")),
        "last_entity": point(F.col("entity"), no).when(ev.isin("group", "container"), F.struct(none.alias("v"))),
        "last_group": point(ev == "group", no),
        "last_upper": point((ev == "group") | F.col("entity"), no),
        "row_indent": point(ev.isin("course", "rule"), F.col("indent")).when(
            ev.isin("group", "suffix", "container", "heading"), F.struct(none.alias("v"))
        ),
    }
    run = stage(carry(lines, ["program"], "line_no", state))
    # Prose rows outside any branch may state a rule for the areas that follow.
    free_rule = (ev == "rule") & F.col("current.v").isNull()
    text_rule = F.when(F.col("body").rlike("(?i:area|track)"), F.col("body")).otherwise("")
    empty = F.lit("")
    rules = {
        "pending": F.when(ev == "group", F.struct(no.alias("of"), empty.alias("rule")))
        .when((ev == "container") | F.col("entity"), F.struct(none.alias("of"), empty.alias("rule")))
        .when(free_rule, F.struct(none.alias("of"), text_rule.alias("rule")))
    }
    run = stage(carry(run, ["program"], "line_no", rules))

    opened = run.where(ev.isin("group", "heading"))
    # Lines left of the open row that start with a capital continue the branch's own rule.
    wrapped = F.col("row_indent.v").isNotNull() & (F.col("indent") >= F.col("row_indent.v"))
    extra = run.where(
        (ev == "text") & ~wrapped & F.col("current.v").isNotNull() & trimmed.rlike("^[A-Z]") & (F.length(trimmed) > 10)
    )
    more = extra.groupBy("program", F.col("current.v").alias("line_no")).agg(
        F.array_sort(F.collect_list(F.struct(no.alias("at"), _stripped_lead(trimmed).alias("text")))).alias("more")
    )
    added = F.array_join("more.text", " ")
    group_rules = run.where(ev == "group").join(more, ["program", "line_no"], "left").select(
        "program", F.col("line_no").alias("of"), T.clean_text(F.concat_ws(" ", "bracket", added)).alias("group_rule")
    )
    lower = (ev == "heading") & ~F.col("entity")
    opened = opened.withColumn("of", F.col("pending.of")).join(group_rules, ["program", "of"], "left")
    pending = F.coalesce("group_rule", "pending.rule", empty)
    inherited = F.when(lower & (F.coalesce("container.v", empty) != AREA_CONTAINER), pending).otherwise(empty)
    opened = opened.withColumn("first_rule", F.when(ev == "group", F.col("bracket")).otherwise(inherited)).drop("of")
    opened = opened.join(more, ["program", "line_no"], "left")
    # Text added to a rule is cleaned with it; a rule nothing was added to stays as it is.
    rule = F.when(F.col("more").isNotNull(), T.clean_text(F.concat_ws(" ", "first_rule", added))).otherwise(F.col("first_rule"))
    parent_at = F.when(F.col("entity"), F.col("last_group.v")).when(lower, F.coalesce("last_entity.v", "last_upper.v"))
    numbered = running_total(opened.select(
        "program", "line_no", "kind", "title", parent_at.alias("parent_at"), F.col("container.v").alias("group"), rule.alias("rule"),
        F.when(ev == "group", F.nullif("credits", empty)).alias("credits"),
    ), ["program"], "line_no", F.lit(1), "before")
    number = (F.col("before") + 1).cast("int")
    two_digits = F.when(number < 10, F.concat(F.lit("0"), number.cast("string"))).otherwise(number.cast("string"))
    named = stage(numbered.withColumn("number", number).withColumn("id", F.concat_ws(":", F.lit("branch"), two_digits, "kind")))
    parents = named.select("program", F.col("line_no").alias("parent_at"), F.col("id").alias("parent"))
    branches = named.join(parents, ["program", "parent_at"], "left").select(
        "program", F.col("line_no").alias("branch_at"), "number", "id", "kind", "title", "parent", "group", "rule", "credits"
    )
    courses = run.where((ev == "course") & F.col("current.v").isNotNull()).select(
        "program", F.col("current.v").alias("branch_at"), "line_no", T.table_code("subject", "number").alias("code"),
        F.col("body").alias("title"), "credits",
    )
    return branches, courses


def parse_programs(lines: DataFrame) -> ProgramText:
    """All of the above for every program."""
    return ProgramText(lines)
