"""Reconciling parsed programs with the catalog and with their previous version.

Tables are keyed by ``program``.  Change rows are ``(program, change)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import text as T
from trellis.operators.ordered import carry, running_total
from trellis.operators.requirements import RELATIONS
from trellis.operators.verdicts import all_verdict, any_verdict, facts, verdict_name
from trellis.operators.trees import fold
from trellis.session import grow, stage

# ---- fixed values ---------------------------------------------------------------------------
MAX_BRANCH_DEPTH = 12
DEFAULT_INTAKE = "2025-26"
# ---------------------------------------------------------------------------------------------


def relation_groups(req_nodes: DataFrame) -> DataFrame:
    """``(owner, relation, ref, group, position)``: references grouped the way a choice shows them.

    Each arm of a top-level ALL that names a course is one group, numbered from 1 without gaps;
    exclusions and everything else form a single group.
    """
    top = req_nodes.where("depth = 0").select("owner", "relation", F.col("kind").alias("top"))
    refs = req_nodes.where((F.col("kind") == "course") & F.col("code").isNotNull())
    refs = refs.select("owner", "relation", F.col("code").alias("ref"), "steps").join(top, ["owner", "relation"])
    by_arm = (F.col("top") == "all") & (F.col("relation") != "exclusion")
    arm = F.when(by_arm, F.get(F.col("steps"), F.lit(1))).otherwise(0)
    # One requirement text per window partition.
    per = Window.partitionBy("owner", "relation")
    refs = refs.withColumn("arm", arm).withColumn("group", F.dense_rank().over(per.orderBy("arm")))
    return refs.select("owner", "relation", "ref", "group", (F.row_number().over(per.orderBy("steps")) - 1).alias("position"))


def program_relations(program_courses: DataFrame, courses: DataFrame, req_nodes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(relations(program, source, target, relation, group, position, raw), changes)``; of ``texts`` owner, relation and raw."""
    wanted = program_courses.select("program", F.col("code").alias("target")).distinct()
    known = courses.select(F.col("code").alias("target"))
    grouped = relation_groups(req_nodes).join(texts.select("owner", "relation", "raw"), ["owner", "relation"])
    grouped = grouped.withColumnRenamed("owner", "target").join(known, "target", "left_semi")
    relations = wanted.join(grouped, "target").select("program", F.col("ref").alias("source"), "target", "relation", "group", "position", "raw")
    missing = wanted.join(known, "target", "left_anti")
    note = F.format_string("warning: program course %s is not in the catalog", "target")
    return relations, missing.select("program", note.alias("change"))


def unique_ids(sections: DataFrame, used: DataFrame) -> DataFrame:
    """``sections(program, at, base)`` -> ``id``: the base, or base-2, base-3 ... where taken.

    ``used(program, id)`` are ids that may not be reused.  Among sections of one base the n-th gets the n-th free
    number: its rank and the taken numbers that lie below.  The i-th taken number t has t - i free ones below it, so
    it counts for all ranks from there on; both are merged in that order by a blocked scan, however many sections
    share a base.
    """
    name = ["program", "base"]
    ranked = running_total(sections, name, "at", F.lit(1), "rank")
    suffixed = used.select("program", F.regexp_replace("id", r"-\d+$", "").alias("base"), F.regexp_extract("id", r"-(\d+)$", 1).try_cast("bigint").alias("n"))
    plain = used.select("program", F.col("id").alias("base"), F.lit(1).cast("bigint").alias("n"))
    taken = suffixed.where("n >= 2").unionByName(plain).distinct().join(sections.select(*name), name, "left_semi")
    counted = running_total(taken, name, "n", F.lit(1), "before")
    skips = counted.groupBy(*name, (F.col("n") - F.col("before") - 1).alias("free")).agg(F.max(F.col("before") + 1).alias("skipped"))
    merged = ranked.withColumn("_pos", 2 * F.col("rank") + 1).withColumn("_own", F.lit(True)).unionByName(
        skips.select(*name, (2 * F.col("free")).alias("_pos"), "skipped"), allowMissingColumns=True
    )
    carried = carry(merged.withColumnRenamed("skipped", "_here"), name, "_pos", {"_skip": F.when(F.col("_here").isNotNull(), F.struct("_here"))}).where("_own")
    n = F.col("rank") + 1 + F.coalesce("_skip._here", F.lit(0))
    return carried.select(*sections.columns, F.when(n == 1, F.col("base")).otherwise(F.concat_ws("-", "base", n.cast("string"))).alias("id"))


def reconcile_sections(parsed: DataFrame, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed sections matched with the previous ones by label; curated fields survive.

    ``parsed(program, section_at, title, credits)``, ``previous(program, id, label, eyebrow, title,
    root_group, copy, source_link, credits)``.
    """
    old = previous.select(
        "program", T.label_key(F.coalesce("label", "id")).alias("key"), F.col("id").alias("old_id"), "eyebrow",
        F.col("title").alias("old_title"), "root_group", "copy", "source_link", F.col("credits").alias("old_credits"),
    )
    # Of previous sections with the same label the last one counts.
    old = old.groupBy("program", "key").agg(F.max_by(F.struct("old_id", "eyebrow", "old_title", "root_group", "copy", "source_link", "old_credits"), "old_id").alias("o"))
    joined = parsed.withColumn("key", T.label_key("title")).join(old, ["program", "key"], "left")
    fresh = joined.where(F.col("o").isNull()).select("program", F.col("section_at").alias("at"), T.section_slug("title").alias("base"))
    ids = unique_ids(fresh, previous.select("program", "id")).select("program", F.col("at").alias("section_at"), F.col("id").alias("new_id"))
    merged = joined.join(ids, ["program", "section_at"], "left")
    ident = F.coalesce("o.old_id", "new_id")
    stated = F.nullif("credits", F.lit(""))
    credits = F.when(stated.isNotNull(), F.concat(stated, F.lit(" credits"))).otherwise(F.coalesce("o.old_credits", F.lit("")))
    shown = T.human_title("title")
    sections = merged.select(
        "program", "section_at", ident.alias("id"), F.col("title").alias("label"),
        F.coalesce("o.eyebrow", shown).alias("eyebrow"), F.coalesce("o.old_title", shown).alias("title"),
        F.coalesce("o.root_group", F.concat(F.lit("group:"), ident)).alias("root_group"),
        F.col("o.copy").alias("copy"), F.col("o.source_link").alias("source_link"), credits.alias("credits"),
        F.col("o.old_credits").alias("old_credits"), F.col("o").isNotNull().alias("matched"),
    )
    drift = sections.where(F.col("matched") & (F.coalesce("old_credits", F.lit("")) != F.col("credits")))
    text = F.format_string("section %s credits %s -> %s", "id", "old_credits", "credits")
    return sections.drop("old_credits", "matched"), drift.select("program", text.alias("change"))


def reconcile_courses(sections: DataFrame, parsed: DataFrame, previous: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Program courses: first section wins, the catalog decides titles and credits.

    ``parsed(program, section_at, code, first_at, title, credits)``, ``previous(program, code,
    section, parent, title, credits)``.
    """
    spot = F.struct("section_at", "first_at")
    first = parsed.groupBy("program", "code").agg(
        F.min(spot).alias("spot"), F.min_by(F.struct("title", "credits"), spot).alias("p")
    )
    homes = sections.select("program", "section_at", F.col("id").alias("section"), "root_group")
    now = first.select("program", "code", "spot.section_at", "spot.first_at", "p").join(homes, ["program", "section_at"])
    old = previous.select("program", "code", F.struct("section", "parent", "title", "credits").alias("o"))
    book = catalog.select("code", F.struct(F.col("title").alias("title"), T.catalog_credits("credits").alias("credits")).alias("c"))
    j = now.withColumn("wanted", F.lit(True)).join(old, ["program", "code"], "full").join(book, "code", "left")
    c_title, c_credits = F.nullif("c.title", F.lit("")), F.nullif("c.credits", F.lit(""))
    is_new = F.col("o").isNull()
    moved = ~is_new & (F.col("o.section") != F.col("section"))
    title = F.when(is_new, F.coalesce(c_title, F.nullif("p.title", F.lit("")), "code")).otherwise(F.coalesce(c_title, "o.title"))
    credits = F.when(is_new, F.coalesce(c_credits, "p.credits", F.lit(""))).otherwise(F.coalesce(c_credits, "o.credits"))
    parent = F.when(is_new | moved, F.col("root_group")).otherwise(F.col("o.parent"))
    j = stage(j.select("*", title.alias("title"), credits.alias("credits"), parent.alias("parent"), moved.alias("moved"), is_new.alias("is_new")))
    courses = j.where("wanted").select("program", "code", "section", "section_at", "first_at", "parent", "title", "credits")
    kept = F.col("wanted").isNotNull()
    changes = F.array_compact(F.array(
        F.when(kept & F.col("is_new"), F.format_string("course %s added to %s", "code", "section")),
        F.when(kept & F.col("moved"), F.format_string("course %s moved to %s", "code", "section")),
        F.when(kept & ~F.col("is_new") & (F.col("title") != F.col("o.title")), F.format_string("course %s title updated from catalog", "code")),
        F.when(~kept, F.format_string("course %s removed (no longer required)", "code")),
    ))
    return courses, j.select("program", F.explode(changes).alias("change"))


def materialize_groups(sections: DataFrame, tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(groups(program, id, label, kind, parent), members(program, code, parent))``.

    Every AND/OR node below a section becomes a group, numbered in document order per section.
    """
    heads = sections.select("program", "section_at", F.col("id").alias("section"), "root_group", "label")
    rules = tree.where(F.col("kind") != "course").select("program", "section_at", "path", "parent_path", "steps", "kind", "note")
    item = F.get(F.col("steps"), F.lit(1))
    # Groups before this one: those of earlier items (blocked running total) plus earlier ones inside the item.
    per_item = rules.withColumn("item", item).groupBy("program", "section_at", "item").agg(F.count(F.lit(1)).alias("n"))
    offsets = running_total(per_item, ["program", "section_at"], "item", F.col("n"), "before")
    inside = Window.partitionBy("program", "section_at", "item").orderBy("steps")
    ranked = rules.withColumn("item", item).withColumn("in_item", F.row_number().over(inside))
    numbered = ranked.join(offsets.select("program", "section_at", "item", "before"), ["program", "section_at", "item"])
    named = numbered.join(heads, ["program", "section_at"]).withColumn("number", F.col("before") + F.col("in_item")).withColumn(
        "id", F.format_string("group:%s:%s-%d", "section", "kind", "number")
    )
    named = stage(named)
    ids = named.select("program", "section_at", F.col("path").alias("parent_path"), F.col("id").alias("upper"))
    nested = named.join(ids, ["program", "section_at", "parent_path"], "left").select(
        "program", "id", T.group_label("kind", "note").alias("label"), "kind", F.coalesce("upper", "root_group").alias("parent")
    )
    roots = heads.select(
        "program", F.col("root_group").alias("id"), F.concat(T.human_title("label"), F.lit(" | AND")).alias("label"),
        F.lit("and").alias("kind"), F.lit(None).cast("string").alias("parent"),
    )
    # A course stands under the last group that lists it.
    leaves = tree.where((F.col("kind") == "course") & F.col("code").isNotNull()).join(heads, ["program", "section_at"])
    leaves = leaves.join(ids, ["program", "section_at", "parent_path"], "left")
    members = leaves.groupBy("program", "code").agg(
        F.max_by(F.coalesce("upper", "root_group"), F.struct("section_at", "steps")).alias("parent")
    )
    return roots.unionByName(nested), members


def context_courses(relations: DataFrame, program_courses: DataFrame, previous: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Courses that relations mention but the program does not contain.

    Still referenced previous ones keep their order (``old_at``), new ones follow by code.
    ``previous(program, code, old_at)``.
    """
    named = relations.select("program", F.col("source").alias("code")).distinct()
    named = named.join(program_courses.select("program", "code"), ["program", "code"], "left_anti")
    old = previous.select("program", "code", "old_at").withColumn("_old", F.lit(True))
    j = stage(named.withColumn("_now", F.lit(True)).join(old, ["program", "code"], "full"))
    titles = catalog.select("code", F.col("title").alias("catalog_title"))
    current = j.where("_now").join(titles, "code", "left").select(
        "program", "code", F.coalesce("catalog_title", "code").alias("title"), "old_at"
    )
    text = F.when(F.col("_old").isNull(), F.format_string("context course %s added", "code")).when(
        F.col("_now").isNull(), F.format_string("context course %s removed", "code")
    )
    changes = j.select("program", text.alias("change")).where(F.col("change").isNotNull())
    return current, changes


def total_credits(sections: DataFrame, previous: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """``(totals(program, total_credits), changes)`` from the sections' credit labels."""
    value = F.regexp_replace(F.coalesce("credits", F.lit("")), rf"(?i){T.SPACE}*credits$", "")
    ranged = sections.withColumn("r", T.credit_range(value))
    low, high = F.coalesce(F.sum("r.min"), F.lit(0.0)), F.coalesce(F.sum("r.max"), F.lit(0.0))
    totals = ranged.groupBy("program").agg(T.format_range(low, high).alias("total_credits"))
    if previous is None:
        return totals, None
    old = previous.select("program", F.col("total_credits").alias("old_total"))
    drift = totals.join(old, "program").where(~F.col("total_credits").eqNullSafe(F.col("old_total")))
    return totals, drift.select("program", F.format_string("total credits %s -> %s", "old_total", "total_credits").alias("change"))


def program_headers(previous: DataFrame, meta: DataFrame, totals: DataFrame, catalog_year: str, default_intake: str = DEFAULT_INTAKE) -> DataFrame:
    """Header row per program: identity from the previous version first, facts from the new page first.

    ``previous(program, id, program_code, intake, title, source_url, source_hash)``, ``meta(program,
    program_code, intake, title, source_url, source_hash)``.
    """
    old = previous.select("program", *[F.col(c).alias(f"old_{c}") for c in ("id", "program_code", "intake", "title", "source_url", "source_hash")])
    j = totals.join(meta, "program", "left").join(old, "program", "left")
    given = lambda c: F.nullif(F.col(c), F.lit(""))
    code = F.coalesce(given("old_program_code"), given("program_code"), F.col("program").cast("string"))
    intake = F.coalesce(given("old_intake"), given("intake"), F.lit(default_intake))
    j = j.withColumn("_code", code).withColumn("_intake", intake)
    return j.select(
        "program", F.coalesce(given("old_id"), F.concat_ws("-", "_code", "_intake")).alias("id"), F.col("_code").alias("program_code"),
        F.coalesce(given("title"), given("old_title"), "_code").alias("title"), F.col("_intake").alias("intake"),
        F.lit(catalog_year).alias("catalog_year"), "total_credits",
        F.coalesce(given("source_url"), given("old_source_url"), F.lit("")).alias("source_url"),
        F.coalesce(given("source_hash"), given("old_source_hash"), F.lit("")).alias("source_hash"),
    )


def program_summary(headers: DataFrame, **children: DataFrame) -> DataFrame:
    """Manifest rows: header plus the number of rows per child table (0 where there are none)."""
    out = headers
    for name, child in children.items():
        counted = child.groupBy("program").agg(F.count(F.lit(1)).alias(name))
        out = out.join(counted, "program", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def filter_relations(relations: DataFrame, program_courses: DataFrame, context: DataFrame, enabled: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``(edges with drawn/context flags, counts per program)``.

    An edge is drawn if its source is a program or context course; it is a context edge unless both
    ends are program courses; a context course shows only if it has an enabled edge.
    """
    enabled = enabled or RELATIONS
    listed = program_courses.select("program", "code", F.lit(True).alias("major")).unionByName(
        context.select("program", "code", F.lit(False).alias("major"))
    ).groupBy("program", "code").agg(F.bool_or("major").alias("major"))
    source = listed.select("program", F.col("code").alias("source"), F.col("major").alias("source_major"))
    target = listed.select("program", F.col("code").alias("target"), F.col("major").alias("target_major"))
    drawn = relations.join(source, ["program", "source"]).join(target, ["program", "target"], "left")
    both = F.col("source_major") & F.coalesce("target_major", F.lit(False))
    edges = drawn.withColumn("context_edge", ~both).withColumn("enabled", F.col("relation").isin(enabled)).drop("source_major", "target_major")
    ends = edges.where("enabled").select("program", F.explode(F.array("source", "target")).alias("code"))
    shown = context.select("program", "code").join(ends, ["program", "code"], "left_semi")
    counts = program_courses.groupBy("program").agg(F.countDistinct("code").alias("visible_courses")).join(
        shown.groupBy("program").agg(F.countDistinct("code").alias("visible_context")), "program", "left"
    )
    return edges, counts.select("program", "visible_courses", F.coalesce("visible_context", F.lit(0)).alias("visible_context"))


def section_outline(sections: DataFrame, program_courses: DataFrame) -> DataFrame:
    """Courses of each section in document order."""
    heads = sections.select("program", "section_at", F.col("id").alias("section"), F.col("title").alias("section_title"), F.col("credits").alias("section_credits"))
    return heads.join(program_courses.select("program", "section", "code", "first_at", "title", "credits"), ["program", "section"]).orderBy(
        "program", "section_at", "first_at"
    )


def parent_depths(items: DataFrame, cap: int = MAX_BRANCH_DEPTH) -> DataFrame:
    """``items(program, id, parent)`` -> number of ancestors, at most ``cap``; unknown parents end the chain."""
    links = stage(items.join(items.select("program", F.col("id").alias("parent")), ["program", "parent"], "left_semi").select("program", "id", "parent"))
    seed = items.select("program", "id", F.col("id").alias("at"), F.lit(0).alias("depth"))
    up = links.withColumnRenamed("id", "at")
    # Keyed by depth as well: a cycle of parents runs into the cap instead of looping.
    walked = grow(seed, ["program", "id", "depth"], lambda front, n: front.join(up, ["program", "at"]).select("program", "id", F.col("parent").alias("at"), F.lit(n).alias("depth")), cap)
    return walked.groupBy("program", "id").agg(F.max("depth").alias("depth"))


def ancestors(items: DataFrame) -> DataFrame:
    """``items(program, id, parent)`` -> ``(program, id, ancestor)`` along the parent chain."""
    links = stage(items.where(F.col("parent").isNotNull()).select("program", "id", "parent"))
    seed = links.select("program", "id", F.col("parent").alias("ancestor"))
    up = links.select("program", F.col("id").alias("ancestor"), "parent")
    return grow(seed, ["program", "id", "ancestor"], lambda front, _: front.join(up, ["program", "ancestor"]).select("program", "id", F.col("parent").alias("ancestor")).distinct())


def course_requirements(program_courses: DataFrame, relations: DataFrame) -> DataFrame:
    """The last stated text per relation of each program course, "" where there is none."""
    every = F.explode(F.array(*map(F.lit, RELATIONS))).alias("relation")
    asked = program_courses.select("program", "code", every)
    last = relations.groupBy("program", F.col("target").alias("code"), "relation").agg(F.max_by("raw", F.struct("group", "position")).alias("raw"))
    return asked.join(last, ["program", "code", "relation"], "left").select("program", "code", "relation", F.coalesce("raw", F.lit("")).alias("raw"))


def relation_diff(declared: DataFrame, derived: DataFrame) -> DataFrame:
    """(target, relation) pairs whose grouped source lists differ: ``(program, target, relation, declared, derived)``."""

    def lists(rows: DataFrame, name: str) -> DataFrame:
        entry = F.struct("group", "position", "source")
        return rows.groupBy("program", "target", "relation").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["group"], e["source"])).alias(name))

    both = lists(declared, "declared").join(lists(derived, "derived"), ["program", "target", "relation"], "full")
    return both.where(~F.col("declared").eqNullSafe(F.col("derived")))


def section_progress(students: DataFrame, tree: DataFrame, completions: DataFrame, depth: int) -> DataFrame:
    """How far students are with their program's sections (an extension: the trees are only stored upstream).

    ``students(student, program)``.  A section is an AND of its items; an OR whose note says
    "N courses" needs N fulfilled arms.  Returns ``(student, program, section_at, verdict, met, items)``.
    """
    section = ["student", "program", "section_at"]
    leaf = tree.where(F.col("kind") == "course")
    needs = tree.where((F.col("kind") == "or") & (T.choice_count("note") > 1)).select(
        "program", "section_at", F.col("path").alias("item_path"), T.choice_count("note").alias("needed")
    )
    signs = F.array_join(F.transform(F.slice("kinds", 3, F.greatest(F.size("kinds") - 2, F.lit(0))), lambda k: F.when(k == "or", "|").otherwise("&")), "")
    item_path = F.array_join(F.slice("steps", 1, 2), ".")
    # Below an item: the arms' own trees; the item's own junction is judged by count.
    top = F.get(F.col("kinds"), F.lit(1))
    leaves = leaf.select(
        "program", "section_at", item_path.alias("item_path"), top.alias("item_kind"),
        F.when(F.size("steps") > 2, F.array_join(F.slice("steps", 1, 3), ".")).otherwise(item_path).alias("arm_path"),
        F.array_join(F.slice("steps", 3, F.greatest(F.size("steps") - 2, F.lit(1))), ".").alias("path"), signs.alias("above"), "code",
    )
    held = facts(completions).select("student", F.col("item").alias("code"), F.lit(True).alias("held"))
    asked = students.select("student", "program").distinct().join(leaves, "program").join(held, ["student", "code"], "left")
    judged = asked.withColumn("verdict", F.coalesce("held", F.lit(False)))
    keys = [*section, "item_path", "item_kind", "arm_path"]
    judged = judged.withColumn("item_kind", F.coalesce("item_kind", F.lit("course")))
    arms = fold(judged, keys, "verdict", any_verdict("verdict"), all_verdict("verdict"), max(depth - 2, 0))
    counted = arms.groupBy(*section, "item_path", "item_kind").agg(F.count_if("verdict").alias("met_arms"), F.count(F.lit(1)).alias("arms"))
    counted = counted.join(needs, ["program", "section_at", "item_path"], "left")
    enough = F.when(F.col("item_kind") == "or", F.col("met_arms") >= F.coalesce("needed", F.lit(1))).otherwise(F.col("met_arms") == F.col("arms"))
    items = counted.withColumn("ok", enough)
    done = items.groupBy(*section).agg(F.bool_and("ok").alias("verdict"), F.count_if("ok").alias("met"), F.count(F.lit(1)).alias("items"))
    return done.withColumn("status", verdict_name("verdict")).drop("verdict")
