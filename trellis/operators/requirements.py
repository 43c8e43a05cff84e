"""Requirement text -> flat AND/OR node tables.

Distinct texts are parsed once.  Parsing is a frontier loop over text fragments: each round peels
the brackets of every open fragment, decides what the fragment is, and explodes a junction into its
arms; the loop ends when only leaves are left, so the number of rounds is the nesting depth of the
deepest text.  A round is a projection plus an explode (no shuffle).

Node table: ``(text_key, path, parent_path, ordinal, depth, steps, kinds, kind, code, qualifier,
pat_subject, pat_min_level, text, mandatory)``.  ``path`` is "0", "0.1", "0.1.2"; ``steps`` is the
same as integers, which sorts in document order; ``kinds`` lists the junction kinds above the node.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.functions import text as T
from trellis.session import Staged, stage

RELATIONS = ["prerequisite", "corequisite", "exclusion"]

# ---- fixed values ---------------------------------------------------------------------------
UNSPECIFIED = "Unspecified requirement"
WARN_EMPTY = "Empty requirement expression"
WARN_GROUPING = "Unbalanced requirement grouping"
WARN_CONNECTOR = "Course references lacked an explicit Boolean connector; treated as AND"
OR_WORD = r"(?<![A-Za-z0-9])(?i:or)(?![A-Za-z0-9])"
NOT_A_SPLIT = rf"(?!{T.SPACE}*(?i:above|higher|better)(?![A-Za-z0-9_]))"
AND_WORD = r"(?<![A-Za-z0-9])(?i:and)(?![A-Za-z0-9])"
PATTERN = (
    rf"^(?i:any{T.SPACE}+([A-Za-z]{{4}}){T.SPACE}+courses?{T.SPACE}+of{T.SPACE}+([1-9])000"
    rf"(?:{T.SPACE}|[-{T.DASHES}])*level{T.SPACE}+or{T.SPACE}+above)$"
)
TEMPORAL = r"^\s*\(((?i:prior|before|from|since|in)(?![A-Za-z0-9_])[^()]*)\)"
# ---------------------------------------------------------------------------------------------

MARK = chr(0xFDD0)  # a Unicode noncharacter: set before every connector outside all brackets
_TOKENS = rf"(?s){OR_WORD}{NOT_A_SPLIT}|{AND_WORD}|[()\[\],;/]|[^()\[\],;/OoAa]+|."
_CONNECTOR = r"^(?:(?i:or|and)|[,;/])$"


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ ;,]+|[ ;,]+$", "")


def _opens(top: Column, closer: Column) -> Column:
    return ((closer == ")") & (top == "(")) | ((closer == "]") & (top == "["))


def _chars(brackets: Column) -> Column:
    return F.filter(F.split(brackets, ""), lambda c: c != "")


def _brackets(c: Column) -> Column:
    return _chars(F.regexp_replace(c, r"[^()\[\]]", ""))


def _strict_stack(c: Column, closing_early_fails: bool) -> Column:
    """Bracket stack after the text; "F" once a closer has no matching opener (or the outermost
    pair closed before the end, if that counts as failure)."""

    def push_pop(stack, char):
        opener = (char == "(") | (char == "[")
        top = F.right(stack, F.lit(1))
        popped = F.left(stack, F.length(stack) - 1)
        pushed = F.concat(stack, char)
        if closing_early_fails:  # "S" = nothing seen yet
            pushed = F.when(stack == "S", char).when(stack == "", "F").otherwise(pushed)
        return (
            F.when(stack == "F", "F")
            .when(opener, pushed)
            .when(_opens(top, char), popped)
            .otherwise("F")
        )

    return F.aggregate(_brackets(c), F.lit("S" if closing_early_fails else ""), push_pop)


def wraps_whole(c: Column) -> Column:
    """One bracket pair encloses the whole text."""
    ends = c.rlike(r"(?s)^\(.*\)\z|^\[.*\]\z")
    return F.when(ends, _strict_stack(c, True) == "").otherwise(False)


def grouping_balanced(c) -> Column:
    """Brackets ``()[]`` of the text match up."""
    return _strict_stack(T._text(c), False) == ""


def _peel(c: Column) -> Column:
    layers = F.length(F.regexp_replace(F.regexp_extract(c, r"^[(\[ ]*", 0), " ", ""))
    tries = F.when(layers > 0, F.sequence(F.lit(1), layers)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        tries,
        c,
        lambda v, _: F.when(wraps_whole(v), T.trim_space(F.substring(v, F.lit(2), F.length(v) - 2))).otherwise(v),
    )


def _mark_connectors(c: Column) -> Column:
    """Set MARK before every connector that stands outside all brackets.

    Closers without a matching opener are ignored here, so malformed text still splits.
    """
    tokens = F.regexp_extract_all(c, F.lit(_TOKENS), F.lit(0))
    start = F.struct(F.lit("").alias("stack"), F.lit("").alias("out"))

    def walk(acc, tok):
        stack = acc["stack"]
        after = (
            F.when(tok.isin("(", "["), F.concat(stack, tok))
            .when(_opens(F.right(stack, F.lit(1)), tok), F.left(stack, F.length(stack) - 1))
            .otherwise(stack)
        )
        mark = F.when((stack == "") & tok.rlike(_CONNECTOR), MARK).otherwise("")
        return F.struct(after.alias("stack"), F.concat(acc["out"], mark, tok).alias("out"))

    walked = F.aggregate(tokens, start, walk, lambda acc: acc["out"])
    return F.when(c.rlike(rf"{OR_WORD}|{AND_WORD}|[,;/]"), walked).otherwise(c)


def _arms(marked: Column, connector: str) -> Column:
    pieces = F.transform(F.split(marked, MARK + connector), lambda p: _strip(F.replace(p, F.lit(MARK), F.lit(""))))
    return F.filter(pieces, lambda p: p != "")


def _single_qualifier(c: Column) -> Column:
    """What stands around the only course of a fragment: "grade text; (temporal note)"."""
    located = rf"(?s)^(.*?){T.COURSE}(.*)\z"
    edges = r"^[ ,;:-]+|[ ,;:-]+$"
    before = F.regexp_replace(F.regexp_extract(c, located, 1), edges, "")
    before = F.regexp_replace(F.regexp_replace(before, r"(?<![A-Za-z0-9_])(?i:in)\s*$", ""), edges, "")
    rest = F.regexp_extract(c, located, 4)
    dated = F.trim(F.regexp_extract(rest, TEMPORAL, 1))
    after = F.regexp_replace(F.regexp_replace(rest, TEMPORAL, ""), edges, "")
    remainder = T.clean_text(F.concat_ws(" ", F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))))
    return F.nullif(F.concat_ws("; ", F.nullif(remainder, F.lit("")), F.nullif(dated, F.lit(""))), F.lit(""))


@functools.lru_cache(maxsize=4)
def _decision(app: str) -> tuple[list[dict[str, Column]], list[Column]]:
    """Columns that decide a fragment, built once per application and reused every round."""
    marked, text = F.col("marked"), F.col("body")
    connectors = {"by_or": "(?i:or)", "by_and": "(?i:and)", "by_slash": "/", "by_comma": "[,;]"}
    # OR binds loosest, then AND, then "/" (only between courses), then "," and ";".  A connector
    # splits if it leaves at least two non-empty arms.
    split = F.coalesce(
        _junction("any", "by_or", F.size("by_or") > 1),
        _junction("all", "by_and", F.size("by_and") > 1),
        _junction("any", "by_slash", (F.size("by_slash") > 1) & F.forall("by_slash", T.has_course)),
        _junction("all", "by_comma", F.size("by_comma") > 1),
    )
    is_pattern = F.col("is_pattern")
    steps = [
        {"bare": _strip(F.col("fragment"))},
        {"body": _peel(F.col("bare"))},
        {"marked": _mark_connectors(text)},
        {k: F.when(marked.contains(MARK), _arms(marked, c)) for k, c in connectors.items()},
        {"split": split, "is_pattern": text.rlike(PATTERN)},
        {"refs": F.when(F.col("split").isNull() & ~is_pattern, T.course_refs(text))},
    ]
    many, one = F.size("refs") > 1, F.size("refs") == 1
    decided = [
        F.when(F.col("bare") == "", "condition")
        .when(F.col("split").isNotNull(), F.col("split.kind"))
        .when(is_pattern, "coursePattern")
        .when(one, "course")
        .when(many, "all")
        .otherwise("condition").alias("kind"),
        F.when(F.col("split").isNotNull(), F.col("split.arms")).when(many, F.col("refs")).alias("arms"),
        F.when(one, F.element_at("refs", 1)).alias("code"),
        F.when(one, _single_qualifier(text)).alias("qualifier"),
        F.when(is_pattern, F.upper(F.regexp_extract(text, PATTERN, 1))).alias("pat_subject"),
        F.when(is_pattern, F.regexp_extract(text, PATTERN, 2).try_cast("int")).alias("pat_min_level"),
        F.when(F.col("bare") == "", UNSPECIFIED).otherwise(text).alias("text"),
        F.when(F.col("bare") == "", WARN_EMPTY).when(many, WARN_CONNECTOR).alias("warning"),
    ]
    return steps, decided


def _decide(frontier: DataFrame) -> DataFrame:
    """Kind, arms and leaf fields of every fragment in the frontier."""
    steps, decided = _decision(frontier.sparkSession.sparkContext.applicationId)
    for step in steps:
        frontier = frontier.withColumns(step)
    return frontier.select("text_key", "raw_path", "above", "kinds", "mandatory", *decided)


def _junction(kind: str, arms: str, splits: Column) -> Column:
    return F.when(splits, F.struct(F.lit(kind).alias("kind"), F.col(arms).alias("arms")))


def parse_texts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``texts(text_key, raw)`` with one row per distinct cleaned text -> ``(nodes, results)``.

    ``results(text_key, status, warnings)``.
    """
    seed = texts.select(
        "text_key",
        F.col("raw").alias("fragment"),
        F.array(F.lit(0)).alias("raw_path"),
        F.array().cast("array<array<int>>").alias("above"),
        F.array().cast("array<string>").alias("kinds"),
        F.lit(True).alias("mandatory"),
    )
    store = Staged(texts.sparkSession)
    frontier = seed
    while True:
        open_arms = store.append(_decide(frontier), F.coalesce(F.sum(F.size("arms")), F.lit(0)).alias("arms"))["arms"]
        if open_arms <= 0:
            break
        done = store.last().where(F.col("arms").isNotNull())
        # A junction below a junction of the same kind is spliced: its arms belong to the upper one.
        spliced = F.get(F.col("kinds"), F.size("kinds") - 1) == F.col("kind")
        merged = F.coalesce(spliced, F.lit(False))
        frontier = done.select(
            "text_key",
            F.posexplode("arms").alias("arm", "fragment"),
            "raw_path",
            F.when(merged, F.col("above")).otherwise(F.concat("above", F.array("raw_path"))).alias("above"),
            F.when(merged, F.col("kinds")).otherwise(F.concat("kinds", F.array("kind"))).alias("kinds"),
            (F.col("mandatory") & (F.col("kind") == "all")).alias("mandatory"),
        ).select(
            "text_key", "fragment", F.concat("raw_path", F.array("arm")).alias("raw_path"), "above", "kinds",
            "mandatory",
        )
    decided = store.all()
    return _number(decided), _results(texts, decided)


def _number(decided: DataFrame) -> DataFrame:
    """Final ordinals and paths.  All work is per text: one shuffle on ``text_key``."""
    spliced = F.coalesce(F.get(F.col("kinds"), F.size("kinds") - 1) == F.col("kind"), F.lit(False))
    kept = decided.where(~spliced).repartition("text_key")
    kept = kept.withColumn("parent_raw", F.get(F.col("above"), F.size("above") - 1))
    siblings = Window.partitionBy("text_key", "parent_raw").orderBy("raw_path")
    kept = kept.withColumn("ordinal", F.row_number().over(siblings) - 1)
    places = kept.where(F.col("kind").isin("any", "all")).groupBy("text_key").agg(
        F.map_from_entries(F.collect_list(F.struct("raw_path", "ordinal"))).alias("place")
    )
    kept = kept.join(places, "text_key", "left")
    steps = F.concat(F.transform("above", lambda a: F.col("place")[a]), F.array("ordinal"))
    leaf = ~F.col("kind").isin("any", "all")
    return kept.withColumn("steps", steps).select(
        "text_key",
        F.array_join("steps", ".").alias("path"),
        F.when(F.size("steps") > 1, F.array_join(F.slice("steps", 1, F.size("steps") - 1), ".")).alias("parent_path"),
        "ordinal",
        F.size("kinds").alias("depth"),
        "steps",
        "kinds",
        "kind",
        "code",
        "qualifier",
        "pat_subject",
        "pat_min_level",
        F.when(leaf & (F.col("kind") != "course"), F.col("text")).alias("text"),
        "mandatory",
    )


def _results(texts: DataFrame, decided: DataFrame) -> DataFrame:
    hints = decided.where(F.col("warning").isNotNull()).groupBy("text_key").agg(F.first("warning").alias("hint"))
    grouping = F.when(~grouping_balanced("raw"), WARN_GROUPING)
    warnings = F.filter(F.array(grouping, F.col("hint")), lambda w: w.isNotNull())
    joined = texts.join(hints, "text_key", "left").withColumn("warnings", warnings)
    status = F.when(F.size("warnings") > 0, "partial").otherwise("parsed")
    return joined.select("text_key", status.alias("status"), "warnings")


def cleaned_texts(requirements: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``(keys..., raw)`` with the text in the form that is parsed."""
    return requirements.select(*(keys or ["owner", "relation"]), T.clean_text("raw").alias("raw"))


def parse_requirements(requirements: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """``requirements(owner, relation, raw, ...)`` -> ``(req_nodes, parsed requirements)``.

    ``keys`` are the columns that identify a requirement (default owner, relation).  Each distinct
    text is parsed once and joined back, so a phrase shared by a third of all rows costs one parse.
    """
    keys = keys or ["owner", "relation"]
    keyed = cleaned_texts(requirements, keys).withColumn("text_key", F.sha2("raw", 256))
    texts = stage(keyed.select("text_key", "raw").distinct())
    nodes, results = parse_texts(texts)
    nodes = stage(nodes)
    req_nodes = keyed.select(*keys, "text_key").join(nodes, "text_key").drop("text_key")
    parsed = keyed.join(results, "text_key").select(*keys, "raw", "status", "warnings")
    return req_nodes, parsed


def course_references(req_nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Course leaves in document order (``position`` per requirement), duplicates kept."""
    keys = keys or ["owner", "relation"]
    leaves = req_nodes.where((F.col("kind") == "course") & F.col("code").isNotNull())
    in_text = Window.partitionBy(*keys).orderBy("steps")
    return leaves.select(*keys, F.col("code").alias("ref"), (F.row_number().over(in_text) - 1).alias("position"), "mandatory")


def mandatory_references(req_nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Courses reachable through ALL junctions only."""
    keys = keys or ["owner", "relation"]
    hit = (F.col("kind") == "course") & F.col("mandatory") & F.col("code").isNotNull()
    return req_nodes.where(hit).select(*keys, F.col("code").alias("ref"))


def subject_references(req_nodes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct subjects a requirement mentions, through courses or course patterns."""
    keys = keys or ["owner", "relation"]
    subject = F.when(F.col("kind") == "course", F.split_part("code", F.lit(" "), F.lit(1))).otherwise(F.col("pat_subject"))
    return req_nodes.where(F.col("kind").isin("course", "coursePattern")).select(
        *keys, subject.alias("subject")
    ).where(F.col("subject").rlike("^[A-Z]{4}$")).distinct()
