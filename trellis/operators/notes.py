"""Boolean course expressions at the head of "Note:" rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions import text as T
from trellis.operators.requirements import parse_texts
from trellis.session import stage

# ---- fixed values ---------------------------------------------------------------------------
PREFIX = rf"^{T.SPACE}*(?i:note){T.SPACE}*:?{T.SPACE}*"
_MARKS = rf"[{T.SPACE_CHARS},;+*]"
_CODE = rf"[A-Za-z]{{4}}{T.SPACE}*[-_]?{T.SPACE}*\d{{4}}[A-Za-z]?(?![A-Za-z0-9])"
# A bracket only opens an expression if a code or another bracket follows.
_OPEN = rf"[\[(](?={_MARKS}*(?:{_CODE}|[\[(]))"
_WORD = r"(?i:or|and)(?![A-Za-z0-9])"
_TOKEN = rf"{_OPEN}|[\])]|{_CODE}|{_WORD}"
# ---------------------------------------------------------------------------------------------


def note_tokens(text) -> Column:
    """Tokens up to the first one that cannot belong to an expression: ``( ) AND OR`` and codes."""
    body = F.regexp_replace(T._text(text), PREFIX, "")
    head = F.regexp_extract(body, rf"^(?:{_MARKS}|{_TOKEN})*+", 0)
    found = F.regexp_extract_all(head, F.lit(rf"[\[(]|[\])]|{_CODE}|(?i:or|and)"), F.lit(0))
    plain = F.transform(
        found,
        lambda t: F.when(t.isin("[", "("), "(")
        .when(t.isin("]", ")"), ")")
        .when(F.length(t) < 4, F.upper(t))
        .otherwise(F.upper(F.regexp_replace(t, T.STRICT_CODE, "$1 $2"))),
    )
    return F.when(T._text(text).rlike(PREFIX), plain)


def well_formed(tokens: Column) -> Column:
    """The tokens are one complete expression: operands and connectors alternate, brackets close."""
    start = F.struct(F.lit(0).alias("depth"), F.lit(True).alias("operand"), F.lit(True).alias("ok"))

    def read(acc, tok):
        opens, closes = tok == "(", tok == ")"
        connector = tok.isin("AND", "OR")
        fits = F.when(connector, ~acc["operand"]).when(closes, ~acc["operand"] & (acc["depth"] > 0)).otherwise(acc["operand"])
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        return F.struct(depth.alias("depth"), (connector | opens).alias("operand"), (acc["ok"] & fits).alias("ok"))

    whole = F.aggregate(tokens, start, read, lambda a: a["ok"] & ~a["operand"] & (a["depth"] == 0))
    return F.coalesce(whole, F.lit(False))


def parse_notes(notes: DataFrame, keys: list[str]) -> DataFrame:
    """``notes(keys..., text)`` -> nodes of those that start with an expression.

    ``(keys..., path, parent_path, steps, kinds, kind, code)`` with kinds and/or/course.  Prose notes
    give no rows.  The canonical token text goes through the same frontier passes as requirement
    text, once per distinct text.
    """
    tokens = notes.select(*keys, note_tokens("text").alias("tokens"))
    tokens = tokens.where(well_formed(F.col("tokens")))
    keyed = tokens.select(*keys, F.array_join("tokens", " ").alias("raw")).withColumn("text_key", F.sha2("raw", 256))
    nodes, _ = parse_texts(stage(keyed.select("text_key", "raw").distinct()))
    renamed = lambda k: F.when(k == "any", "or").when(k == "all", "and").otherwise(k)
    nodes = nodes.select(
        "text_key", "path", "parent_path", "steps", F.transform("kinds", renamed).alias("kinds"),
        renamed(F.col("kind")).alias("kind"), "code",
    )
    return keyed.select(*keys, "text_key").join(stage(nodes), "text_key").drop("text_key")
