"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

A rule bounds one ratio of two measures of a text, in hundredths.  :func:`quality` measures every whole text once
(words, symbols, stop words, lines) and judges all rules in the same projection: no user function, no shuffle, and a
text meets no other text.  Ratios are compared as products of integers, so no rounding decides.

Words are runs of anything but the six ASCII white-space characters.  Lines are cut at line feeds; lines without a
word count for nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_BREAK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = "[#*$%&|<>]"
BULLETS = ("-", "*", "•")
#: Common function words of English, French, German and Spanish.
STOP_WORDS = sorted(set(
    "the of and to a in is that it for was on with as be this by are at from or not "
    "de la le et les des en du un que pour une est qui dans par sur au pas avec "
    "der die und den das von zu mit sich auf für nicht dem ist im ein eine als "
    "el y los las del se no por con su para es al lo una".split()
))
#: Stop words in small letters, with a capital, or in capitals.
WRITTEN_STOP_WORDS = sorted({f(w) for w in STOP_WORDS for f in (str.lower, str.capitalize, str.upper)})


@dataclass(frozen=True)
class Rule:
    """``low`` to ``high`` hundredths of ``of`` are allowed for ``measure``; None leaves a side open."""

    name: str
    measure: str
    of: str
    low: int | None = None
    high: int | None = None

    def holds(self, measures: dict[str, Column]) -> Column:
        """Is the rule kept?  A ratio of nothing is within all bounds."""
        value, base = 100 * measures[self.measure], measures[self.of]
        kept = F.lit(True)
        if self.low is not None:
            kept &= value >= self.low * base
        if self.high is not None:
            kept &= value <= self.high * base
        return kept


#: What a text must keep whatever its kind: length, and few words in repeated passages.
BASE_RULES = (
    Rule("too short", "n_words", "one", low=5000),
    Rule("repeated words", "n_repeat_words", "n_words", high=50),
)
#: The thresholds of the verdict.
RULES = (
    Rule("word length", "word_chars", "n_words", low=300, high=1000),
    Rule("symbols", "n_symbols", "n_words", high=10),
    Rule("stop words", "n_stop_words", "n_words", low=2),
    Rule("duplicate lines", "n_dup_lines", "n_lines", high=50),
    Rule("bullet lines", "n_bullet_lines", "n_lines", high=90),
    Rule("cut lines", "n_cut_lines", "n_lines", high=30),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column, width: int = 3) -> Column:
    """Number of words inside windows of ``width`` words that occur twice or more, the first one too.

    Where all windows have different hashes none occurs twice.  Otherwise the windows themselves are sorted with
    their places, so equal ones are neighbours; the places of those that have an equal neighbour, sorted again, give
    the covered words by their gaps.
    """
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - (width - 1), F.lit(0)))
    window = lambda x, i: [x, *(F.get(words, i + k) for k in range(1, width))]
    hashes = F.transform(starts, lambda x, i: F.xxhash64(*window(x, i)))
    windows = F.transform(starts, lambda x, i: F.struct(F.concat_ws(" ", *window(x, i)).alias("w"), i.alias("i")))

    def places(s: Column) -> Column:
        twin = lambda x, k: F.when((x["w"] == F.get(s, k - 1)["w"]) | (x["w"] == F.get(s, k + 1)["w"]), x["i"])
        return F.sort_array(F.array_compact(F.transform(s, twin)))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, k: F.least(F.lit(width), F.get(p, k + 1) - x))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    unlike = _let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(unlike, F.lit(0).cast("long")).otherwise(_let(_let(F.sort_array(windows), places), covered))


def _measures(text: Column) -> Column:
    """All measures of a text as one struct."""
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda row: row.rlike(WORD))
    count = lambda c: c.cast("long")
    of_words = _let(words, lambda w: F.struct(
        count(F.size(w)).alias("n_words"),
        count(F.length(F.concat_ws("", w))).alias("word_chars"),
        count(F.size(F.filter(w, lambda x: x.isin(WRITTEN_STOP_WORDS)))).alias("n_stop_words"),
        _repeated(w).alias("n_repeat_words"),
    ))
    bullet = lambda row: F.left(F.ltrim(row), F.lit(1)).isin(*BULLETS)
    cut = lambda row: F.rtrim(row).endswith("...") | F.rtrim(row).endswith("…")
    of_lines = _let(lines, lambda rows: F.struct(
        count(F.size(rows)).alias("n_lines"),
        count(F.size(rows) - F.size(F.array_distinct(rows))).alias("n_dup_lines"),
        count(F.size(F.filter(rows, bullet))).alias("n_bullet_lines"),
        count(F.size(F.filter(rows, cut))).alias("n_cut_lines"),
    ))
    of_signs = F.struct(count(F.regexp_count(text, F.lit(SYMBOL))).alias("n_symbols"))
    return F.struct(of_words.alias("words"), of_lines.alias("lines"), of_signs.alias("signs"))


PLACES = {
    "n_words": "words", "n_stop_words": "words", "n_repeat_words": "words", "n_lines": "lines", "n_dup_lines": "lines",
    "n_bullet_lines": "lines", "n_cut_lines": "lines", "word_chars": "words", "n_symbols": "signs",
}


def quality(
    docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), base: Sequence[Rule] = BASE_RULES, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """doc_id, ``keep`` columns, all measures, base_failed, kept, and the names of the rules that are broken.

    ``kept`` is false where a rule of ``base`` or of ``rules`` is broken.  Null and empty texts have no words and no
    lines: they are too short.  Rows stand alone: null and repeated ids and repeated rows stay as they are.  Other
    columns are ignored, whatever their names; an empty table gives an empty result.
    """
    measured = F.struct(*(F.col(f"`{c}`") for c in (doc_id, *keep))).alias("_row"), _measures(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("_m")
    found = {name: F.col(f"_m.{place}.{name}") for name, place in PLACES.items()}
    known = found | {"one": F.lit(1).cast("long")}
    broken = F.array_compact(F.array(*(F.when(~r.holds(known), r.name) for r in (*base, *rules))))
    base_failed = F.arrays_overlap("_broken", F.array(*(F.lit(r.name) for r in base)))
    judged = docs.select(*measured).select("_row", "_m", broken.alias("_broken"))
    return judged.select(
        "_row.*", *(c.alias(name) for name, c in found.items()), base_failed.alias("base_failed"), (F.size("_broken") == 0).alias("kept"),
        F.col("_broken").alias("broken_rules"),
    )
