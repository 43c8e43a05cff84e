"""Column functions over landed text: cleaning, course codes, credits, labels, hashes.

Everything here is a built-in expression, so it stays inside the JVM and inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------------------------
# White space as browsers define it (NBSP, the Unicode spaces, BOM); Java's \s is ASCII only.
_OTHER_SPACES = [0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
SPACE_CHARS = r"\t\n\x0B\f\r " + "".join(map(chr, _OTHER_SPACES))
# The same characters as ranges: a pattern tests a character against every member of its class.
SPACE = r"[\t-\r \xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
_SPACES = "\t\n\x0B\f\r " + "".join(map(chr, _OTHER_SPACES))
# Typographic dashes U+2010..U+2015 and the minus sign, read as "-".
DASHES = "".join(map(chr, [*range(0x2010, 0x2016), 0x2212]))
# Whole-string patterns end in \z: Java's $ also matches before a line end, such as U+0085, that closes the text.
# A course reference inside text: four letters, optional - or _, four digits, optional letter.
COURSE = rf"(?<![A-Za-z0-9])([A-Za-z]{{4}}){SPACE}*[-_]?{SPACE}*(\d{{4}}[A-Za-z]?)(?![A-Za-z0-9])"
STRICT_CODE = rf"^{SPACE}*([A-Za-z]{{4}}){SPACE}*[-_]?{SPACE}*(\d{{4}}[A-Za-z]?){SPACE}*\z"
LOOSE_CODE = rf"^([A-Z]{{2,5}}){SPACE}*([0-9]{{4}}[A-Z]?)\z"
VALID_CODE = r"^[A-Z]{2,5} \d{4}[A-Z]?\z"
CREDITS = r"^(\d+(?:\.\d+)?)(?:-(\d+(?:\.\d+)?))?\z"
YEAR = r"^\d{4}-\d{2}\z"
# Entities in decoding order; "&amp;" comes first, so "&amp;lt;" ends up as "<".
ENTITIES = [
    (r"&amp;", "&"),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&#0?39;", "'"),
    (r"&rsquo;", chr(0x2019)),
]
# Branch kinds, tested in this order on the lower-cased title; anything else is "other".
BRANCH_KINDS = [
    ("option", "option"),
    ("track", "track"),
    ("stream", "stream"),
    ("speciali[sz]ation", "specialization"),
    ("concentration", "concentration"),
    ("area", "area"),
    ("courses", "courses"),
]
# ---------------------------------------------------------------------------------------------


def _text(c) -> Column:
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))


def trim_space(c) -> Column:
    """Strip every kind of white space from both ends."""
    return F.btrim(_text(c), F.lit(_SPACES))


def trim_end(c) -> Column:
    """Strip every kind of white space from the end; NULL stays."""
    return F.rtrim(c, F.lit(_SPACES))


def clean_text(c) -> Column:
    """NULL -> "", dashes unified, white-space runs collapsed to one blank, trimmed."""
    dashed = F.translate(_text(c), DASHES, "-" * len(DASHES))
    return F.trim(F.regexp_replace(dashed, f"{SPACE}+", " "))


def strict_code(c) -> Column:
    """Whole-string course code of a catalog (four letters) as ``ABCD 1234X``, else NULL."""
    up = F.upper(clean_text(c))
    return F.when(up.rlike(STRICT_CODE), F.regexp_replace(up, STRICT_CODE, "$1 $2"))


def loose_code(c) -> Column:
    """Code as students type it (2-5 letters); text that is no code comes back trimmed and upper-cased."""
    return F.regexp_replace(F.upper(trim_space(c)), LOOSE_CODE, "$1 $2")


def valid_code(c) -> Column:
    """A loose code that is well formed, else NULL.  Codes already in normal form cost one match."""
    raw = F.col(c) if isinstance(c, str) else c
    return F.when(raw.rlike(VALID_CODE), raw).when(
        F.upper(trim_space(raw)).rlike(LOOSE_CODE), F.regexp_replace(F.upper(trim_space(raw)), LOOSE_CODE, "$1 $2")
    )


def code_list(c) -> Column:
    """Array of raw codes -> distinct valid codes in binary order."""
    codes = F.transform(F.coalesce(c, F.array().cast("array<string>")), valid_code)
    return F.array_sort(F.array_distinct(F.filter(codes, lambda x: x.isNotNull())))


def course_refs(c) -> Column:
    """Every course referenced in a text, in text order, duplicates kept."""
    hits = F.regexp_extract_all(_text(c), F.lit(COURSE), F.lit(0))
    return F.transform(hits, lambda hit: F.upper(F.regexp_replace(hit, STRICT_CODE, "$1 $2")))


def distinct_course_refs(c) -> Column:
    """The referenced courses in first-seen order."""
    return F.array_distinct(course_refs(c))


def has_course(c) -> Column:
    return _text(c).rlike(COURSE)


def course_level(code) -> Column:
    """First digit of the course number."""
    return F.regexp_extract(_text(code), r"^\S+ (\d)", 1).try_cast("int")


def decode_entities(c) -> Column:
    out = _text(c)
    for pattern, char in ENTITIES:
        out = F.regexp_replace(out, pattern, char)
    return out


def element_text(html) -> Column:
    """Text of a markup fragment: tags become blanks, entities are decoded, then cleaned."""
    return clean_text(decode_entities(F.regexp_replace(_text(html), r"<[^>]*>", " ")))


def strip_marks(c) -> Column:
    """Drop trailing deletion marks ``***``."""
    return trim_space(F.regexp_replace(_text(c), r"\*+$", ""))


def table_code(subject, number) -> Column:
    """Catalog code of a table row; cross-listed subjects and number ranges take their first entry."""
    first_subject = trim_space(F.split_part(_text(subject), F.lit("/"), F.lit(1)))
    first_number = trim_space(F.split_part(strip_marks(number), F.lit("-"), F.lit(1)))
    return strict_code(F.concat_ws(" ", first_subject, first_number))


def credit_range(c) -> Column:
    """``"3"`` or ``"3-6"`` -> struct(min, max); anything else -> NULL."""
    t = trim_space(c)
    low = F.regexp_extract(t, CREDITS, 1).try_cast("double")
    high = F.regexp_extract(t, CREDITS, 2).try_cast("double")
    return F.when(t.rlike(CREDITS), F.struct(low.alias("min"), F.coalesce(high, low).alias("max")))


def _number(c: Column) -> Column:
    whole = c.cast("bigint")
    return F.when(c == whole, whole.cast("string")).otherwise(c.cast("string"))


def format_range(low, high) -> Column:
    """Inverse of :func:`credit_range`; equal ends collapse."""
    return F.when(low == high, _number(low)).otherwise(F.concat_ws("-", _number(low), _number(high)))


def label_key(c) -> Column:
    """Key under which two section headings count as the same."""
    plural = F.replace(F.lower(_text(c)), F.lit("(s)"), F.lit("s"))
    return F.regexp_replace(plural, r"[^a-z0-9]+", "")


def slug(c) -> Column:
    dashed = F.regexp_replace(F.lower(_text(c)), r"[^a-z0-9]+", "-")
    bare = F.regexp_replace(dashed, r"^-+|-+$", "")
    return F.when(bare == "", "section").otherwise(bare)


def section_slug(c) -> Column:
    return slug(F.regexp_replace(_text(c), r"(?i)\(s\)", "s"))


def human_title(c) -> Column:
    plain = F.regexp_replace(_text(c), r"(?i)\(s\)", "s")
    return F.trim(F.regexp_replace(plain, f"{SPACE}+", " "))


def choice_count(note) -> Column:
    """The N of "N courses" in a choice row's prose, 0 if it names none."""
    n = F.regexp_extract(_text(note), rf"(?i)(?<![A-Za-z0-9_])(\d+){SPACE}*courses?(?![A-Za-z0-9_])", 1)
    return F.coalesce(n.try_cast("int"), F.lit(0))


def group_label(kind, note) -> Column:
    n = choice_count(note)
    choose = F.when(n > 1, F.concat(F.lit("Choose "), n.cast("string"))).otherwise("Choose one")
    return F.when(_text(kind) == "or", F.concat(choose, F.lit(" | OR"))).otherwise("Complete all | AND")


def branch_kind(title) -> Column:
    low = F.lower(_text(title))
    out = F.lit(None).cast("string")
    for pattern, kind in reversed(BRANCH_KINDS):
        out = F.when(low.rlike(pattern), kind).otherwise(out)
    return F.coalesce(out, F.lit("other"))


def catalog_credits(c) -> Column:
    """Credits of a catalog record without a trailing "credit(s)"."""
    return trim_space(F.regexp_replace(_text(c), rf"(?i){SPACE}*credits?\(s\){SPACE}*$", ""))


def text_hash(c) -> Column:
    """SHA-256 of the text with white space collapsed."""
    return F.sha2(F.trim(F.regexp_replace(_text(c), f"{SPACE}+", " ")), 256)


def is_year(c) -> Column:
    return _text(c).rlike(YEAR)


def numeric_level(c) -> Column:
    """Level as a number; NULL, "", NaN and infinities become NULL."""
    value = (F.col(c) if isinstance(c, str) else c).cast("string").try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def canonical_json(*columns: str) -> Column:
    """Rows as JSON with keys in sorted order and without the generation stamp."""
    kept = sorted(c for c in columns if c != "generated_at")
    return F.to_json(F.struct(*kept), {"ignoreNullFields": "false"})
