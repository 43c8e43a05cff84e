"""Landed catalog pages -> subjects, courses and requirement texts; program pages -> document links.

Pages are ``(url, year, html)`` rows.  A page is cut into list items and each item into fields with
built-in expressions, so pages parse in parallel and nothing is shuffled.  Pages that do not look
right go to a quarantine table with a reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions import text as T

# ---- fixed values ---------------------------------------------------------------------------
RELATION_LABELS = {
    "prerequisite(s)": "prerequisite",
    "corequisite(s)": "corequisite",
    "exclusion(s)": "exclusion",
}
PROGRAM_TITLE = r'(?i)<div class="program-title">([^<]+)</div>'
PROGRAM_INTAKE = r'(?i)<div class="pg-wording">\s*For students admitted in (\d{4}-\d{2})\s*</div>'
LINK_LABEL = "Major Requirements:"
# ---------------------------------------------------------------------------------------------

_DEPTH = chr(0xFDD2)


def _classed(tag: str, name: str) -> str:
    """Regex of an opening tag with a class."""
    return rf"""<{tag}\b[^>]*\bclass\s*=\s*(?:"(?:[^"]*\s)?{name}(?:\s[^"]*)?"|'(?:[^']*\s)?{name}(?:\s[^']*)?')[^>]*>"""


def _first(html, tag: str, name: str) -> Column:
    """Inner markup of the first element with the class; NULL if there is none."""
    pattern = rf"(?is){_classed(f'({tag})', name)}(.*?)</\1\s*>"
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 2))


def _items(html, list_name: str, item_name: str) -> Column:
    """Markup of each list item, from its opening tag to the next one."""
    body = F.regexp_extract(html, rf"(?is){_classed('ul', list_name)}(.*)$", 1)
    pieces = F.split(body, rf"(?i)(?={_classed('li', item_name)})")
    return F.filter(pieces, lambda p: p.rlike(rf"(?i)^{_classed('li', item_name)}"))


def _without_comments(html) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def extract_subjects(pages: DataFrame, base_url: str) -> tuple[DataFrame, DataFrame]:
    """``(subjects(year, code, name, source_url, position), rejected(url, reason))``."""
    read = pages.withColumn("html", _without_comments(F.col("html")))
    html = F.col("html")
    titled = F.coalesce(T.element_text(_first(html, "h1", "page-title")).contains(F.col("year")), F.lit(False))
    listed = html.rlike(f"(?i){_classed('ul', 'subject-list')}")
    href = r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""

    def read_item(item):
        return F.struct(
            F.upper(T.element_text(_first(item, r"\w+", "subject-code"))).alias("code"),
            T.element_text(_first(item, r"\w+", "subject-name")).alias("name"),
            _first(item, r"\w+", "subject-name").isNotNull().alias("named"),
            F.when(item.rlike(href), F.regexp_extract(item, href, 1)).alias("href"),
        )

    items = F.filter(
        F.transform(_items(html, "subject-list", "subject"), read_item),
        lambda s: s["code"].rlike("^[A-Z]{4}$") & s["named"] & s["href"].isNotNull(),
    )
    judged = read.select("url", "year", items.alias("items"), (
        F.when(~titled, "not the subject index of the year").when(~listed, "no subject list").when(F.size(items) == 0, "no valid subjects")
    ).alias("reason"))
    found = judged.where(F.col("reason").isNull()).select("year", F.posexplode("items").alias("position", "s"))
    link = F.when(F.col("s.href").startswith("http"), F.col("s.href")).otherwise(F.concat(F.lit(base_url), F.col("s.href")))
    subjects = found.select("year", "s.code", "s.name", link.alias("source_url"), "position")
    return subjects, judged.where(F.col("reason").isNotNull()).select("url", "reason")


def _number_divs(html) -> Column:
    """Write its nesting depth at every div: ``<depth><div ...>`` and ``</div><depth>``."""
    tokens = F.regexp_extract_all(html, F.lit(r"(?is)<div\b[^>]*>|</div\s*>|(?:(?!</?div\b).)+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def walk(acc, tok):
        opens, closes = tok.rlike(r"(?i)^<div\b"), tok.rlike(r"(?i)^</div")
        depth = acc["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)
        mark = F.concat(F.lit(_DEPTH), F.when(opens, depth).otherwise(acc["depth"]).cast("string"), F.lit(_DEPTH))
        text = F.when(opens, F.concat(mark, tok)).when(closes, F.concat(tok, mark)).otherwise(tok)
        return F.struct(depth.alias("depth"), F.concat(acc["out"], text).alias("out"))

    return F.aggregate(tokens, start, walk, lambda acc: acc["out"])


def _div_at(html, depth: Column, name: str) -> Column:
    """Inner markup of the first div with the class at a nesting depth; NULL if there is none."""
    mark = F.concat(F.lit(_DEPTH), depth.cast("string"), F.lit(_DEPTH))
    pattern = F.concat(F.lit("(?is)"), mark, F.lit(_classed("div", name) + r"(.*?)</div\s*>"), mark)
    return F.when(F.regexp_like(html, pattern), F.call_function("regexp_extract", html, pattern, F.lit(1)))


def _plain(html) -> Column:
    return T.element_text(F.regexp_replace(html, rf"{_DEPTH}\d+{_DEPTH}", ""))


def extract_courses(pages: DataFrame, base_url: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(courses, requirements(year, owner, relation, raw), rejected)``.

    ``pages(url, year, subject, html)`` with the subject each page was requested for.  Only direct
    ``div`` children count as header, detail, label and value.
    """
    read = pages.withColumn("html", _without_comments(F.col("html"))).withColumn("subject", F.upper("subject"))
    html = F.col("html")
    titled = F.coalesce(T.element_text(_first(html, "h1", "page-title")).contains(F.col("year")), F.lit(False))
    page_subject = F.upper(T.element_text(_first(F.regexp_extract(html, rf"(?is)({_classed(chr(92) + 'w+', 'subject-name')}.*)", 1), r"\w+", "subject-code")))
    listed = html.rlike(f"(?i){_classed('ul', 'crse-list')}")
    reason = F.when(~titled, "not a course page of the year").when(page_subject != F.col("subject"), "page of another subject").when(~listed, "no course list")
    pages_ok = read.withColumn("reason", reason)
    good = pages_ok.where(F.col("reason").isNull())
    items = good.select("url", "year", "subject", F.posexplode(_items(html, "crse-list", "crse")).alias("position", "item"))
    items = items.withColumn("item", _number_divs(F.col("item")))
    one = F.lit(1)
    items = items.withColumn("header", _div_at(F.col("item"), one, "crse-header")).withColumn("detail", _div_at(F.col("item"), one, "crse-detail"))
    header = F.col("header")
    title = _first(header, r"\w+", "crse-title")
    items = items.withColumn("code", T.strict_code(_plain(_first(header, r"\w+", "crse-code")))).where(
        F.col("detail").isNotNull() & F.col("code").startswith(F.concat("subject", F.lit(" "))) & title.isNotNull()
    )
    opening = rf"(?i)(?={_DEPTH}\d+{_DEPTH}{_classed('div', 'data-row')})"

    def read_row(piece):
        depth = F.regexp_extract(piece, rf"^{_DEPTH}(\d+)", 1).try_cast("int")
        mark = F.concat(F.lit(_DEPTH), depth.cast("string"), F.lit(_DEPTH))
        own = F.call_function("substring_index", piece, mark, F.lit(2))
        inner = F.coalesce(depth, F.lit(0)) + 1
        return F.struct(F.lower(_plain(_div_at(own, inner, "header"))).alias("label"), _plain(_div_at(own, inner, "data")).alias("value"),
                        (_div_at(own, inner, "header").isNotNull() & _div_at(own, inner, "data").isNotNull()).alias("whole"))

    rows = F.filter(F.transform(F.split("detail", opening), read_row), lambda r: r["whole"])
    items = items.withColumn("rows", rows)
    description = F.element_at(F.filter("rows", lambda r: r["label"] == "description"), -1)["value"]
    link = F.coalesce(F.nullif("url", F.lit("")), F.concat(F.lit(base_url + "/ugcourse/"), "year", F.lit("/"), "subject", F.lit("/")))
    courses = items.select(
        "year", "code", "subject", F.split_part("code", F.lit(" "), F.lit(2)).alias("number"), _plain(title).alias("title"),
        F.coalesce(_plain(_first(header, r"\w+", "crse-unit")), F.lit("")).alias("credits"),
        F.coalesce(F.when(F.size(F.filter("rows", lambda r: r["label"] == "description")) > 0, description), F.lit("")).alias("description"),
        link.alias("source_url"), "position",
    )
    label = F.create_map(*[F.lit(x) for pair in RELATION_LABELS.items() for x in pair])
    stated = items.select("year", "code", F.posexplode("rows").alias("at", "row")).select(
        "year", F.col("code").alias("owner"), label[F.col("row.label")].alias("relation"), F.col("row.value").alias("raw"), "at"
    ).where(F.col("relation").isNotNull() & (F.col("raw") != ""))
    requirements = stated.groupBy("year", "owner", "relation").agg(F.max_by("raw", "at").alias("raw"))
    empty = good.select("url", "year", "subject").join(courses.select("year", "subject").distinct(), ["year", "subject"], "left_anti")
    rejected = pages_ok.where(F.col("reason").isNotNull()).select("url", "reason").unionByName(
        empty.select("url", F.lit("no valid courses").alias("reason"))
    )
    return courses, requirements, rejected


def discover_programs(pages: DataFrame, intake: str) -> DataFrame:
    """Distinct program codes linked from landed index pages, sorted."""
    pattern = rf'/ugprog/\Q{intake}\E/([A-Z]{{2,6}})["/]'
    codes = pages.select(F.explode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("program_code"))
    return codes.distinct().orderBy("program_code")


def discover_sources(pages: DataFrame, link_prefix: str) -> tuple[DataFrame, DataFrame]:
    """``(sources(program_code, title, intake, document_url), failed)`` from landed program pages.

    ``pages(program_code, intake, html)``; ``link_prefix`` is a regex of the document host and
    folder.  The link labelled as the requirements wins over any other document link.
    """
    anchored = rf'(?i)<a\s[^>]*href="({link_prefix}[^"]+\.pdf)"[^>]*>\s*{LINK_LABEL}'
    generic = rf"""(?i){link_prefix}[^"'\s]+\.pdf"""
    html = F.col("html")
    link = F.coalesce(F.nullif(F.regexp_extract(html, anchored, 1), F.lit("")), F.nullif(F.regexp_extract(html, generic, 0), F.lit("")))
    title = F.when(html.rlike(PROGRAM_TITLE), T.clean_text(T.decode_entities(F.regexp_extract(html, PROGRAM_TITLE, 1)))).otherwise(F.col("program_code"))
    intake = F.when(html.rlike(PROGRAM_INTAKE), F.regexp_extract(html, PROGRAM_INTAKE, 1)).otherwise(F.col("intake"))
    read = pages.select("program_code", title.alias("title"), intake.alias("intake"), link.alias("document_url"))
    failed = read.where(F.col("document_url").isNull()).select("program_code", F.lit("no requirement document linked").alias("reason"))
    return read.where(F.col("document_url").isNotNull()), failed
