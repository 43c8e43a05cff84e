"""Student snapshots: validated reading and writing of exported state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions import text as T
from trellis.operators.students import program_choice

# ---- fixed values ---------------------------------------------------------------------------
VERSION = 1
THEMES = ["light", "dark"]
# ---------------------------------------------------------------------------------------------


def _get(variant, path: str, kind: str):
    return F.try_variant_get(variant, path, kind)


def _codes(variant, path: str):
    raw = F.transform(F.coalesce(_get(variant, path, "array<variant>"), F.array().cast("array<variant>")), lambda v: _get(v, "$", "string"))
    return T.code_list(raw)


def read_snapshots(texts: DataFrame, stamp: str) -> dict[str, DataFrame]:
    """``texts(student, text)`` -> ``codes, programs, preferences, accepted, rejected``.

    ``stamp`` is the format name our own exports carry.  Rejected: not JSON, not an object, another
    format's stamp, and unstamped objects with nothing usable in them.  A flat file without year
    buckets counts as one bucket of its stated year ("" if none).
    """
    v = F.col("v")
    read = texts.withColumn("v", F.try_parse_json("text"))
    kind = F.schema_of_variant(v)
    read = read.withColumn("is_object", F.coalesce(kind.startswith("OBJECT"), F.lit(False)))
    read = read.withColumn("format", F.when(F.col("is_object"), F.coalesce(_get(v, "$.format", "string"), F.lit(""))))
    read = read.withColumn("v", F.when(F.col("is_object"), v))

    entry = lambda e, focus: F.struct(
        _codes(e, "$.targets").alias("targets"), _codes(e, "$.completed").alias("completed"), T.valid_code(focus).alias("focus")
    )
    stated = F.coalesce(_get(v, "$.years", "map<string,variant>"), F.create_map().cast("map<string,variant>"))
    objects = F.map_filter(stated, lambda _, e: F.coalesce(F.schema_of_variant(e).startswith("OBJECT"), F.lit(False)))
    years = F.transform_values(objects, lambda _, e: entry(e, _get(e, "$.focus", "string")))
    done = F.when(_get(v, "$.completed", "variant").isNotNull(), _codes(v, "$.completed")).otherwise(_codes(v, "$.completions"))
    flat = F.struct(_codes(v, "$.targets").alias("targets"), done.alias("completed"), T.valid_code(_get(v, "$.focus", "string")).alias("focus"))
    flat_year = T.trim_space(F.coalesce(F.nullif(_get(v, "$.year", "string"), F.lit("")), _get(v, "$.catalogYear", "string")))
    read = read.withColumn("years", years).withColumn("flat", flat)
    usable = (F.size("flat.targets") > 0) | (F.size("flat.completed") > 0) | F.col("flat.focus").isNotNull()
    read = read.withColumn("years", F.when((F.size("years") == 0) & usable, F.create_map(flat_year, F.col("flat"))).otherwise(F.col("years")))

    raw_program = F.coalesce(F.when(F.schema_of_variant(_get(v, "$.major", "variant")).startswith("OBJECT"), F.to_json(_get(v, "$.major", "variant"))), _get(v, "$.major", "string"))
    hide = F.when(F.schema_of_variant(_get(v, "$.preferences.hideFulfilledPrereq", "variant")) == "BOOLEAN", _get(v, "$.preferences.hideFulfilledPrereq", "boolean"))
    theme = F.when(_get(v, "$.preferences.theme", "string").isin(THEMES), _get(v, "$.preferences.theme", "string"))
    read = read.withColumn("program", program_choice(raw_program)).withColumn("hide_fulfilled", hide).withColumn("theme", theme)
    has_data = (F.size("years") > 0) | F.col("program").isNotNull() | F.col("hide_fulfilled").isNotNull() | F.col("theme").isNotNull()
    reason = (
        F.when(F.try_parse_json("text").isNull(), "not valid JSON")
        .when(~F.col("is_object"), "not a snapshot")
        .when((F.col("format") != "") & (F.col("format") != stamp), "exported by another application")
        .when(~F.coalesce(has_data, F.lit(False)) & (F.col("format") != stamp), "no usable data")
    )
    read = read.withColumn("reject_reason", reason)
    good = read.where(F.col("reject_reason").isNull())
    buckets = good.select("student", F.explode("years").alias("year", "e"))
    listed = F.array(
        F.struct(F.lit("targets").alias("kind"), F.col("e.targets").alias("codes")),
        F.struct(F.lit("completed").alias("kind"), F.col("e.completed").alias("codes")),
        F.struct(F.lit("focus").alias("kind"), F.when(F.col("e.focus").isNotNull(), F.array("e.focus")).alias("codes")),
    )
    codes = buckets.select("student", "year", F.inline(listed)).select("student", "year", "kind", F.explode("codes").alias("code"))
    return dict(
        codes=codes,
        programs=good.where(F.col("program").isNotNull()).select("student", "program.*"),
        preferences=good.select("student", "hide_fulfilled", "theme"),
        accepted=good.select("student", F.size("years").alias("year_count")),
        rejected=read.where(F.col("reject_reason").isNotNull()).select("student", F.col("reject_reason").alias("reason")),
    )


def snapshot_documents(codes: DataFrame, programs: DataFrame, preferences: DataFrame, stamp: str, exported_at: str) -> DataFrame:
    """``(student, text)``: one snapshot per student, codes distinct and sorted per year.

    Codes are made distinct first, so a list holds each catalog course at most once.
    """
    distinct = codes.select("student", "year", "kind", T.valid_code("code").alias("code")).where(F.col("code").isNotNull()).distinct()

    def listed(kind: str):
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("code")))).alias(kind)

    focus = F.max(F.when(F.col("kind") == "focus", F.col("code"))).alias("focus")
    per_year = distinct.groupBy("student", "year").agg(listed("targets"), listed("completed"), focus)
    years = per_year.groupBy("student").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", F.struct("targets", "completed", "focus").alias("e"))))).alias("years")
    )
    program = programs.select("student", F.struct("id", F.col("program_code").alias("programCode"), "intake", F.col("catalog_year").alias("catalogYear")).alias("major"))
    prefs = preferences.select("student", F.struct(F.col("hide_fulfilled").alias("hideFulfilledPrereq"), "theme").alias("preferences"))
    joined = years.join(program, "student", "full").join(prefs, "student", "full")
    body = F.to_json(F.struct(
        F.lit(stamp).alias("format"), F.lit(VERSION).alias("version"), F.lit(exported_at).alias("exportedAt"), "years", "major", "preferences"
    ))
    return joined.select("student", body.alias("text"))
