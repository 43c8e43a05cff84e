"""Student state: merging snapshots, targets, completion toggles, key/value buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions import text as T

# ---- fixed values ---------------------------------------------------------------------------
# State keys are "<namespace>:<kind>:<year>"; "target" is the older single-target key.
KEY_KINDS = {"ustree": "targets", "completed": "completed", "focus": "focus", "target": "legacy"}
# ---------------------------------------------------------------------------------------------
KEY = ["student", "year", "kind", "code"]


def bucket_keys(state: DataFrame, namespace: str) -> DataFrame:
    """``state(student, key, value)`` -> ``(student, kind, year, value)``; foreign keys are dropped."""
    pattern = rf"^\Q{namespace}\E:({'|'.join(KEY_KINDS)}):(.+)$"
    names = F.create_map(*[F.lit(x) for pair in KEY_KINDS.items() for x in pair])
    known = state.where(F.col("key").rlike(pattern))
    return known.select(
        "student", names[F.regexp_extract("key", pattern, 1)].alias("kind"), F.regexp_extract("key", pattern, 2).alias("year"), "value"
    )


def state_codes(buckets: DataFrame) -> DataFrame:
    """Buckets -> ``(student, year, kind, code)``: JSON lists and single codes, valid ones only."""
    listed = F.from_json("value", "array<string>")
    codes = F.when(F.col("kind").isin("targets", "completed"), listed).otherwise(F.array("value"))
    exploded = buckets.select("student", "year", "kind", F.explode(codes).alias("raw"))
    return exploded.select("student", "year", "kind", T.valid_code("raw").alias("code")).where(F.col("code").isNotNull()).distinct()


def load_targets(buckets: DataFrame) -> DataFrame:
    """Targets per student and year; the legacy key counts only where no modern list exists at all,
    not even an empty one."""
    codes = state_codes(buckets)
    modern = buckets.where(F.col("kind") == "targets").select("student", "year").distinct()
    legacy = codes.where(F.col("kind") == "legacy").join(modern, ["student", "year"], "left_anti")
    return codes.where(F.col("kind") == "targets").unionByName(legacy).select("student", "year", "code").distinct()


def export_targets(buckets: DataFrame) -> DataFrame:
    """Targets as an export writes them: the legacy key fills in where the modern list has no valid code."""
    codes = state_codes(buckets)
    modern = codes.where(F.col("kind") == "targets")
    legacy = codes.where(F.col("kind") == "legacy").join(modern.select("student", "year"), ["student", "year"], "left_anti")
    return modern.unionByName(legacy).select("student", "year", "code").distinct()


def merge_snapshots(existing: DataFrame, incoming: DataFrame, fallback_year: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(merged codes, summary, skipped years)``; nothing existing is ever dropped.

    Both sides are ``(student, year, kind, code)``.  A blank year takes ``fallback_year`` or is
    skipped.  The summary counts total and added codes per student, year and kind that the
    incoming side touches.
    """
    year = F.coalesce(F.nullif("year", F.lit("")), F.nullif(F.lit(fallback_year or ""), F.lit("")))
    resolved = incoming.withColumn("year", year)
    skipped = resolved.where(F.col("year").isNull()).select("student").distinct()
    arriving = resolved.where(F.col("year").isNotNull()).select(*KEY).withColumn("_new", F.lit(1)).withColumn("_old", F.lit(0))
    standing = existing.select(*KEY).withColumn("_new", F.lit(0)).withColumn("_old", F.lit(1))
    # One pass over both sides; repeated rows collapse before the shuffle.
    both = standing.unionByName(arriving).groupBy(*KEY).agg(F.max("_new").alias("_new"), F.max("_old").alias("_old"))
    touched = both.groupBy("student", "year", "kind").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("_old") == 0).alias("added"), F.max("_new").alias("_new")
    )
    return both.select(*KEY), touched.where("_new = 1").drop("_new"), skipped


def overwrite_preferences(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``(student, key, value)``: incoming focus, program and preferences replace existing ones."""
    kept = existing.join(incoming.select("student", "key"), ["student", "key"], "left_anti")
    return kept.select("student", "key", "value").unionByName(incoming.select("student", "key", "value"))


def add_targets(targets: DataFrame, more: DataFrame) -> DataFrame:
    valid = more.select("student", T.valid_code("code").alias("code")).where(F.col("code").isNotNull())
    return targets.select("student", "code").unionByName(valid).distinct()


def remove_targets(targets: DataFrame, gone: DataFrame) -> DataFrame:
    codes = gone.select("student", T.loose_code("code").alias("code"))
    return targets.select("student", "code").join(codes, ["student", "code"], "left_anti")


def latest_toggles(toggles: DataFrame) -> DataFrame:
    """``(student, code, done, ts, event_id)``: the last toggle per student and course wins.

    A maximum per key, so it combines before the shuffle however often one course is toggled.
    """
    last = F.max_by(F.struct("done", "ts", "event_id"), F.struct("ts", "event_id"))
    return toggles.groupBy("student", "code").agg(last.alias("e")).select("student", "code", "e.done", "e.ts", "e.event_id")


def current_completions(toggles: DataFrame) -> DataFrame:
    return latest_toggles(toggles).where("done").select("student", "code")


def program_choice(raw) -> Column:
    """Selected program from a snapshot value: a bare id or an object with ``id``/``programId``."""
    text = T.trim_space(raw)
    parsed = F.from_json(text, "id string, programId string, programCode string, intake string, catalogYear string")
    blank = lambda c: F.nullif(T.trim_space(c), F.lit(""))
    is_object = text.startswith("{")
    # The first non-empty of id and programId counts, even if it is only blanks.
    stated = F.coalesce(F.nullif(parsed["id"], F.lit("")), parsed["programId"])
    ident = F.when(is_object, blank(stated)).otherwise(F.nullif(text, F.lit("")))
    field = lambda name: F.when(is_object, blank(parsed[name]))
    return F.when(ident.isNotNull(), F.struct(
        ident.alias("id"), field("programCode").alias("program_code"), field("intake").alias("intake"), field("catalogYear").alias("catalog_year")
    ))
