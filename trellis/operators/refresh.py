"""Fingerprints, change detection, manifests and referential checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.functions import text as T

VOLATILE = "generated_at"


def row_hash(df: DataFrame, exclude: tuple[str, ...] = ()) -> Column:
    """SHA-256 of a row's canonical JSON, without the generation stamp."""
    names = [c for c in df.columns if c not in exclude and c != VOLATILE]
    return F.sha2(T.canonical_json(*names), 256)


def table_fingerprint(df: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """One hash per ``by`` group over all its rows, whatever order they are stored in.

    Each row hashes on its own; the group then needs only counts and sums of the row hashes, which
    combine before the shuffle, so a group of any size stays a constant-size aggregate.
    """
    digest = row_hash(df)
    # Four 60-bit words of the row digest, summed without overflow.
    words = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)").alias(f"w{i}") for i in range(4)]
    rows = df.select(*by, *words)
    sums = [F.sum(f"w{i}").cast("string") for i in range(4)]
    return rows.groupBy(*by).agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), *sums), 256).alias("fingerprint"))


def requirement_fingerprints(sections: DataFrame, tree: DataFrame, branches: DataFrame, branch_courses: DataFrame) -> DataFrame:
    """Hash of a program's parsed requirements: stable across re-extraction, moved by real changes."""
    parts = {"sections": sections, "tree": tree, "branches": branches, "branch_courses": branch_courses}
    named = None
    for name, part in parts.items():
        one = table_fingerprint(part, [], ["program"]).select("program", F.lit(name).alias("part"), "fingerprint")
        named = one if named is None else named.unionByName(one)
    whole = F.array_sort(F.collect_list(F.concat_ws("=", "part", "fingerprint")))  # at most four per program
    return named.groupBy("program").agg(F.sha2(F.array_join(whole, "|"), 256).alias("fingerprint"))


def diff(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., state)`` with unchanged / changed / added / removed, ignoring the generation stamp."""
    old = previous.select(*keys, row_hash(previous).alias("old"))
    new = current.select(*keys, row_hash(current.select(*previous.columns)).alias("new"))
    state = (
        F.when(F.col("old").isNull(), "added")
        .when(F.col("new").isNull(), "removed")
        .when(F.col("old") == F.col("new"), "unchanged")
        .otherwise("changed")
    )
    return old.join(new, keys, "full").select(*keys, state.alias("state"))


def write_if_changed(previous: DataFrame, current: DataFrame, keys: list[str], path: str, partition_by: str, check: bool = False) -> DataFrame:
    """Write only added or changed rows' partitions; ``check`` reports without writing."""
    states = diff(previous, current, keys)
    if not check:
        stale = states.where(F.col("state").isin("added", "changed", "removed")).select(*keys)
        parts = current.join(stale, keys, "left_semi").select(partition_by).distinct()
        current.join(parts, partition_by, "left_semi").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy(partition_by).parquet(path)
    return states


def stamp_changed(loads: DataFrame, key: str, at: str) -> DataFrame:
    """Per load whether its generation stamp differs from the load before; the first one never does."""
    earlier = loads.select(key, F.col(at).alias("_at"), F.col(VOLATILE).alias("_stamp"), F.col("load_no").alias("_no"))
    before = loads.join(earlier.withColumn("load_no", F.col("_no") + 1), [key, "load_no"], "left")
    changed = F.col("_stamp").isNotNull() & (F.col("_stamp") != F.coalesce(VOLATILE, F.lit("")))
    return before.select(key, "load_no", at, VOLATILE, changed.alias("changed"))


def rebuild_manifest(previous: DataFrame, refreshed: DataFrame, scope: DataFrame) -> DataFrame:
    """Entries of refreshed programs plus the previous entries of programs outside the scope."""
    untouched = previous.join(scope.select("program_code"), "program_code", "left_anti")
    return refreshed.select(*previous.columns).unionByName(untouched).orderBy("program_code")


def select_scope(asked: DataFrame | None, committed: DataFrame, manifest: DataFrame, discovered: DataFrame, intake: str, offline: bool) -> DataFrame:
    """Program codes to refresh: the asked ones; offline the known ones of the intake; else the discovered."""
    if asked is not None:
        codes = asked.select(F.upper("program_code").alias("program_code"))
    elif offline:
        suffix = f"-{intake}"
        listed = manifest.where((F.col("intake") == intake) | F.col("id").endswith(suffix)).select("program_code")
        stored = committed.where(F.col("id").endswith(suffix)).select(F.expr(f"left(id, length(id) - {len(suffix)})").alias("program_code"))
        codes = listed.unionByName(stored)
    else:
        codes = discovered.select("program_code")
    return codes.distinct().orderBy("program_code")


def keep_last_good(scope: DataFrame, fresh: DataFrame, previous: DataFrame, failures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(entries, skipped(program_code, reason, kept))``: a failing program keeps its previous entry."""
    failed = scope.join(failures.select("program_code", "reason"), "program_code")
    good = fresh.join(scope, "program_code", "left_semi").join(failed.select("program_code"), "program_code", "left_anti")
    kept = previous.join(failed.select("program_code"), "program_code", "left_semi")
    had = kept.select("program_code").distinct().withColumn("_had", F.lit(True))
    skipped = failed.join(had, "program_code", "left").select("program_code", "reason", F.coalesce("_had", F.lit(False)).alias("kept"))
    return good.select(*previous.columns).unionByName(kept), skipped


def refresh_summary(manifest: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: programs, courses, relations, branches, skipped."""
    sums = ("courses", "relations", "branches")
    entries = manifest.select(F.lit(1).alias("programs"), *sums, F.lit(0).alias("skipped"))
    dropped = skipped.select(F.lit(0).alias("programs"), *[F.lit(0).alias(c) for c in sums], F.lit(1).alias("skipped"))
    rows = entries.unionByName(dropped)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("programs", *sums, "skipped")])


def referential_violations(sections, groups, courses, branches, relations, context, catalog) -> DataFrame:
    """``(rule, program, key)`` for every dangling reference and unknown kind."""
    ids = groups.select("program", F.col("id").alias("ref"))

    def dangling(rule: str, rows: DataFrame, key: Column, ref: Column, known: DataFrame) -> DataFrame:
        asked = rows.select("program", key.cast("string").alias("key"), ref.alias("ref")).where(F.col("ref").isNotNull())
        return asked.join(known, known.columns, "left_anti").select(F.lit(rule).alias("rule"), "program", "key")

    book = catalog.select(F.col("code").alias("ref"))
    sources = relations.select("program", "source").join(context.select("program", F.col("code").alias("source")), ["program", "source"], "left_anti")
    parts = [
        dangling("section root group", sections, F.col("id"), F.col("root_group"), ids),
        dangling("group parent", groups, F.col("id"), F.col("parent"), ids),
        dangling("course parent", courses, F.col("code"), F.col("parent"), ids),
        dangling("course section", courses, F.col("code"), F.col("section"), sections.select("program", F.col("id").alias("ref"))),
        dangling("branch parent", branches, F.col("id"), F.col("parent"), branches.select("program", F.col("id").alias("ref"))),
        groups.where(~F.col("kind").isin("and", "or")).select(F.lit("group kind").alias("rule"), "program", F.col("id").alias("key")),
        dangling("course in catalog", courses, F.col("code"), F.col("code"), book),
        dangling("relation target", relations, F.col("target"), F.col("target"), book),
        dangling("relation source", sources, F.col("source"), F.col("source"), book),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def relation_drift(stored: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows in one relation table but not in the other: ``side`` is stored or derived."""
    columns = ["program", "source", "target", "relation", "group", "raw"]
    a, b = stored.select(*columns), derived.select(*columns)
    return a.exceptAll(b).withColumn("side", F.lit("stored")).unionByName(b.exceptAll(a).withColumn("side", F.lit("derived")))
