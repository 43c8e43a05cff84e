"""Schemas of what Arrow functions return."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql.types import StructField, StructType


def extended(fields: Iterable[StructField], ddl: str) -> StructType:
    """Carried columns, whatever their names and types, and the new columns of ``ddl``."""
    return StructType([*(StructField(f.name, f.dataType, True) for f in fields), *StructType.fromDDL(ddl).fields])
