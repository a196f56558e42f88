"""Columns and row types whatever their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, MapType, StructField, StructType


def quoted(name: str) -> Column:
    """The column of this name, whatever characters it has."""
    return F.col(f"`{name.replace('`', '``')}`")


def relaxed(kind: DataType) -> DataType:
    """The type with null allowed at every depth: Arrow functions give back no others."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, relaxed(f.dataType)) for f in kind])
    if isinstance(kind, ArrayType):
        return ArrayType(relaxed(kind.elementType))
    if isinstance(kind, MapType):
        return MapType(relaxed(kind.keyType), relaxed(kind.valueType))
    return kind


def carried(df: DataFrame, names: list[str]) -> Column:
    """Some columns of ``df`` as one struct, under names of its own, whatever theirs are; there may be none."""
    kinds = StructType([StructField("none", IntegerType()), *[StructField(f"c{i}", relaxed(df.schema[n].dataType)) for i, n in enumerate(names)]])
    return F.struct(F.lit(0), *map(quoted, names)).cast(kinds)


def carried_columns(names: list[str], row: str) -> list[Column]:
    """The columns that the struct column ``row`` of :func:`carried` holds, under their names."""
    return [F.col(row).getField(f"c{i}").alias(n) for i, n in enumerate(names)]


def with_row(rows: DataFrame, row: str, others: str) -> StructType:
    """A schema of the column ``row`` of ``rows`` and the columns of a DDL text."""
    return StructType([rows.schema[row], *StructType.fromDDL(others)])
