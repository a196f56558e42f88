"""Data sets by name, configuration and split, from a folder that Spark reads.

A root holds ``name/configuration/split.parquet`` (or .jsonl, .json), several files ``split-*``, or a folder ``split``. Files are
found through Hadoop's file systems, so the root may be in any store, and read by Spark's own readers: columns that a plan
does not use are not read, and files and row groups are partitions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracepairs.functions.frames import quoted
from tracepairs.operators.sampling import with_line_ordinals

_FORMATS = {"parquet": "parquet", "jsonl": "json", "json": "json"}
_BOUND = r"(-?\d+%?)?"
_SPLIT = re.compile(rf"(\w+)(?:\[{_BOUND}:{_BOUND}\])?")


def _children(spark: SparkSession, path: str) -> dict[str, bool]:
    """Names in a folder, and whether each is a folder; none if it is not there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return {}
    return {s.getPath().getName(): s.isDirectory() for s in fs.listStatus(at)}


def _chosen(kind: str, names: list[str], wanted: str | None, where: str) -> str:
    if wanted is None and len(names) == 1:
        return names[0]
    if wanted is None and "default" in names:
        return "default"
    if wanted not in names:
        raise ValueError(f"no {kind} {wanted!r} in {where}; there are: {', '.join(sorted(names)) or 'none'}")
    return wanted


def splits(spark: SparkSession, root: str, name: str, config: str | None = None) -> dict[str, tuple[str, list[str]]]:
    """Format and paths of each split of a configuration (None: the only one, or ``default``)."""
    folder = f"{root.rstrip('/')}/{name}"
    found = _children(spark, folder)
    if not found:
        raise ValueError(f"no data set {name!r} in {root}")
    folder = f"{folder}/{_chosen('configuration', [c for c, is_dir in found.items() if is_dir], config, folder)}"
    out: dict[str, tuple[str, list[str]]] = {}
    for child, is_dir in sorted(_children(spark, folder).items()):
        inside = [f for f in _children(spark, f"{folder}/{child}") if not f.startswith(("_", "."))] if is_dir else [child]
        kinds = {_FORMATS.get(f.removesuffix(".gz").rpartition(".")[2]) for f in inside}
        if not inside or kinds == {None} or child.startswith(("_", ".")):
            continue
        split = re.match(r"\w+", child)[0]
        formats = kinds | ({out[split][0]} if split in out else set())
        if len(formats) != 1:
            raise ValueError(f"split {split!r} in {folder} has files of several formats")
        out[split] = (formats.pop(), [*out.get(split, ("", []))[1], f"{folder}/{child}"])
    return out


def _place(bound: str | None, n: int, default: int) -> int:
    """A row number from a bound of a slice: rows, or per cent of them, from the end if negative."""
    if bound is None:
        return default
    at = round(n * int(bound[:-1]) / 100) if bound.endswith("%") else int(bound)
    return min(max(at + n if at < 0 else at, 0), n)


def load_dataset(spark: SparkSession, root: str, name: str, config: str | None = None, split: str = "train", schema: str | None = None) -> DataFrame:
    """The rows of a split with ``ord``, their ordinals from 0 in the order of files and rows.

    ``split`` may be sliced by rows or per cent (``train[:100]``, ``test[10%:20%]``, ``train[-5:]``), and splits joined by ``+``,
    the rows of the second one after those of the first. ``schema`` names the columns wanted: others are not read, and one that
    Parquet files lack raises, as do a data set, configuration or split that is not there.
    """
    there, parts, before = splits(spark, root, name, config), [], 0
    for part in split.split("+"):
        m = _SPLIT.fullmatch(part.strip())
        if not m:
            raise ValueError(f"split {part!r} is not a name with a slice")
        kind, paths = there[_chosen("split", list(there), m[1], f"{root}/{name}")]
        if kind == "json":
            rows = (spark.read.schema(schema) if schema else spark.read).option("mode", "FAILFAST").json(paths)
        else:
            rows = spark.read.parquet(*paths)
            wanted = StructType.fromDDL(schema) if schema else rows.schema
            missing = [f.name for f in wanted if f.name not in rows.columns]
            if missing:
                raise ValueError(f"split {m[1]!r} of {name} has no column {', '.join(missing)}")
            rows = rows.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in wanted], "_metadata")
        rows = with_line_ordinals(rows)
        rows = rows.drop("_metadata") if kind == "parquet" else rows
        if m[2] or m[3] or "+" in split:
            n = rows.count()
            lo, hi = _place(m[2], n, 0), _place(m[3], n, n)
            rows = rows.where(F.col("ord").between(lo, hi - 1)).withColumn("ord", F.col("ord") - lo + before)
            before += max(hi - lo, 0)
        parts.append(rows)
    out = parts[0]
    for rows in parts[1:]:
        out = out.unionByName(rows)
    return out
