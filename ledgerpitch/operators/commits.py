"""One commit over several tables.

Rows are written first, as files that no reader knows. A commit is one small file that names the
files of every table; it appears under the next number by a single rename. Readers take the newest
commit, so they see all changes of it or none, and a writer that worked on an older one fails.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerpitch.operators.upsert import hashed_keys, replace_children


@dataclass(frozen=True)
class Table:
    """A table's schema and files."""

    schema: str
    files: tuple[str, ...]


@dataclass(frozen=True)
class Snapshot:
    """The tables of a commit; version 0 has none."""

    version: int
    tables: Mapping[str, Table]


class Conflict(RuntimeError):
    """Another writer committed first."""


def _path(spark: SparkSession, path: str):
    """Hadoop's file system and path, as Spark's own readers use them."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The newest commit, or that of a number."""
    system, folder = _path(spark, f"{root}/commits")
    if not system.exists(folder):
        return Snapshot(0, {})
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    numbers = [int(name) for name in names if name.isdigit()]
    at = max(numbers, default=0) if version is None else version
    if not at:
        return Snapshot(0, {})
    lines = spark.read.text(f"{root}/commits/{at:020d}").collect()
    tables = (json.loads(r["value"]) for r in lines)
    return Snapshot(at, {t["table"]: Table(t["schema"], tuple(t["files"])) for t in tables})


def read(spark: SparkSession, table: Table) -> DataFrame:
    schema = StructType.fromJson(json.loads(table.schema))
    if not table.files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*table.files)


def stage(root: str, name: str, rows: DataFrame) -> Table:
    """Write the rows as files that belong to no commit yet."""
    spark = rows.sparkSession
    folder = f"{root}/data/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return Table(rows.schema.json(), tuple(sorted(spark.read.schema(rows.schema).parquet(folder).inputFiles())))


def stage_children(root: str, name: str, table: Table, new: DataFrame, parents: DataFrame, key: str) -> Table:
    """The table with the children of the given parents replaced. Only files that hold such a child
    are written anew; the others are carried over by name."""
    spark = new.sparkSession
    old = read(spark, table)
    touched: set[str] = set()
    if table.files:
        holding = old.select(key, F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
        touched = {r["file"] for r in holding.join(hashed_keys(parents, key), key, "left_semi").select("file").distinct().collect()}
    kept = tuple(f for f in table.files if f.rsplit("/", 1)[-1] not in touched)
    changed = read(spark, Table(table.schema, tuple(f for f in table.files if f not in kept)))
    added = stage(root, name, replace_children(changed, new.select(*changed.columns), parents, key))
    return Table(table.schema, kept + added.files)


def commit(spark: SparkSession, root: str, parent: Snapshot, changed: Mapping[str, Table]) -> Snapshot:
    """Make the staged tables the next version, or raise ``Conflict`` if ``parent`` is no longer the
    newest. Tables that are not named stay as they are."""
    following = Snapshot(parent.version + 1, {**parent.tables, **changed})
    text = "".join(
        json.dumps({"table": name, "schema": table.schema, "files": list(table.files)}) + "\n" for name, table in sorted(following.tables.items())
    )
    system, waiting = _path(spark, f"{root}/waiting/{uuid.uuid4().hex}")
    _, target = _path(spark, f"{root}/commits/{following.version:020d}")
    out = system.create(waiting, False)
    out.write(bytearray(text.encode()))
    out.close()
    system.mkdirs(target.getParent())
    if snapshot(spark, root).version != parent.version or system.exists(target) or not system.rename(waiting, target):
        raise Conflict(f"version {parent.version} is not the newest")
    return following
