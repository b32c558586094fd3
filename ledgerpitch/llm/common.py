"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ledgerpitch.session import durable, max_broadcast_rows, shared_dir

BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of one Arrow batch; documents can hold 20,000 words, so Spark's 10,000 rows are too many.
BATCH_ROWS = 512

__all__ = ["arrow_map", "durable", "free_name", "mb_partitions", "rows_without", "sample_by_hash", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: Sequence[str], wanted: str) -> str:
    """``wanted``, with underscores in front until no existing column has that name."""
    lowered = {name.lower() for name in taken}
    while wanted.lower() in lowered:
        wanted = f"_{wanted}"
    return wanted


def arrow_map(
    df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str | StructType
) -> DataFrame:
    """mapInArrow over small batches; ``rows`` yields one dict of columns per output batch."""
    spark = df.sparkSession
    if int(spark.conf.get(BATCH_CONF)) > BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))
    arrow = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for columns in rows(batches):
            yield pa.RecordBatch.from_arrays(
                [_as_array(columns[field.name], field.type) for field in arrow], schema=arrow
            )

    return df.mapInArrow(run, schema)


def _as_array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def sample_by_hash(df: DataFrame, rows: int, text_col: str, by: str | None = None) -> DataFrame:
    """The ``rows`` rows of least hash of the text, one for each text, or one of every text if there
    are fewer; deterministic. With ``by`` so many for each value of that column, of which the driver
    gets the list.

    A bound on the hash leaves about four times as many texts before any row moves, so what is
    sorted does not grow with the table or with copies of a text. The bound comes from the number
    of distinct hashes, which is an estimate: it is widened until enough texts are below it.
    """
    spark = df.sparkSession
    key, group = free_name(df.columns, "text_hash"), free_name(df.columns, "sample_group")
    hashed = df.withColumns({key: F.xxhash64(text_col), group: F.col(by).cast("string") if by else F.lit("")})

    def below(of: DataFrame, bounds: dict[str, int]) -> DataFrame:
        limits = spark.createDataFrame([(g, min(b, (1 << 64) - 1) - (1 << 63)) for g, b in bounds.items()], f"{group} string, _bound long")
        return of.join(F.broadcast(limits), group).filter(F.col(key) <= F.col("_bound")).drop("_bound")

    totals = hashed.groupBy(group).agg(F.approx_count_distinct(key).alias("n")).filter(F.col(group).isNotNull()).collect()
    bounds = {r[group]: (1 << 64) * 4 * rows // max(1, r["n"]) for r in totals}
    while True:
        near = durable(below(hashed, bounds).dropDuplicates([group, key]))
        found = {r[group]: r["count"] for r in near.groupBy(group).count().collect()}
        few = [g for g, b in bounds.items() if b < 1 << 64 and found.get(g, 0) < rows]
        if not few:
            break
        bounds |= {g: bounds[g] * 4 for g in few}
    place = F.row_number().over(Window.partitionBy(group).orderBy(key))
    last = near.select(group, key).withColumn("_place", place).filter(F.col("_place") <= rows)
    cuts = {r[group]: r["cut"] + (1 << 63) for r in last.groupBy(group).agg(F.max(key).alias("cut")).collect()}
    return below(near, cuts).select(*df.columns)


def rows_without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is not in ``gone``; rows with a null key stay.

    The keys are written and counted. Up to the session's limit they are broadcast, so wide rows do
    not move; more keys are joined.
    """
    gone = durable(gone)
    n = gone.count()
    if not n:
        return df
    if n <= max_broadcast_rows(df.sparkSession):
        gone = F.broadcast(gone)
    return df.join(gone, key, "left_anti").select(*df.columns)


def mb_partitions(spark: SparkSession, total_bytes: int, mb: int = 64) -> int:
    """Partitions of about ``mb`` megabytes, and at least the shuffle partitions of the session."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes // (mb << 20)))
