"""Session set-up and the two scale guards every operator shares.

* ``measured_broadcast`` writes a side once and broadcasts it behind a check of its exact rows and bytes; a side that is
  too big goes through an ordinary shuffle join (adaptive execution splits skewed partitions).
* ``materialised`` cuts lineage with a table in the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 64 * 1024 * 1024
MAX_CLASSES = 10_000


def build_session(app: str = "folioscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the adaptive settings the plans rely on; ``conf`` entries use ``__`` for a dot."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; a folder of the warehouse where none is named.

    Both are reached by every executor, so a table written there is whole.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_folioscope"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Later jobs start from the files, so they neither replay the lineage nor depend on executors staying alive, read
    only the columns they use, and are planned with real sizes.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row of ``df`` takes."""
    parts = [F.lit(8)]
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            part = F.octet_length(column)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            part = 8 * F.greatest(F.size(column), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            part = F.octet_length(F.to_json(F.struct(column)))
        else:
            part = F.lit(8)
        parts.append(F.coalesce(part, F.lit(0)))
    return reduce(lambda x, y: x + y, parts).cast("long")


def fits_broadcast(table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> bool:
    """Whether a written table stays within the bounds of rows and bytes. One aggregate, added up by the tasks."""
    rows, size = table.agg(F.count("*"), F.sum(row_bytes(table))).first()
    return rows <= max_rows and (size or 0) <= MAX_BROADCAST_BYTES


def measured_broadcast(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df``, written once as a table, and marked for broadcast if its exact rows and bytes are within the bounds.

    No row passes through the driver and nothing is computed twice. A larger table joins by shuffle.
    """
    table = materialised(df, "side")
    return F.broadcast(table) if fits_broadcast(table, max_rows) else table


def class_list(df: DataFrame, label_col: str) -> list[str]:
    """Sorted distinct labels. A classifier holds one row of weights per class, so the list is bounded by nature."""
    rows = df.select(label_col).where(F.col(label_col).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label_col} has more than {MAX_CLASSES} classes: this is not a class column")
    return sorted(r[0] for r in rows)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use every core on an input of fewer splits than cores; larger inputs are returned untouched.

    Such an input is at most a few dozen megabytes (a split is 4 MB or more), so the exchange is cheap.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() <= cores else df
