"""Shared guards: NaN never passes a scan, required columns and unique keys are asserted, doubles are rounded for output."""

from __future__ import annotations

import re
import tempfile
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    frame = nan_to_null(spark.read.parquet(f"{sf_dir}/{name}.parquet"))
    return frame.select(*columns) if columns else frame


def nan_to_null(frame: DataFrame) -> DataFrame:
    """Missing values are NULL, never NaN: Spark orders NaN above everything and lets it poison means."""
    floats = {f.name for f in frame.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not floats:
        return frame
    return frame.select(*[F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in frame.columns])


def require_columns(frame: DataFrame, *names: str) -> DataFrame:
    missing = [n for n in names if n not in frame.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return frame


def require_unique(frame: DataFrame, *keys: str) -> DataFrame:
    """Asserts a key with one aggregation; the row that shows otherwise is named."""
    twice = frame.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"key is not unique: {twice[0].asDict()}")
    return frame


def round6(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def union(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by name, absent columns NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unpivot(frame: DataFrame, ids: list[str], values: list[str], name: str, value: str) -> DataFrame:
    """Long form; NULL values stay."""
    return frame.select(*ids, *[F.col(f"`{v}`").cast("double").alias(v) for v in values]).unpivot(ids, values, name, value)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a local master gets one of its own, as in
    tests; on a cluster none could be guessed, so that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/siftline-checkpoints"
    return folder.rstrip("/")


def pin(frame: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder: what follows may read the rows several times."""
    context = frame.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(frame.sparkSession))
    return frame.checkpoint()
