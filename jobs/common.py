"""What the jobs share: their command line, their log, and the session only the command line creates."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger("siftline.jobs")


def config(path: str | Path) -> dict:
    """A job's settings, a small JSON file beside its module or one like it."""
    return json.loads(Path(path).read_text())


def read_back(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Output under its own schema: names of partitions stay text, nothing is guessed from them."""
    return spark.read.schema(schema).parquet(path)


def absent(error: AnalysisException) -> bool:
    """Whether a read failed because nothing has been written there yet."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def rows_held(spark: SparkSession, path: str, schema: T.StructType, by: str) -> dict[str, int]:
    """Rows of each value of a partition column; none where nothing has been written yet."""
    try:
        return {r[by]: r["count"] for r in read_back(spark, path, schema).groupBy(by).count().collect()}
    except AnalysisException as error:
        if absent(error):
            return {}
        raise


def partition_name(column: str) -> F.Column:
    """A partition's name: rows without one are 'unknown', as an empty name could not be told from none."""
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit("unknown"))


def main(run: Callable[..., dict], paths: dict[str, str], settings: Path, argv: list[str] | None = None) -> dict:
    """Parses ``--name path`` for each of ``paths`` and ``--config``, runs the job in a session of its own and stops that."""
    parser = argparse.ArgumentParser(description=run.__doc__)
    for name, what in paths.items():
        parser.add_argument(f"--{name}", required=True, help=what)
    parser.add_argument("--config", default=str(settings), help="JSON file with the job's settings")
    given = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    chosen = config(given.pop("config"))
    spark = SparkSession.builder.appName(run.__module__).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        return run(spark, **given, settings=chosen)
    finally:
        spark.stop()
