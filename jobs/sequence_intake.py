"""Sequence intake: features of sequences that arrive as new files, once each.

    python -m jobs.sequence_intake --source in/documents.parquet --out out/intake --checkpoint out/intake-checkpoint

A file stream with a checkpoint takes the files that no earlier run has taken (a folder of Parquet files that grows, or one
file), and ends when there are no more. Rows with an id and a sequence get the 55 sequence features and go to
``status=accepted``; rows without go to ``status=rejected`` with their reason. Below that, output is partitioned by
``partition``. Spark's file sink and checkpoint make a rerun, also one after a crash, add nothing twice.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import log, main, partition_name, read_back, rows_held
from siftline.functions.sequences import ascii_upper, clean_sequence, physical_features
from siftline.sources.files import normalise_sequences
from siftline.streaming.files import arriving, drain
from siftline.tables import require_columns

SETTINGS = Path(__file__).with_suffix(".json")
PARTITIONS = ["status", "part"]
KEPT = ("antibody_name", "aligned_source", "reason", "part")


def features(rows: DataFrame, settings: dict) -> DataFrame:
    """Every row with status, reason and, where it is accepted, its features. Letters count alike in either case; a sequence
    of gaps alone is none; repeated rows stay rows; other columns are not read."""
    require_columns(rows, settings["id"], settings["sequence"], settings["partition"])
    own = rows.select(
        F.col(settings["id"]).cast("string").alias("antibody_id"),
        ascii_upper(F.col(settings["sequence"])).alias("protein_sequence"),
        partition_name(settings["partition"]).alias("part"),
    )
    reason = F.when(F.col("antibody_id").isNull(), "no id").when(F.coalesce(F.length(clean_sequence(F.col("protein_sequence"))), F.lit(0)) == 0, "no sequence")
    marked = own.withColumn("reason", reason)
    laid = normalise_sequences(marked, "part", "reason")
    found = physical_features(laid, KEPT)
    measures = [c for c in found.columns if c not in KEPT]
    accepted = F.col("reason").isNull()
    return found.select(
        F.col("antibody_name").alias("id"), "aligned_source", "reason", *[F.when(accepted, F.col(c)).alias(c) for c in measures],
        F.when(accepted, "accepted").otherwise("rejected").alias("status"), "part",
    )


def run(spark: SparkSession, source: str, out: str, checkpoint: str, settings: dict) -> dict[str, int]:
    """Takes what is new in a growing folder of sequences and adds its features to the output."""
    done = features(arriving(spark, source, settings["files_per_batch"], settings["oldest_file"]), settings)
    before = rows_held(spark, out, done.schema, "status")
    drain(done, out, checkpoint, *PARTITIONS)
    held = rows_held(spark, out, done.schema, "status")
    new = {s: held.get(s, 0) - before.get(s, 0) for s in ("accepted", "rejected")}
    log.info("read %d new rows of %s", sum(new.values()), source)
    log.info("wrote %d accepted and %d rejected rows to %s, which holds %d and %d", new["accepted"], new["rejected"], out, held.get("accepted", 0), held.get("rejected", 0))
    return new


def output(spark: SparkSession, source: str, out: str, settings: dict) -> DataFrame:
    """All that the output holds."""
    return read_back(spark, out, features(spark.read.parquet(source), settings).schema)


if __name__ == "__main__":
    main(run, {"source": "growing folder of Parquet files", "out": "output folder", "checkpoint": "checkpoint folder"}, SETTINGS)
