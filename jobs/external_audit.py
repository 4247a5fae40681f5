"""External triage audit: choose a predictor for each assay on internal rows, freeze the choice, score it once outside.

    python -m jobs.external_audit --orders in/orders.parquet --lineitem in/lineitem.parquet --out out/audit

Every ``external_every``-th order is external. Internal rows alone choose each assay's predictor; the choice is written
to ``<out>/spec`` before an external value is read, and a later run that would choose otherwise is refused. Written
by assay, with dynamic partition overwrite: ``audit`` (internal and external scores, deltas, the share of shuffles of
the external truth that correlate as well, verdict, whether the score is of use) and ``worklist`` (external
rows in the worst tail by truth or by prediction). A rerun replaces the partitions it computes by equal ones.
"""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jobs.common import absent, log, main, partition_name, read_back
from siftline.operators import compare, nullmodels, stats
from siftline.plans import audit as audit_module
from siftline.sources.files import read_parquet, write_spec
from siftline.tables import pin, round6

SETTINGS = Path(__file__).with_suffix(".json")
SCORES = ("spearman", "worst_recall", "worst_auroc")
AUDIT = "model string, internal_n long, external_n long, " + ", ".join(f"{side}_{s} double" for side in ("internal", "external") for s in SCORES) + ", delta_spearman double, delta_auroc double, null_p double, verdict string, use string, assay string"
WORKLIST = "id long, model string, truth double, prediction double, tail string, assay string"


def evaluation_rows(orders: DataFrame, lines: DataFrame, settings: dict) -> DataFrame:
    """(assay, id, external, model, truth, prediction): each order once for each candidate, copied behind a checkpoint of the orders.
    Orders without lines have no prediction."""
    sums = lines.groupBy("l_orderkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("price"), F.sum("l_quantity").alias("quantity"))
    met = orders.join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    wide = met.select(partition_name(settings["assay"]).alias("assay"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % settings["external_every"] == 0).alias("external"), F.col(settings["truth"]).cast("double").alias("truth"), *sorted(set(settings["candidates"].values())))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("prediction")) for m, c in sorted(settings["candidates"].items())]))
    return pin(wide).select("assay", "id", "external", "truth", each.alias("e")).select("assay", "id", "external", "truth", "e.*")


def _ranked(rows: DataFrame, settings: dict) -> DataFrame:
    return stats.ranked_tails(rows, ["assay", "model"], "truth", "prediction", "id", settings["worst_fraction"], pinned=True)


def _scores(ranked: DataFrame, side: str) -> DataFrame:
    found = stats.triage_record(ranked, ["assay", "model"])
    return found.select("assay", "model", F.col("n").alias(f"{side}_n"), *[round6(F.col(s)).alias(f"{side}_{s}") for s in SCORES])


def frozen(spark: SparkSession, out: str, chosen: DataFrame) -> DataFrame:
    """Writes the choice to ``<out>/spec``, or holds it against the one that is there: one row for each assay."""
    path = f"{out}/spec"
    try:
        before = sorted(r[0] for r in spark.read.text(path).collect())
    except AnalysisException as error:
        if not absent(error):
            raise
        before = []
    now = sorted(json.dumps(r.asDict(), sort_keys=True) for r in chosen.select("assay", "model").collect())
    if before and [json.loads(x) for x in before] != [json.loads(x) for x in now]:
        raise ValueError(f"the choice frozen in {path} is another one: {before}")
    if not before:
        write_spec(chosen.select("assay", "model").orderBy("assay"), path)
    log.info("%s choice of %d assays in %s", "held to the frozen" if before else "froze the", len(now), path)
    return spark.createDataFrame([(json.loads(x)["assay"], json.loads(x)["model"]) for x in now], "assay string, model string")


def _null_p(outside: DataFrame, shuffles: int) -> DataFrame:
    """(assay, null_p): the correlation of ranked external rows against the same with the truth shuffled inside the assay."""
    ranked = nullmodels.centred(outside, ["assay"], "id")
    rounded = lambda f: f.select("assay", F.round("spearman", 9).alias("spearman"))
    controls = rounded(nullmodels.null_correlations(ranked, ["assay"], "id", list(range(shuffles))))
    found = stats.empirical_p(rounded(nullmodels.rank_correlations(ranked, ["assay"])), controls, ["assay"], "spearman")
    return found.select("assay", round6(F.col("empirical_p")).alias("null_p"))


def run(spark: SparkSession, orders: str, lineitem: str, out: str, settings: dict) -> dict:
    """Chooses on internal rows, freezes, scores on external rows, and writes the audit and the worklist by assay."""
    given = read_parquet(spark, orders).select("o_orderkey", settings["truth"], settings["assay"])
    lines = read_parquet(spark, lineitem).select("l_orderkey", "l_extendedprice", "l_quantity")
    log.info("read %d rows of %s and %d of %s", given.count(), orders, lines.count(), lineitem)
    rows = evaluation_rows(given, lines, settings)
    internal = pin(_scores(_ranked(rows.filter("not external"), settings), "internal"))
    spec = frozen(spark, out, stats.best_per(internal, ["assay"], "internal_spearman", "model"))
    outside = rows.filter("external").join(F.broadcast(spec), ["assay", "model"], "left_semi")  # a row for each assay
    outside = pin(_ranked(outside, settings))  # ranked once: for the scores, the shuffles and the worklist
    met = internal.join(F.broadcast(spec), ["assay", "model"], "left_semi").join(_scores(outside, "external"), ["assay", "model"], "left")
    met = met.join(_null_p(outside, settings["null_shuffles"]), "assay", "left")
    bar = settings["useful"]
    audit = audit_module.useful(met.withColumnsRenamed({"external_spearman": "spearman", "external_worst_auroc": "worst_auroc"}), bar["spearman"], bar["worst_auroc"])
    audit = audit.withColumnsRenamed({"spearman": "external_spearman", "worst_auroc": "external_worst_auroc"}).select(
        "*", F.when(F.col("useful"), "useful").otherwise("not useful").alias("use"), round6(F.col("external_spearman") - F.col("internal_spearman")).alias("delta_spearman"), round6(F.col("external_worst_auroc") - F.col("internal_worst_auroc")).alias("delta_auroc"),
        compare.triage_verdict(F.col("external_worst_auroc"), F.col("external_spearman")).alias("verdict"),
    )
    worklist = outside.withColumnsRenamed({"x": "truth", "y": "prediction"}).filter("bad or told")
    worklist = worklist.withColumn("tail", F.when(F.col("bad") & F.col("told"), "both").when(F.col("bad"), "truth").otherwise("prediction"))
    held = {}
    for name, frame, schema in (("audit", audit, AUDIT), ("worklist", worklist, WORKLIST)):
        columns = [c.split()[0] for c in schema.split(", ")]
        frame.select(*columns).hint("rebalance", "assay").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("assay").parquet(f"{out}/{name}")
        held[name] = output(spark, out, name).count()
        log.info("%s/%s holds %d rows", out, name, held[name])
    return held


def output(spark: SparkSession, out: str, name: str) -> DataFrame:
    return read_back(spark, f"{out}/{name}", StructType.fromDDL({"audit": AUDIT, "worklist": WORKLIST}[name]))


if __name__ == "__main__":
    main(run, {"orders": "orders table", "lineitem": "lines table", "out": "output folder"}, SETTINGS)
