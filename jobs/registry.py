"""The jobs as queries, run twice into one new folder, and their results in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import external_audit, sequence_intake
from jobs.common import config
from siftline.plans import oracles as O
from siftline.tables import shared_folder, union


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_folder(spark)}/jobs/{job}-{uuid.uuid4().hex}"


def job1_sequence_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all documents' texts, taken by a file stream; the second run finds nothing new."""
    here, source, settings = _folder(spark, "sequence-intake"), f"{sf_dir}/documents.parquet", config(sequence_intake.SETTINGS)
    for _ in range(2):
        sequence_intake.run(spark, source, f"{here}/out", f"{here}/checkpoint", settings)
    done = sequence_intake.output(spark, source, f"{here}/out", settings)
    return done.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in done.dtypes])


def job2_external_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's and the worklist's rows of all orders; the second run is held to the first one's choice."""
    here, settings = _folder(spark, "external-audit"), config(external_audit.SETTINGS)
    for _ in range(2):
        external_audit.run(spark, f"{sf_dir}/orders.parquet", f"{sf_dir}/lineitem.parquet", here, settings)
    audit, worklist = (external_audit.output(spark, here, n).withColumn("kind", F.lit(n)) for n in ("audit", "worklist"))
    counts = {c: F.col(c).cast("double") for c in ("internal_n", "external_n")}
    return union([audit.withColumns(counts), worklist.withColumn("id", F.col("id").cast("string"))])


def _intake_sql() -> str:
    heavy = f"concat({', '.join(f'substring(u, {a + 1}, {b - a})' for a, b in ((25, 42), (56, 76), (105, 138)))})"
    parts = [O.composition(s, p) for p, s in (("vh", "u"), ("vl", "''"), ("heavy_cdr", heavy), ("light_cdr", "''"), ("fv_cdr", heavy))]
    h3 = O.clean("substring(u, 106, 33)")
    charge = lambda s: f"({O.count_of(O.clean(s), 'KRH')} - {O.count_of(O.clean(s), 'DE')})"
    share = f"{O.count_of(O.clean('u'), 'AILMFWYVC')} / greatest(length({O.clean('u')})::DOUBLE, 1::DOUBLE)"
    more = {
        "cdr_h3_length": f"length({h3})", "fv_net_charge": charge("u"), "vh_vl_charge_imbalance": f"abs({charge('u')})", "vh_vl_hydrophobicity_imbalance": f"abs({share})",
        "cdr_charge_fraction_of_fv": f"{charge(heavy)} / greatest(abs({charge('u')}), 1::DOUBLE)",
    }
    every = ", ".join([*parts, *[O.r6(v, k) for k, v in more.items()]])
    return f"""
WITH given AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS u, coalesce(nullif(lang, ''), 'unknown') AS part FROM documents
), told AS (
  SELECT *, CASE WHEN id IS NULL THEN 'no id' WHEN coalesce(length({O.clean('u')}), 0) = 0 THEN 'no sequence' END AS reason FROM given
)
SELECT id, 'raw' AS aligned_source, reason, 'accepted' AS status, part, {every} FROM told WHERE reason IS NULL
UNION ALL BY NAME SELECT id, 'raw' AS aligned_source, reason, 'rejected' AS status, part FROM told WHERE reason IS NOT NULL
"""


def _audit_sql() -> str:
    tails = """
SELECT k, id, t, p, row_number() OVER (PARTITION BY k ORDER BY t DESC, id) <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY k)) AS bad,
  row_number() OVER (PARTITION BY k ORDER BY p DESC, id) <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY k)) AS told
FROM (SELECT k, id, t::DOUBLE AS t, p::DOUBLE AS p FROM outside WHERE t IS NOT NULL AND p IS NOT NULL)"""
    scores = lambda side: ", ".join(f"{side}.{s} AS {'internal' if side == 'i' else 'external'}_{s}" for s in external_audit.SCORES)
    rounded = "k, n, " + ", ".join(O.r6(s, s) for s in external_audit.SCORES)
    return f"""
WITH {O.ORDER_LINES}, long AS (
  SELECT coalesce(nullif(grp, ''), 'unknown') || '|by_price' AS k, id, fold, t, p::DOUBLE AS p FROM ol
  UNION ALL SELECT coalesce(nullif(grp, ''), 'unknown') || '|by_quantity', id, fold, t, qty::DOUBLE FROM ol
), i AS (SELECT {rounded} FROM ({O.competitive('(SELECT * FROM long WHERE fold > 0)', 'k', 't', 'p', 'id')})
), best AS (
  SELECT k FROM (SELECT k, row_number() OVER (PARTITION BY regexp_replace(k, '[|][^|]*$', '') ORDER BY spearman DESC NULLS LAST, k) AS n FROM i) WHERE n = 1
), outside AS (SELECT * FROM long WHERE fold = 0 AND k IN (SELECT k FROM best)
), e AS (SELECT {rounded} FROM ({O.competitive('outside', 'k', 't', 'p', 'id')})
), pairs AS (SELECT k, id, t::DOUBLE AS t, p::DOUBLE AS p FROM outside WHERE t IS NOT NULL AND p IS NOT NULL
), drawn AS (SELECT k, r, p, row_number() OVER (PARTITION BY k, r ORDER BY md5(concat_ws('|', r::VARCHAR, id::VARCHAR)), id) AS i FROM pairs, range(100) q(r)
), plain AS (SELECT k AS pk, row_number() OVER (PARTITION BY k ORDER BY id) AS pi, t AS shuffled FROM pairs
), moved AS (SELECT k, r, p, shuffled FROM drawn JOIN plain ON pk = k AND pi = i
), nulls AS (SELECT k, round(spearman, 9) AS v FROM ({O.spearman('moved', 'k, r', 'shuffled', 'p')})
), seen AS (SELECT k, round(spearman, 9) AS o FROM ({O.spearman('pairs', 'k', 't', 'p')})
), chance AS (SELECT k, {O.r6('(1 + count(*) FILTER (v >= o)) / (count(v) + 1)::DOUBLE', 'null_p')} FROM nulls JOIN seen USING (k) GROUP BY k
), flags AS ({tails}
), audit AS (
  SELECT i.k AS k, i.n::DOUBLE AS internal_n, e.n::DOUBLE AS external_n, {scores('i')}, {scores('e')}, {O.r6('e.spearman - i.spearman', 'delta_spearman')}, {O.r6('e.worst_auroc - i.worst_auroc', 'delta_auroc')},
    null_p, {O.verdict('e.worst_auroc', 'e.spearman')} AS verdict, CASE WHEN e.spearman >= 0.3 AND e.worst_auroc >= 0.7 THEN 'useful' ELSE 'not useful' END AS use
  FROM i JOIN best USING (k) LEFT JOIN e USING (k) LEFT JOIN chance USING (k)
)
SELECT 'audit' AS kind, regexp_replace(k, '[|][^|]*$', '') AS assay, regexp_extract(k, '[^|]*$') AS model, * EXCLUDE (k) FROM audit
UNION ALL BY NAME
SELECT 'worklist' AS kind, regexp_replace(k, '[|][^|]*$', '') AS assay, regexp_extract(k, '[^|]*$') AS model, id::VARCHAR AS id, t AS truth, p AS prediction, CASE WHEN bad AND told THEN 'both' WHEN bad THEN 'truth' ELSE 'prediction' END AS tail FROM flags WHERE bad OR told
"""


QUERIES = {"job1_sequence_intake": job1_sequence_intake, "job2_external_audit": job2_external_audit}
ORACLES = {"job1_sequence_intake": _intake_sql(), "job2_external_audit": _audit_sql()}
