"""The topology gate end to end, attribution by feature family, and stacked embedding feature sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.vectors import pair_blocks
from siftline.operators import nullmodels, ridge, topology
from siftline.operators.ranking import spearman
from siftline.tables import pin, union


def as_array(frame: DataFrame, key: str) -> DataFrame:
    """(key, x): all other columns, by name, as one array; NULL stays for the imputer."""
    names = sorted(c for c in frame.columns if c != key)
    return frame.select(key, F.array(*[F.col(c).cast("double") for c in names]).alias("x"))


def scrambles(residues: DataFrame, seeds: list[int]) -> DataFrame:
    """Residue identities deranged inside each structure and region, once for each seed (``replicate``); places stay."""
    names = residues.withColumn("both", F.struct("resname", "aa"))
    moved = nullmodels.derange_replicates(names, [topology.KEY, "region_bin"], topology.NODE, "both", seeds)
    return moved.withColumn("resname", F.col("scrambled.resname")).withColumn("aa", F.col("scrambled.aa")).select(*residues.columns, "replicate")


def scramble(residues: DataFrame, seed: int) -> DataFrame:
    return scrambles(residues, [seed]).drop("replicate")


def feature_blocks(residues: DataFrame, seeds: list[int]) -> DataFrame:
    """(feature_block, structure_id, x): surface composition, real topology and one scrambled topology for each seed.

    All scrambles are one table: a scrambled structure is a structure of its own, named by its seed behind a #.
    """
    surface = pin(topology.surface_residues(residues))
    parts = {"surface_composition": topology.surface_composition(surface), "real_topology": topology.topology_features(surface)}
    blocks = [as_array(f, topology.KEY).withColumn("feature_block", F.lit(n)) for n, f in parts.items()]
    if seeds:
        many = pin(scrambles(surface, seeds).withColumn(topology.KEY, F.concat_ws("#", topology.KEY, "replicate")).drop("replicate"))
        found = as_array(topology.topology_features(many), topology.KEY)
        seed = F.substring_index(topology.KEY, "#", -1)
        blocks.append(found.select(F.regexp_replace(topology.KEY, "#[^#]*$", "").alias(topology.KEY), "x", F.concat(F.lit("scrambled_topology_"), seed).alias("feature_block")))
    return pin(union(blocks))


def block_metrics(blocks: DataFrame, labels: DataFrame, fold: str, shuffles: list[int]) -> DataFrame:
    """(assay, feature_block, n, spearman) of out-of-fold ridge predictions, and of the real topology on shuffled labels.

    labels: structure_id, ``fold``, assay, y.
    """
    jobs = [blocks.join(labels, topology.KEY)]
    if shuffles:
        real = blocks.filter("feature_block = 'real_topology'").drop("feature_block")
        moved = nullmodels.shuffle_replicates(labels.filter("y is not null"), ["assay"], topology.KEY, "y", shuffles).drop("y").withColumnRenamed("shuffled", "y")
        jobs.append(real.join(moved, topology.KEY).withColumn("feature_block", F.concat(F.lit("label_shuffle_"), F.col("replicate"))).drop("replicate"))
    found = ridge.fold_predictions(union(jobs), ["assay", "feature_block"], topology.KEY, "x", "y", fold)
    return spearman(found, ["assay", "feature_block"], "y_true", "y_pred")


def topology_gate(residues: DataFrame, labels: DataFrame, fold: str, seeds: list[int], shuffles: list[int]) -> tuple[DataFrame, DataFrame]:
    """Metrics and verdicts of the whole gate."""
    metrics = pin(block_metrics(feature_blocks(residues, seeds), labels, fold, shuffles))
    return metrics, nullmodels.gate_verdict(metrics)


def synthetic_labels(blocks: DataFrame, seed: int) -> DataFrame:
    """(structure_id, assay, y) of three calibration assays: the sum of composition z-scores, the sum of what real topology
    has beyond the mean scramble, and a permutation of the first."""
    long = blocks.select("feature_block", topology.KEY, F.posexplode("x").alias("i", "v"))
    z = nullmodels.zscores(long.filter("v is not null"), ["feature_block", "i"], ["v"])
    sums = z.groupBy(topology.KEY).agg(
        F.sum(F.when(F.col("feature_block") == "surface_composition", F.col("v"))).alias("composition"),
        F.sum(F.when(F.col("feature_block") == "real_topology", F.col("v"))).alias("real"),
        F.sum(F.when(F.col("feature_block").startswith("scrambled"), F.col("v"))).alias("scrambled"),
        F.count_distinct(F.when(F.col("feature_block").startswith("scrambled"), F.col("feature_block"))).alias("n"),
    )
    one = sums.select(topology.KEY, F.lit("positive_control_composition").alias("assay"), F.col("composition").alias("y"))
    two = sums.select(topology.KEY, F.lit("positive_control_topology").alias("assay"), (F.col("real") - F.try_divide("scrambled", "n")).alias("y"))
    three = nullmodels.shuffle_labels(one, ["assay"], topology.KEY, "y", seed).select(topology.KEY, F.lit("positive_control_shuffled").alias("assay"), F.col("shuffled").alias("y"))
    return union([one, two, three])


def real_scrambled_correlation(blocks: DataFrame) -> DataFrame:
    """For each scramble: mean and median over features of the rank correlation with the real topology."""
    long = blocks.select("feature_block", topology.KEY, F.posexplode("x").alias("i", "v"))
    real = long.filter("feature_block = 'real_topology'").select(topology.KEY, "i", F.col("v").alias("r"))
    met = long.filter(F.col("feature_block").startswith("scrambled")).join(real, [topology.KEY, "i"])
    rho = spearman(met, ["feature_block", "i"], "v", "r")
    return rho.groupBy("feature_block").agg(F.avg("spearman").alias("mean_correlation"), F.median("spearman").alias("median_correlation"))


def leave_one_family_out(frame: DataFrame, key: str, features: str, families: dict[str, list[int]], target: str, fold: str) -> DataFrame:
    """Spearman of all features, of all but one family's, and the drop: one job for each family, in one pass."""
    x = F.col(features).cast("array<double>")
    sets = [F.struct(F.lit("").alias("family_removed"), x.alias("x"))]
    for name, places in families.items():
        sets.append(F.struct(F.lit(name).alias("family_removed"), _without(x, places).alias("x")))
    jobs = frame.select(key, fold, target, F.explode(F.array(*sets)).alias("s")).select(key, fold, target, "s.*")
    rho = pin(spearman(ridge.fold_predictions(jobs, ["family_removed"], key, "x", target, fold), ["family_removed"], "y_true", "y_pred"))
    base = rho.filter("family_removed = ''").select(F.col("spearman").alias("baseline"))
    rest = rho.filter("family_removed <> ''").crossJoin(F.broadcast(base))  # one row
    return rest.select("family_removed", "n", "baseline", "spearman", (F.col("baseline") - F.col("spearman")).alias("spearman_drop"))


def _without(x, places: list[int]):
    return F.filter(x, lambda v, i: ~i.isin(*places))


def embedding_features(chains: DataFrame, key: str, model: str) -> DataFrame:
    """(key, x): the six blocks of heavy and light embeddings of one model, for keys that have both."""
    own = chains.filter(F.col("model_name") == model)
    a = own.filter("chain = 'VH'").select(key, F.col("embedding").alias("a"))
    b = own.filter("chain = 'VL'").select(key, F.col("embedding").alias("b"))
    return a.join(b, key).select(key, F.concat(*pair_blocks(F.col("a"), F.col("b")).values()).alias("x"))


def embedding_sets(chains: DataFrame, physical: DataFrame, key: str, names: list[str]) -> DataFrame:
    """(feature_set, key, x): physics, each model alone and with physics, and all models with physics."""
    physics = as_array(physical, key)
    each = {m: embedding_features(chains, key, m) for m in names}
    out = [physics.withColumn("feature_set", F.lit("physics"))]
    every = physics
    for m, f in each.items():
        out.append(f.withColumn("feature_set", F.lit(m)))
        joined = f.join(physics.withColumnRenamed("x", "p"), key).select(key, F.concat("x", "p").alias("x"))
        out.append(joined.withColumn("feature_set", F.lit(f"{m}_plus_physics")))
        every = every.join(f.withColumnRenamed("x", "e"), key).select(key, F.concat("x", "e").alias("x"))
    return union([*out, every.withColumn("feature_set", F.lit("all_plus_physics"))])


def kill_test(sequence: DataFrame, physical: DataFrame, clustered: DataFrame) -> DataFrame:
    """Three questions as rows from mean correlations: is similarity enough, does physics add, does it outlive clusters."""
    mean = lambda f, n: f.agg(F.avg("spearman").alias(n))
    one = mean(sequence, "seq").crossJoin(mean(physical, "phys")).crossJoin(mean(clustered, "clus"))  # one row each
    rows = F.array(
        F.struct(F.lit("sequence similarity alone").alias("test"), F.col("seq").alias("value"), F.when(F.col("seq") >= 0.4, "caution").otherwise("pass").alias("verdict")),
        F.struct(F.lit("physical features beat similarity").alias("test"), (F.col("phys") - F.col("seq")).alias("value"), F.when(F.col("phys") > F.col("seq"), "pass").otherwise("fail").alias("verdict")),
        F.struct(F.lit("signal outlives cluster folds").alias("test"), F.col("clus").alias("value"), F.when(F.col("clus") >= 0.2, "pass").otherwise("fail").alias("verdict")),
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")
