"""Every operator as a query on the star-schema tables, by name. The SQL of each is in ``oracles``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from siftline.functions import conditions as C
from siftline.functions import sequences as S
from siftline.functions import vectors as V
from siftline.operators import compare, folds, graph, models, nullmodels, pairs, prepare, profile, ridge, similar, simulation, stats, topology
from siftline.operators.order import quantiles
from siftline.operators.ranking import average_rank, spearman
from siftline.plans import gate
from siftline.plans.audit import audit_on_embeddings
from siftline.sources import files
from siftline.tables import load, pin, round6, shared_folder, union

SEED = 7


def _rounded(frame: DataFrame) -> DataFrame:
    """Doubles to six digits, counts to bigint: what both engines agree on."""
    kinds = {"double": round6, "float": round6, "int": lambda c: c.cast("long")}
    return frame.select(*[kinds[t](F.col(f"`{c}`")).alias(c) if t in kinds else F.col(f"`{c}`") for c, t in frame.dtypes])


def order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the sums of their lines: the evaluation table (truth, prediction, group, fold)."""
    lines = load(spark, sf, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"), F.round(F.sum("l_extendedprice"), 2).alias("price"))
    orders = load(spark, sf, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    met = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return met.select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderpriority").alias("grp"), "o_orderstatus", (F.col("o_orderkey") % 5).cast("int").alias("fold"), F.col("o_totalprice").alias("t"), F.col("price").alias("p"), "qty")


def documents_features(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents", "doc_id", "text", "lang", "source").withColumn("u", S.ascii_upper(F.col("text")))
    return docs.select("doc_id", "lang", "source", *[v.alias(k) for k, v in S.composition(F.col("u"), "t").items()])


def triage_flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents: does the aromatic share tell the hydrophobic one, by language, and does the worst tail hold."""
    labelled = load(spark, sf, "labels", "doc_id")
    rows = documents_features(spark, sf).select("doc_id", "lang", "t_hydrophobic_fraction", "t_aromatic_fraction").join(labelled, "doc_id")
    metrics = stats.competitive_metrics(rows, ["lang"], "t_hydrophobic_fraction", "t_aromatic_fraction", "doc_id")
    verdict = compare.triage_verdict(round6(F.col("worst_auroc")), round6(F.col("spearman")))
    return _rounded(metrics.withColumn("verdict", verdict))


def missingness(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents", "doc_id", "lang", "source", "n_chars")
    return _rounded(stats.missingness(docs.join(load(spark, sf, "labels"), "doc_id", "left")))


def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    events = load(spark, sf, "events", "user_id").select((F.col("user_id") % 5).alias("user_fold"))
    orders = load(spark, sf, "orders", "o_orderkey").select((F.col("o_orderkey") % 3).alias("order_fold"))
    return union([stats.fold_summary(events, ["user_fold", "absent"]), stats.fold_summary(orders, ["order_fold"])])


def corr_network(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "lineitem", "l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return _rounded(pairs.correlation_network(rows, "l_orderkey", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 0.003))


def composition_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(documents_features(spark, sf).drop("source"))


def region_features(spark: SparkSession, sf: str) -> DataFrame:
    text = S.ascii_upper(F.col("text"))
    docs = load(spark, sf, "documents", "doc_id", "text").select("doc_id", text.alias("vh_protein_sequence"), F.reverse(text).alias("vl_protein_sequence"), text.alias("heavy_aligned_aho"), F.reverse(text).alias("light_aligned_aho"))
    found = S.physical_features(docs, ("doc_id",))
    return _rounded(found.select("doc_id", "cdr_h3_length", "fv_net_charge", "vh_vl_charge_imbalance", "cdr_charge_fraction_of_fv", "heavy_cdr_positive_count", "light_cdr_hydrophobic_fraction", "fv_cdr_aromatic_fraction", "fv_cdr_length"))


def pairwise_identity(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(pairs.pairwise_identity(load(spark, sf, "benchmark"), "item_id", "text"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "embeddings")
    return rows.withColumn("y", F.get("embedding", F.lit(0)).cast("double"))


def knn_loo(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(pairs.knn_predictions(_vectors(spark, sf), "vec_id", "embedding", "y", 8).withColumnRenamed("q", "vec_id"))


def knn_grouped(spark: SparkSession, sf: str) -> DataFrame:
    found = pairs.knn_predictions(_vectors(spark, sf), "vec_id", "embedding", "y", 8, "label")
    return _rounded(found.withColumnRenamed("q", "vec_id"))


def knn_external(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf)
    train, test = rows.filter("vec_id % 4 <> 0"), rows.filter("vec_id % 4 = 0")
    found = union([pairs.external_knn(train, test, "vec_id", "embedding", "y", k).withColumn("k", F.lit(k)) for k in (5, 8, 10)])
    return _rounded(spearman(found, ["k"], "y_true", "y_pred"))


DIRECTIONS = {"t": "high", "p": "high", "qty": "low"}


def failure_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.failure_labels(order_lines(spark, sf).select("id", "t", "p", "qty"), DIRECTIONS)[1])


def jaccard_labels(spark: SparkSession, sf: str) -> DataFrame:
    labels, _ = stats.failure_labels(order_lines(spark, sf).select("id", "t", "p", "qty"), DIRECTIONS)
    return _rounded(stats.jaccard_pairs(labels, list(DIRECTIONS)))


def metric_row(spark: SparkSession, sf: str) -> DataFrame:
    rows = order_lines(spark, sf)
    return _rounded(stats.error_metrics(rows, ["grp"], "t", "p").join(spearman(rows, ["grp"], "t", "p").drop("n"), "grp"))


def competitive_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.competitive_metrics(order_lines(spark, sf), ["grp"], "t", "p", "id"))


def top10_recall(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.official_metrics(order_lines(spark, sf), ["grp"], "t", "p", "id"))


def cv_fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.fold_totals(order_lines(spark, sf), ["grp"], "fold", "t", "p", "id"))


def _model_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Two models' correlation for five assays (order priorities stand for assays)."""
    names = dict(zip(("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), compare.TARGETS, strict=True))
    lookup = F.create_map(*[F.lit(v) for pair in names.items() for v in pair])
    rows = order_lines(spark, sf)
    scores = union([spearman(rows, ["grp"], "t", c).withColumn("model", F.lit(m)) for m, c in (("by_price", "p"), ("by_quantity", "qty"))])
    return scores.select(lookup[F.col("grp")].alias("assay"), "model", "n", F.round("spearman", 6).alias("spearman"))


def select_best(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.best_per(_model_scores(spark, sf), ["assay"], "spearman", "model"))


def compare_targets(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(compare.compare_to_targets(_model_scores(spark, sf), compare.target_table(spark)))


def external_status(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(compare.compare_external(_model_scores(spark, sf), compare.target_table(spark)))


def external_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Internal rows (fold over 0) against external ones (fold 0): deltas and verdict."""
    rows = order_lines(spark, sf)
    names = {"spearman": "{}_spearman", "worst_auroc": "{}_auroc", "n": "{}_n"}

    def side(name: str, part: DataFrame) -> DataFrame:
        m = _rounded(stats.competitive_metrics(part, ["grp"], "t", "p", "id"))
        return m.select("grp", *[F.col(c).alias(n.format(name)) for c, n in names.items()])

    met = side("internal", rows.filter("fold > 0")).join(side("external", rows.filter("fold = 0")), "grp", "left")
    delta = met.withColumn("delta_spearman", F.col("external_spearman") - F.col("internal_spearman")).withColumn("delta_auroc", F.col("external_auroc") - F.col("internal_auroc"))
    return _rounded(delta.withColumn("verdict", compare.triage_verdict(F.col("external_auroc"), F.col("external_spearman"))))


def key_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' segment and nation map to the first customer of that key: dedupe, then many to one, unmatched raise."""
    people = load(spark, sf, "customer", "c_custkey", "c_mktsegment", "c_nationkey")
    on = ["c_mktsegment", "c_nationkey"]
    external = compare.keep_first(people, on, "c_custkey").select(*on, F.concat(F.lit("EXT-"), F.col("c_custkey").cast("string")).alias("external_id"))
    named = people.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("name"), *on)
    return compare.map_keys(named, external, on, "name", "external_id").select("legacy_name", F.col("name").alias("external_id"))


def join_validation(spark: SparkSession, sf: str) -> DataFrame:
    """What two checked joins met, beside the sums they were made for: lines to their order, orders to their lines' sum."""
    orders = load(spark, sf, "orders", "o_orderkey", "o_totalprice").withColumnRenamed("o_orderkey", "k")
    lines = load(spark, sf, "lineitem", "l_orderkey", "l_quantity").withColumnRenamed("l_orderkey", "k")
    # A third of the orders is missing on the right side, so some lines stay unmatched.
    many, one = Observation("many"), Observation("one")
    first = pin(compare.validated_left_join(lines, orders.filter("k % 3 <> 0"), ["k"], "many_to_one", many)).agg(F.sum("o_totalprice").alias("total"))
    sums = lines.groupBy("k").agg(F.sum("l_quantity").alias("qty"))
    second = pin(compare.validated_left_join(orders, sums.filter("k % 5 <> 0"), ["k"], "one_to_one", one)).agg(F.sum("qty").alias("total"))
    told = [f.withColumns({"cardinality": F.lit(n), **{c: F.lit(o.get[c]) for c in ("rows", "unmatched", "doubled")}}) for f, n, o in ((first, "many_to_one", many), (second, "one_to_one", one))]
    return _rounded(union(told))


def rank_among_baselines(spark: SparkSession, sf: str) -> DataFrame:
    """The first supplier of each nation among all of its nation by balance."""
    rows = load(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    first = rows.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("first"))
    return _rounded(stats.rank_of(rows.join(first, "s_nationkey"), ["s_nationkey"], "s_acctbal", F.col("s_suppkey") == F.col("first")))


def stacked_features(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' own numbers beside those of their orders, whichever they have, the balance turned round where low is risky."""
    people = load(spark, sf, "customer").filter("c_custkey % 4 <> 0").withColumnRenamed("c_custkey", "k")
    bought = load(spark, sf, "orders", "o_custkey", "o_totalprice", "o_orderstatus").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("most"), F.max("o_orderstatus").alias("state"))
    wide = compare.stacked({"own": people, "orders": bought}, "k")
    return _rounded(stats.risk_oriented(wide, "own_c_acctbal", "orders_most", F.col("own_c_nationkey") % 2 == 1))


def label_auroc(spark: SparkSession, sf: str) -> DataFrame:
    """How well hydrophobic and aromatic shares tell labelled documents' quality, by language."""
    labels = load(spark, sf, "labels", "doc_id", "quality").filter("doc_id is not null")
    features = documents_features(spark, sf).select("doc_id", "lang", "source", "t_hydrophobic_fraction", "t_aromatic_fraction")
    # Texts are read once: what the three aggregations need of them is some numbers a document.
    rows = pin(features.join(labels, "doc_id").withColumn("good", F.col("quality") == 1))
    one, two = (stats.auroc(rows, ["lang"], "good", f"t_{c}_fraction", c) for c in ("hydrophobic", "aromatic"))
    counts = rows.groupBy("lang").agg(F.count_distinct("source").alias("n_sources"), F.count_if("good").alias("n_good"))
    return _rounded(one.join(two, "lang").join(counts, "lang"))


def _own_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_folder(spark)}/round-trips/{what}-{uuid.uuid4().hex}"


def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as CSV in a folder for each state, read again by one pattern with the folder each row came from."""
    orders = load(spark, sf, "orders", "o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus").withColumn("remark", F.when(F.col("o_orderkey") % 2 == 0, F.lit('says "a, b"')))
    here = _own_folder(spark, "csv")
    for state in ("F", "O", "P"):
        files.write_csv(orders.filter(F.col("o_orderstatus") == state).drop("o_orderstatus"), f"{here}/state_{state}")
    found = files.read_tables(spark, f"{here}/*/*.csv", "o_orderkey long, o_totalprice double, o_orderpriority string, remark string")
    return _rounded(found.groupBy("source_dir", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"), F.count("remark").alias("remarks"), F.max("remark").alias("remark")))


def pdb_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Residues as fixed-width atom records, a file for each structure, read again as residues of two chains."""
    rows = _residues(spark, sf).withColumn("chain", F.when(F.col("residue_id") % 2 == 0, "H").otherwise("L"))
    number = F.col("residue_id").cast("string")
    place = [F.format_string("%8.3f", F.floor(c).cast("double")) for c in ("x", "y", "z")]
    line = F.concat(F.lit("ATOM  "), F.lpad(number, 5, " "), F.lit("  CA  "), F.col("resname"), F.lit(" "), F.col("chain"), F.lpad(number, 4, " "), F.lit("    "), *place)
    here = _own_folder(spark, "pdb")
    named = rows.filter("residue_id < 10000").select("structure_id", "residue_id", line.alias("value"))
    named.repartition("structure_id").sortWithinPartitions("structure_id", "residue_id").select("structure_id", "value").write.partitionBy("structure_id").text(here)
    found = files.read_pdb(spark, f"{here}/*/*.txt", F.element_at(F.split("_metadata.file_path", "/"), -2))
    return _rounded(found.groupBy("chain", "aa").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("sequence_index").alias("places")))


def fold_ols_calibration(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.fold_calibration(order_lines(spark, sf), "fold", "qty", "t"))


def ridge_1d_oof(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.ridge_line(order_lines(spark, sf), "fold", "qty", "p", 10.0))


def _model_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vectors(spark, sf).withColumn("fold", (F.col("vec_id") % 5).cast("int")).withColumn("x", F.slice("embedding", 2, 20))
    return rows.withColumn("y", F.get("x", F.lit(0)).cast("double") * 2 - F.get("x", F.lit(3)).cast("double") + F.col("y"))


def ridge_oof_multi(spark: SparkSession, sf: str) -> DataFrame:
    rows = _model_rows(spark, sf).withColumn("assay", F.lit("y"))
    found = ridge.fold_predictions(rows, ["assay"], "vec_id", "x", "y", "fold")
    return _rounded(stats.competitive_metrics(found, ["assay"], "y_true", "y_pred", "vec_id"))


def pca_ridge_oof(spark: SparkSession, sf: str) -> DataFrame:
    rows = _model_rows(spark, sf).withColumn("assay", F.lit("y"))
    found = ridge.fold_predictions(rows, ["assay"], "vec_id", "embedding", "y", "fold", pca=16)
    return _rounded(stats.competitive_metrics(found, ["assay"], "y_true", "y_pred", "vec_id"))


def _ml(name: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = models.ml_fold_predictions(_model_rows(spark, sf), "vec_id", "x", "y", "fold", name).withColumn("model", F.lit(name))
        return _rounded(stats.error_metrics(found, ["model"], "y_true", "y_pred"))

    return run


def pca_features(spark: SparkSession, sf: str) -> DataFrame:
    found = models.pca_columns(_vectors(spark, sf).select("vec_id", "embedding"), "embedding", 8)
    return found.select("vec_id", F.transform("pca", lambda x: F.round(F.abs(x), 6)).alias("pca"))


def ridge_gram(spark: SparkSession, sf: str) -> DataFrame:
    """Ridge over all lines from Gram sums: weights and intercept."""
    rows = load(spark, sf, "lineitem", "l_quantity", "l_discount", "l_tax", "l_extendedprice").withColumn("x", F.array("l_quantity", "l_discount", "l_tax"))
    w, b = models.ridge_from_sums(models.gram_sums(rows, "x", "l_extendedprice")["z"], 1.0)
    return _rounded(spark.createDataFrame([(n, float(v)) for n, v in zip(("l_quantity", "l_discount", "l_tax", "intercept"), [*w, b], strict=True)], "feature string, weight double"))


def axis_report(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as molecules: price, size and sold quantity as features of two axes; every other part has a network projection."""
    sold = load(spark, sf, "lineitem", "l_partkey", "l_quantity").groupBy("l_partkey").agg(F.sum("l_quantity").alias("sold"))
    parts = load(spark, sf, "part", "p_partkey", "p_size", "p_retailprice", "p_brand").join(sold, F.col("p_partkey") == F.col("l_partkey"), "left")
    rows = parts.select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", F.when(F.col("sold") < 900, F.col("sold")).alias("sold"), "p_brand")
    axes = {"Cost": profile.Axis({"p_retailprice": 0.6, "p_size": 0.4}, "cost", "medium"), "Demand": profile.Axis({"sold": 0.7, "p_size": 0.3}, "demand", assign_risk=False), "Stock": profile.Axis({"sold": 1.0, "absent": 1.0}, "stock")}
    network = rows.filter("p_partkey % 2 = 0").select("p_partkey", (F.col("p_size") / 50).alias("network_risk_score"), F.col("p_brand").alias("mapped_regime"), (F.col("p_retailprice") / 7e6).alias("mapped_mean_degree"))
    found = profile.axis_report(rows.drop("p_brand"), "p_partkey", network, axes)
    return _rounded(found.select("p_partkey", "axis", F.col("axis_pos").cast("long").alias("axis_pos"), "risk_score", "risk_label", "main_features", "suggested_assay", "confidence"))


PREFIXES = ("vh_", "vl_", "heavy_cdr_", "light_cdr_", "fv_cdr_", "cdr_", "fv_", "")
STEMS = ("net_charge", "hydrophobic_fraction", "positive_count", "length", "aromatic_fraction", "charge_imbalance", "hydrophobicity_asymmetry", "other", "lys_arg_asymmetry", "h3_length", "size_imbalance")


def feature_families(spark: SparkSession, sf: str) -> DataFrame:
    """Parts' names as feature names (a prefix by size, a stem by key): parts of each region and chemistry."""
    pick = lambda words, c: F.element_at(F.array(*map(F.lit, words)), (F.pmod(F.col(c), F.lit(len(words))) + 1).cast("int"))
    names = load(spark, sf, "part", "p_partkey", "p_size").select(F.concat(pick(PREFIXES, "p_size"), pick(STEMS, "p_partkey")).alias("feature"))
    found = names.select("feature", *[v.alias(k) for k, v in S.feature_family(F.col("feature")).items()])
    return found.groupBy("chain_region", "chemistry", "is_cdr", "is_framework_or_full_variable").agg(F.count("*").alias("n"), F.count_distinct("feature").alias("n_features"))


def grouped_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Importances of line measures summed by family; families that are not known stay as NULL."""
    scores = spearman(order_lines(spark, sf), ["grp"], "t", "p").select("grp", F.lit("vh_net_charge").alias("feature"), "spearman")
    more = spearman(order_lines(spark, sf), ["grp"], "t", "qty").select("grp", F.lit("unknown").alias("feature"), "spearman")
    families = spark.createDataFrame([("vh_net_charge",)], "feature string").select("feature", S.feature_family(F.col("feature"))["chemistry"].alias("chemistry"))
    met = scores.unionByName(more).join(F.broadcast(families), "feature", "left")
    return _rounded(met.groupBy("grp", "chemistry").agg(F.sum("spearman").alias("importance")))


def residualize(spark: SparkSession, sf: str) -> DataFrame:
    rows = models.residualise(order_lines(spark, sf).select("id", "grp", "o_orderstatus", "t"), "t", ["grp", "o_orderstatus"])
    r, t = F.col("t_residual"), F.col("t")
    return _rounded(rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.avg(r).alias("residual_mean"), F.stddev_pop(r).alias("residual_sd"), (1 - F.var_pop(r) / F.var_pop(t)).alias("r2")))


def residual_ridge(spark: SparkSession, sf: str) -> DataFrame:
    """What a ridge on priority, state and customer's nation leaves of totals: fit and deviation."""
    people = load(spark, sf, "customer", "c_custkey", "c_nationkey")
    rows = order_lines(spark, sf).join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
    return _rounded(ridge.residualise(rows, "t", ["grp", "o_orderstatus", "c_nationkey"])[1])


def group_fold_deal(spark: SparkSession, sf: str) -> DataFrame:
    """Users in five folds of about as many events."""
    users = folds.group_folds(load(spark, sf, "events", "user_id"), "user_id")
    return users.groupBy("user_id").agg(F.count("*").alias("n"), F.min("fold").cast("long").alias("fold"))


def fold_preprocess(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as features, every fold by what the others hold: filled and scaled numbers, places of levels."""
    people = load(spark, sf, "customer", "c_custkey", "c_nationkey")
    rows = order_lines(spark, sf).join(people, F.col("o_custkey") == F.col("c_custkey"), "left")
    rows = rows.select("id", "fold", "t", F.when(F.col("qty") < 180, F.col("qty")).alias("qty"), F.nullif("grp", F.lit("5-LOW")).alias("grp"), F.col("c_nationkey").alias("nation"))
    numeric, levels = ["t", "qty"], ["grp", "nation"]
    done = prepare.transform(rows, "fold", prepare.fit(rows, "fold", numeric, levels), numeric, levels)
    return _rounded(done.select("id", *[F.get("scaled", F.lit(i)).alias(c) for i, c in enumerate(numeric)], F.array_join("hot", "|", "none").alias("hot")))


def residual_nulls(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation of price and total against the same with labels shuffled inside the group, 100 seeds, and empirical p."""
    ranked = nullmodels.ranked_once(order_lines(spark, sf).select("id", "grp", "t", "p"), ["grp"], "id", "t", "p")
    observed = nullmodels.rank_correlations(ranked, ["grp"]).select("grp", F.round("spearman", 9).alias("spearman"))
    controls = nullmodels.null_correlations(ranked, ["grp"], "id", list(range(100))).select("grp", F.round("spearman", 9).alias("spearman"))
    return _rounded(stats.empirical_p(observed, controls, ["grp"], "spearman"))


def bootstrap_mean_ci(spark: SparkSession, sf: str) -> DataFrame:
    suppliers = load(spark, sf, "supplier", "s_suppkey", "s_acctbal").withColumn("x", F.sqrt(F.abs("s_acctbal")))
    return _rounded(nullmodels.bootstrap_means(suppliers, "s_suppkey", "x", 50, SEED))


def _customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as molecules: descriptors from their orders, of the size the bins expect."""
    bought = load(spark, sf, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("mean_price"))
    met = load(spark, sf, "customer", "c_custkey", "c_acctbal", "c_nationkey").join(bought, F.col("c_custkey") == F.col("o_custkey"))
    return met.select("c_custkey", F.round(F.col("c_acctbal") / 1000 - 4, 6).alias("net"), (F.col("c_nationkey") % 7 - 3).cast("double").alias("cdr"), (F.col("n") % 9).cast("double").alias("imbalance"), F.round(F.col("mean_price") / 600000, 6).alias("hydro"))


def _archetypes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _customers(spark, sf)
    bars = quantiles(rows, [], {"imbalance": [0.75], "hydro": [0.75]}).select(F.get("imbalance", F.lit(0)).alias("bi"), F.get("hydro", F.lit(0)).alias("bh"))
    met = rows.crossJoin(F.broadcast(bars))  # one row
    return met.select(*rows.columns, C.archetype(F.col("net"), F.col("cdr"), F.col("imbalance"), F.col("hydro"), F.col("bi"), F.col("bh")).alias("archetype"))


def archetypes(spark: SparkSession, sf: str) -> DataFrame:
    return _archetypes(spark, sf).groupBy("archetype").agg(F.count("*").alias("n"))


def medoids(spark: SparkSession, sf: str) -> DataFrame:
    """The member nearest (L1) to its archetype's median centre, ties to the least key."""
    rows = _archetypes(spark, sf)
    columns = ["net", "cdr", "imbalance", "hydro"]
    medians = quantiles(rows, ["archetype"], {c: [0.5] for c in columns}).select("archetype", *[F.get(c, F.lit(0)).alias(f"m_{c}") for c in columns])
    centres = medians.join(rows.groupBy("archetype").agg(F.count("*").alias("n")), "archetype")
    gap = F.round(sum((F.abs(F.col(c) - F.col(f"m_{c}")) for c in columns), F.lit(0.0)), 9)
    met = rows.join(centres, "archetype").withColumn("distance", gap)
    best = met.groupBy("archetype", "n").agg(F.min(F.struct("distance", "c_custkey")).alias("b"))
    return _rounded(best.select("archetype", "n", F.col("b.c_custkey").alias("c_custkey"), F.col("b.distance").alias("distance")))


def _regime_points(spark: SparkSession) -> DataFrame:
    """A grid of regime points with made-up observables, as columns of sequences."""
    grid = spark.range(60).select((F.col("id") % 5 * 0.8).alias("attraction_strength"), (F.floor(F.col("id") / 5) % 4 * 0.4).alias("repulsion_strength"), (F.floor(F.col("id") / 20) * 2 + 1).cast("double").alias("patch_valence"), F.col("id").alias("point"))
    o = F.col("attraction_strength") - 0.5 * F.col("repulsion_strength") + 0.1 * F.col("patch_valence")
    return grid.select("*", F.round(o / 5, 6).alias("largest_cluster_fraction"), F.round(o / 8, 6).alias("percolation_probability"), F.round(o + 1, 6).alias("mean_degree"), F.round(0.5 - o / 10, 6).alias("edge_turnover"))


def regime_projection(spark: SparkSession, sf: str) -> DataFrame:
    rows = _customers(spark, sf).select("c_custkey", C.clip(F.col("cdr") + 1, 0.0, 4.0).alias("attraction_strength"), C.clip(F.col("net") / 3.7, 0.0, 1.5).alias("repulsion_strength"), (F.col("imbalance") % 3 * 2 + 1).alias("patch_valence"))
    found = pairs.nearest_point(rows, _regime_points(spark), "c_custkey", {"attraction_strength": 1.0, "repulsion_strength": 1.0, "patch_valence": 0.5}, ["point"])
    m = {c: F.col(f"mapped_{c}") for c in ("largest_cluster_fraction", "percolation_probability", "mean_degree", "edge_turnover")}
    risk = m["largest_cluster_fraction"] + m["percolation_probability"] + 0.25 * m["mean_degree"] - 0.25 * m["edge_turnover"]
    return _rounded(found.select("c_custkey", "mapped_point", "mapping_distance", risk.alias("network_risk_score")))


def _grid_scores(spark: SparkSession, sf: str, rows: DataFrame, by: list[str]) -> DataFrame:
    """Correlation of a target with each coefficient pair's linear score."""
    grid = spark.range(9).select(F.col("id").alias("g"), (F.col("id") % 3 * 0.5).alias("a"), (F.floor(F.col("id") / 3) * 0.5).alias("b"))
    met = rows.join(F.broadcast(grid)).withColumn("s", F.round(F.col("a") * F.col("net") + F.col("b") * F.col("cdr"), 6))  # nine rows
    return spearman(met, [*by, "g", "a", "b"], "s", "hydro").withColumn("spearman", F.round("spearman", 6))


def calibrate_grid(spark: SparkSession, sf: str) -> DataFrame:
    found = _grid_scores(spark, sf, _customers(spark, sf), []).withColumn("abs_spearman", F.abs("spearman"))
    return _rounded(found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("abs_spearman"), "g"))))


def leave_group_out(spark: SparkSession, sf: str) -> DataFrame:
    """For each group: the grid point best on all other groups, and its correlation on the group."""
    rows = _customers(spark, sf).withColumn("paper", F.col("c_custkey") % 4)
    papers = rows.select(F.col("paper").alias("held")).distinct()
    rest = rows.join(F.broadcast(papers), F.col("paper") != F.col("held"))  # four rows
    fitted = stats.best_per(_grid_scores(spark, sf, rest, ["held"]).withColumn("score", F.abs("spearman")), ["held"], "score", "g")
    own = _grid_scores(spark, sf, rows.withColumnRenamed("paper", "held"), ["held"]).select("held", "g", F.col("spearman").alias("heldout_spearman"), F.col("n").alias("heldout_n"))
    return _rounded(fitted.select("held", "g", F.col("spearman").alias("training_spearman")).join(own, ["held", "g"]))


def text_numbers(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "pages", "page_id", "url", "html")
    url = F.col("url")
    return rows.select("page_id", F.size(C.numeric_values(url)).cast("long").alias("n_numbers"), C.numeric_first(url, -1.0).alias("first_number"), C.numeric_max(url, -1.0).alias("max_number"))


def text_condition_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "events", "event_id", "event_type", "value", "props")
    salt = C.numeric_max(F.col("props"), 0.0)
    screening = C.ionic_strength_screening(salt)
    attraction, repulsion = C.solution_factors(F.col("value") / 10, salt)
    kind = F.lower("event_type")
    return _rounded(rows.select("event_id", salt.alias("salt"), screening.alias("screening"), C.flag((salt > 0) & (salt <= 50)).alias("low_salt"), C.flag(salt >= 90).alias("high_salt"), C.flag(kind.rlike("click|view")).alias("contact"), C.ph_charge_factor(F.col("value") / 10).alias("ph_factor"), attraction.alias("attraction_factor"), repulsion.alias("repulsion_factor")))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding")
    return load(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("sid"), *[F.round(F.get(e, F.lit(i)).cast("double") * 100, 4).alias(c) for i, c in enumerate("xyz")], (F.get(e, F.lit(3)) > 0).alias("is_cdr"), F.when(F.get(e, F.lit(4)) > 0.05, "pos").when(F.get(e, F.lit(4)) < -0.05, "neg").otherwise("neutral").alias("cls"))


XYZ = ("x", "y", "z")


def surface_mask(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(graph.surface_flags(_points(spark, sf), "sid", "vec_id", XYZ).select("vec_id", "sid", "n_near", "is_surface"))


def contact_graph(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(graph.contact_edges(_points(spark, sf), "sid", "vec_id", XYZ, 10.0))


def periodic_contacts(spark: SparkSession, sf: str) -> DataFrame:
    """Contacts in a repeating cube that is smaller than the cloud of points."""
    return _rounded(graph.periodic_edges(_points(spark, sf), "sid", "vec_id", XYZ, 9.0, 40.0))


def _charged(spark: SparkSession, sf: str) -> DataFrame:
    return _points(spark, sf).filter("cls = 'pos'")


def patch_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.contact_components(_charged(spark, sf), "sid", "vec_id", XYZ, 12.0)


def patch_summary(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _charged(spark, sf)
    labels = graph.contact_components(nodes, "sid", "vec_id", XYZ, 12.0).join(nodes.select("vec_id", "is_cdr"), "vec_id")
    return _rounded(graph.patch_summary(labels, "sid", "is_cdr"))


def spread_components(spark: SparkSession, sf: str) -> DataFrame:
    """One graph over all points, without structures: label spreading over cells of points that touch."""
    points = _points(spark, sf).withColumn("sid", F.lit(0).cast("long"))
    return graph.contact_components(points, "sid", "vec_id", XYZ, 6.0).select("vec_id", "component")


def adjacency_summary(spark: SparkSession, sf: str) -> DataFrame:
    points = _points(spark, sf)
    edges = graph.contact_edges(points, "sid", "vec_id", XYZ, 12.0)
    return _rounded(graph.adjacency_summary(points, edges, "sid", "vec_id", "cls", "pos", "neg"))


def centroid_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(graph.centroid_distance(_points(spark, sf), "sid", "cls", XYZ, "pos", "neg"))


def dipole(spark: SparkSession, sf: str) -> DataFrame:
    rows = _points(spark, sf).withColumn("q", F.when(F.col("cls") == "pos", 1.0).when(F.col("cls") == "neg", -1.0).otherwise(0.0))
    return _rounded(graph.dipole(rows, "sid", "q", XYZ))


def scramble_derange(spark: SparkSession, sf: str) -> DataFrame:
    return nullmodels.derange(_points(spark, sf), ["sid"], "vec_id", "cls", SEED).select("sid", "vec_id", "cls", "scrambled", "non_derangeable")


def label_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return nullmodels.shuffle_labels(_points(spark, sf).select("vec_id", "sid", "cls"), ["sid"], "vec_id", "cls", SEED)


def scramble_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    many = nullmodels.derange_replicates(_points(spark, sf), ["sid"], "vec_id", "cls", [1, 2, 3])
    return _rounded(nullmodels.scramble_diagnostics(many, ["sid", "replicate"], "cls"))


def _residues(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as residues: label is the structure, three components place them, two more name them."""
    e = F.col("embedding")
    names = F.array(*map(F.lit, ("LYS", "ASP", "HIS", "PHE", "ALA", "GLU", "ARG", "GLY")))
    letters = F.array(*map(F.lit, "KDHFAERG"))
    kind = F.pmod(F.floor(F.get(e, F.lit(5)).cast("double") * 1000).cast("int"), F.lit(8)) + 1
    points = load(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("ab"), F.col("label").cast("string")).alias("structure_id"), *[F.round(F.get(e, F.lit(i)).cast("double") * 100, 4).alias(c) for i, c in enumerate("xyz")], (F.get(e, F.lit(3)) > 0).alias("is_cdr"), kind.alias("k"))
    return points.select("structure_id", F.col("vec_id").alias("residue_id"), F.element_at(names, F.col("k")).alias("resname"), F.element_at(letters, F.col("k")).alias("aa"), "x", "y", "z", "is_cdr")


def surface_composition(spark: SparkSession, sf: str) -> DataFrame:
    found = topology.surface_composition(_residues(spark, sf))
    return _rounded(found.select("structure_id", "surface_residue_count", "surface_cdr_fraction", "surface_cdr_positive_count", "surface_framework_negative_fraction", "surface_all_aromatic_count", "surface_all_hydrophobic_fraction"))


def topology_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(topology.topology_features(_residues(spark, sf)))


def charge_topology(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(topology.charge_topology(_residues(spark, sf)))


def region_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Ungapped positions inside the heavy windows, spaces standing for gaps."""
    items = load(spark, sf, "benchmark").select("item_id", F.translate("text", " ", "-").alias("aligned"))
    found = topology.aligned_positions(items, "item_id", "aligned", S.HEAVY_REGIONS)
    return found.groupBy("item_id").agg(F.count("*").alias("n"), F.count_if("is_region").alias("n_region"), F.min(F.when(F.col("is_region"), F.col("position"))).alias("first_region"))


def literature_conditions(spark: SparkSession, sf: str) -> DataFrame:
    """Events as curated conditions, their texts made of type, value and user: features and regime coordinates."""
    n, v = F.col("event_id"), F.col("value")
    pick = lambda *words: F.element_at(F.array(*[F.lit(w).cast("string") for w in words]), (F.pmod(n, F.lit(len(words))) + 1).cast("int"))
    rows = load(spark, sf, "events", "event_id", "user_id", "event_type", "value").select(
        F.col("event_id").alias("anchor_id"), F.when(n % 7 > 0, F.format_string("pH %s", F.round(v / 10, 1))).alias("pH"), pick("histidine", "phosphate", None).alias("buffer"), pick("NaCl", None).alias("salt_type"),
        F.when(n % 5 > 0, F.concat(F.lit("~"), (F.col("user_id") % 200).cast("string"), F.lit(" mM"))).otherwise("none").alias("salt_mM"), pick("none", "arginine", "trehalose", None).alias("additive_type"),
        pick(None, "50 mM").alias("additive_concentration"), F.concat(F.round(v).cast("int").cast("string"), pick(" for viscosity; 10 for DLS", " mg/mL")).alias("protein_concentration_mg_ml"),
        pick("25", None, "nan", "37 C").alias("temperature_C"), pick("electrostatic patch", "hydrophobic", "fab-fab", None).alias("reported_mechanism"), F.col("event_type").alias("self_association_measure"),
    )
    features = rows.select("anchor_id", *[c.alias(k) for k, c in C.condition_features(True).items()])
    given = features.withColumns({c: F.lit(x) for c, x in zip(C.COEFFICIENTS, (1.0, 0.5, 0.75, 0.3, 0.6, 0.4, 1.0), strict=True)})
    return _rounded(given.select(*features.columns, *[c.alias(k) for k, c in C.literature_coordinates().items()]))


def _block_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Long gate metrics: each priority is an assay, blocks are correlations with real, 30 times scrambled and 30 times
    shuffled columns."""
    rows = order_lines(spark, sf).select("id", "grp", "t", "p", "qty")
    ranked, seeds = nullmodels.ranked_once(rows, ["grp"], "id", "p", "qty"), list(range(1, 31))
    parts = [
        nullmodels.rank_correlations(ranked, ["grp"]).withColumn("feature_block", F.lit("real_topology")),
        spearman(rows, ["grp"], "t", "p").withColumn("feature_block", F.lit("surface_composition")),
        nullmodels.null_correlations(ranked, ["grp"], "id", seeds, "cx", "derange").withColumn("feature_block", F.concat(F.lit("scrambled_topology_"), F.col("replicate"))),
        nullmodels.null_correlations(ranked, ["grp"], "id", seeds, "cy", "shuffle").withColumn("feature_block", F.concat(F.lit("label_shuffle_"), F.col("replicate"))),
    ]
    return union([f.select(F.col("grp").alias("assay"), "feature_block", "n", F.round("spearman", 9).alias("spearman")) for f in parts])


def gate_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(nullmodels.gate_verdict(_block_scores(spark, sf)))


def positive_controls(spark: SparkSession, sf: str) -> DataFrame:
    """The three controls on the gate's metrics, each priority standing for a synthetic assay of one of them."""
    kinds = {"1": "composition", "2": "topology", "3": "shuffled", "4": "composition", "5": "topology"}
    names = F.create_map(*[F.lit(v) for k, kind in kinds.items() for v in (k, f"positive_control_{kind}:")])
    return _rounded(nullmodels.positive_controls(_block_scores(spark, sf).withColumn("assay", F.concat(names[F.substring("assay", 1, 1)], F.col("assay")))))


def topology_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The gate on ten structures times folds: verdict rows. Small structures, so labels are repeated over row groups."""
    rows = _residues(spark, sf).withColumn("structure_id", F.concat("structure_id", F.lit("_"), F.pmod(F.col("residue_id"), F.lit(4)).cast("string")))
    labels = rows.groupBy("structure_id").agg(F.avg("x").alias("HIC"), F.avg(F.when(F.col("resname").isin("LYS", "ARG"), 1.0).otherwise(0.0)).alias("PR_CHO"))
    long = labels.select("structure_id", F.pmod(F.xxhash64("structure_id"), F.lit(5)).cast("int").alias("fold"), F.expr("stack(2, 'HIC', HIC, 'PR_CHO', PR_CHO)").alias("assay", "y"))
    return _rounded(gate.topology_gate(rows, long, "fold", list(range(1, 31)), list(range(1, 31)))[1])


def family_drops(spark: SparkSession, sf: str) -> DataFrame:
    families = {"first": list(range(5)), "second": list(range(5, 10)), "rest": list(range(10, 20))}
    return _rounded(gate.leave_one_family_out(_model_rows(spark, sf), "vec_id", "x", families, "y", "fold"))


def zscore_signal(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "supplier", "s_suppkey", "s_nationkey", "s_acctbal").withColumn("k", F.col("s_suppkey").cast("double"))
    z = nullmodels.zscores(rows, [], ["s_acctbal", "k"])
    return _rounded(z.select("s_suppkey", F.col("s_acctbal").alias("z_balance"), (F.col("s_acctbal") - F.col("k")).alias("excess")))


def vector_pair_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "embeddings", "vec_id", "embedding").withColumn("pair", F.floor(F.col("vec_id") / 2))
    a, b = rows.filter("vec_id % 2 = 0").select("pair", F.col("embedding").alias("a")), rows.filter("vec_id % 2 = 1").select("pair", F.col("embedding").alias("b"))
    blocks = a.join(b, "pair").select("pair", *[v.alias(k) for k, v in V.pair_blocks(F.col("a"), F.col("b")).items()])
    return _rounded(blocks.select("pair", *[F.aggregate(k, F.lit(0.0), lambda s, x: s + x).alias(k) for k in ("vh", "vl", "mean", "diff", "absdiff", "prod")]))


def mean_pool(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "embeddings").withColumn("mask", (F.col("vec_id") % 3 != 0).cast("int"))
    pooled = V.mean_pool(rows, ["label"], "embedding", "mask")
    return _rounded(pooled.select("label", F.posexplode("pooled").alias("i", "x")))


def _contacts(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events", "user_id", "event_type", "ts").select(F.datediff(F.col("ts"), F.lit("2024-01-01")).alias("day"), "user_id", "event_type")


def edge_turnover(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(graph.edge_turnover(_contacts(spark, sf), "day", ["user_id", "event_type"]))


def contact_lifetimes(spark: SparkSession, sf: str) -> DataFrame:
    runs = graph.contact_lifetimes(_contacts(spark, sf), "day", ["user_id", "event_type"])
    sums = runs.groupBy("event_type").agg(F.count("*").alias("n_runs"), F.avg("lifetime").alias("lifetime_mean"), F.max("lifetime").alias("lifetime_max"))
    tails = quantiles(runs, ["event_type"], {"lifetime": [0.9]}).select("event_type", F.get("lifetime", F.lit(0)).alias("lifetime_p90"))
    return _rounded(sums.join(tails, "event_type").select("event_type", "n_runs", "lifetime_mean", "lifetime_p90", "lifetime_max"))


def set_ops(spark: SparkSession, sf: str) -> DataFrame:
    people = load(spark, sf, "customer", "c_custkey").select(F.col("c_custkey").alias("k"))
    buyers = load(spark, sf, "orders", "o_custkey").select(F.col("o_custkey").alias("k"))
    sets = {"union_all": people.unionByName(buyers), "union": people.union(buyers).distinct(), "intersect": people.intersect(buyers), "except": people.subtract(buyers), "common": compare.common_keys([people, buyers], "k")}
    return union([f.agg(F.lit(n).alias("op"), F.count("*").alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("total")) for n, f in sets.items()])


def average_ranks(spark: SparkSession, sf: str) -> DataFrame:
    rows = load(spark, sf, "part", "p_partkey", "p_brand", "p_size")
    return average_rank(rows, ["p_brand"], "p_size", "rank").select("p_partkey", "p_brand", F.col("rank").cast("double").alias("rank"))


def region_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Class counts of each structure over all, CDR and framework rows at once: grouping sets."""
    rows = _points(spark, sf).withColumn("region", F.when(F.col("is_cdr"), "cdr").otherwise("framework"))
    found = rows.groupingSets([["sid", "region"], ["sid"]], "sid", "region").agg(F.count("*").alias("n"), F.count_if(F.col("cls") == "pos").alias("n_pos"), F.avg((F.col("cls") == "neg").cast("double")).alias("neg_fraction"))
    return _rounded(found.withColumn("region", F.coalesce("region", F.lit("all"))))


def particle_parameters(spark: SparkSession, sf: str) -> DataFrame:
    rows = _customers(spark, sf)
    found = C.particle_parameters(F.col("net") * 3.0917, F.col("cdr"), F.col("imbalance"), F.col("hydro") * 1.0137)
    return _rounded(rows.select("c_custkey", *[found[k].alias(k) for k in ("fab_charge_strength", "core_charge_strength", "same_charge_repulsion", "hydrophobic_attraction", "patch_valence")]))


def patchy_sim(spark: SparkSession, sf: str) -> DataFrame:
    first = compare.keep_first(_archetypes(spark, sf), ["archetype"], "c_custkey")
    p = C.particle_parameters(F.col("net"), F.col("cdr"), F.col("imbalance"), F.col("hydro"))
    runs = first.select(F.col("archetype").alias("run_id"), *[v.alias(k) for k, v in p.items()], F.lit(0.7).alias("contact_cutoff"))
    return _rounded(simulation.sweep(runs, 40, 20))


def regime_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """The regimes at the corners of the parameters that customers have."""
    p = C.particle_parameters(F.col("net"), F.col("cdr"), F.col("imbalance"), F.col("hydro"))
    rows = _customers(spark, sf).select(p["hydrophobic_attraction"].alias("a"), p["same_charge_repulsion"].alias("r"))
    corners = quantiles(rows, [], {"a": [0.1, 0.9], "r": [0.1, 0.9]}).first()
    grid = simulation.regime_grid(spark, corners.a, corners.r, [1, 3])
    return _rounded(grid.select("run_id", "attraction_strength", "repulsion_strength", F.col("patch_valence").alias("valence")).join(simulation.sweep(grid, 40, 20), "run_id"))


def identity_links(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of pages as aligned sequences: pairs of distinct ones that agree in 85 % of the positions both have."""
    return _rounded(similar.identity_links(similar.distinct_sequences(load(spark, sf, "pages", "page_id", "url"), "page_id", "url"), 0.85))


def hier_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items and page addresses in average-linkage clusters."""
    items = load(spark, sf, "benchmark").select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("key"), "text")
    pages = load(spark, sf, "pages").select(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("key"), F.col("url").alias("text"))
    return union([similar.sequence_clusters(items, "key", "text", 0.25), similar.sequence_clusters(pages, "key", "text", 0.85)])


def local_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(models.all_alignments(load(spark, sf, "benchmark"), "item_id", "text"))


def coefficient_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ridge.bootstrap_coefficients(_model_rows(spark, sf), "vec_id", "x", [f"x{i}" for i in range(20)], "y"))


def feature_importance(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(ridge.permutation_importance(_model_rows(spark, sf), "vec_id", "x", [f"x{i}" for i in range(20)], "y"))


def triage_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(audit_on_embeddings(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        triage_flagship, missingness, fold_summary, corr_network, composition_features, region_features, pairwise_identity, knn_loo, knn_grouped, knn_external,
        failure_matrix, jaccard_labels, metric_row, competitive_metrics, top10_recall, cv_fold_metrics, select_best, compare_targets, external_status, external_compare, key_mapping, join_validation, stacked_features, label_auroc, rank_among_baselines, csv_round_trip, pdb_round_trip,
        fold_ols_calibration, ridge_1d_oof, ridge_oof_multi, pca_ridge_oof, pca_features, ridge_gram, axis_report, feature_families, grouped_importance, residualize, residual_ridge, group_fold_deal, fold_preprocess,
        residual_nulls, bootstrap_mean_ci, archetypes, medoids, regime_projection, calibrate_grid, leave_group_out, text_numbers, text_condition_flags, surface_mask,
        contact_graph, periodic_contacts, patch_components, patch_summary, spread_components, adjacency_summary, centroid_distance, dipole, scramble_derange, label_shuffle,
        scramble_diagnostics, gate_verdict, positive_controls, zscore_signal, vector_pair_blocks, mean_pool, edge_turnover, contact_lifetimes, set_ops, average_ranks,
        surface_composition, topology_gate, family_drops, topology_features, charge_topology, region_positions, literature_conditions,
        region_totals, particle_parameters, patchy_sim, regime_sweep, identity_links, hier_clusters, local_alignment, coefficient_bootstrap, feature_importance, triage_audit,
    )
} | {"rf_oof": _ml("random_forest"), "gbt_oof": _ml("hist_gradient_boosting"), "elasticnet_oof": _ml("elastic_net")}
