"""Ridge whose penalty has the least leave-one-out error, for job tables of any height.

Two passes over the rows, and no task holds a job's rows. The first sums the Gram matrices of every (job, fold) inside the
tasks; whoever leaves a fold out subtracts its sums, and one eigendecomposition a model serves all penalties. The second
streams rows past their job's models and sums the squared leave-one-out errors of all penalties at once, from
leverages. What moves between the passes is as wide as the features, never as long as the rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.operators.nullmodels import by_key, shuffle_replicates
from siftline.operators.order import met, quantiles
from siftline.operators.ranking import average_rank, spearman
from siftline.tables import pin

ALPHAS = tuple(np.logspace(-3, 3, 13))
#: Rows of a job that one task streams past its models in the second pass.
TASK_ROWS = 50_000


def as_matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array<double> column of one length; missing values are NaN."""
    return np.asarray(column.flatten().fill_null(np.nan)).astype(float).reshape(len(column), -1)


def _by_job(batch: pa.RecordBatch, *more: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """A batch parted by job and the other columns named."""
    keys = pd.MultiIndex.from_arrays([batch.column(c).to_pylist() for c in ("job", *more)])
    codes, found = pd.factorize(keys)
    for k, key in enumerate(found):
        yield key, batch.take(pa.array(np.flatnonzero(codes == k)))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of zz' for z = (1, x, y) of every job and cell of a task, flat."""
    total: dict[tuple, np.ndarray] = {}
    for batch in batches:
        for key, part in _by_job(batch, "cell", "own") if batch.num_rows else ():
            x = as_matrix(part.column("x"))
            z = np.column_stack([np.ones(len(x)), x, np.asarray(part.column("y"))])
            total[key] = total.get(key, 0) + z.T @ z
    for (job, cell, own), sums in total.items():
        n = sums.size
        yield pa.RecordBatch.from_arrays([pa.array([job] * n), pa.array([cell] * n), pa.array([own] * n), pa.array(np.arange(n)), pa.array(sums.ravel())], names=["job", "cell", "own", "i", "v"])


def solved(z: np.ndarray, pca: int | None, scaled: bool = True) -> dict[str, np.ndarray | float]:
    """A model before its penalty is known, from the sums of its rows: rows x turn into (x - mean) @ turn, whose squares are
    weighed by 1 / (values + penalty); ``pull`` is what the target adds along each. A feature counts as constant where it deviates by
    less than 1e-7 of its mean: sums tell no better. Unless ``scaled``, features keep their scale."""
    n, p = z[0, 0], len(z) - 2
    means = z[0, 1:] / n
    cov = z[1:, 1:] / n - np.outer(means, means)
    a, b, turn = cov[:p, :p], cov[:p, p], np.eye(p)
    if pca:
        k = int(max(0, min(n - 1, p, pca)))
        turn = np.linalg.eigh(a)[1][:, ::-1][:, :k]
        a, b = turn.T @ a @ turn, turn.T @ b
    scale = np.sqrt(np.maximum(np.diag(a), 0.0)) if scaled else np.zeros(len(a))
    scale = np.where(scale > 1e-7 * (scale.max(initial=0.0) if pca else np.abs(means[:p])), scale, 1.0)
    values, vectors = np.linalg.eigh(n * a / np.outer(scale, scale))
    return {"n": n, "mean": means[:p], "centre": means[p], "values": np.maximum(values, 0.0), "scale": scale, "turn": turn / scale @ vectors, "pull": vectors.T @ (n * b / scale)}


def errors(model: dict, x: np.ndarray, y: np.ndarray, alphas: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
    """Summed squared leave-one-out errors of training rows, each so many ``times``, for every penalty."""
    u = (x - model["mean"]) @ model["turn"]
    inverse = 1 / (model["values"][:, None] + alphas)
    leverage = 1 / model["n"] + (u * u) @ inverse
    fitted = u @ (inverse * model["pull"][:, None])
    squares = ((y[:, None] - model["centre"] - fitted) / np.maximum(1 - leverage, 1e-12)) ** 2
    return squares.sum(axis=0) if times is None else times @ squares


def _filled(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows with missing features once for each model of their job (``only``), filled with the medians of that model's rows;
    complete rows once for all (``only`` NULL)."""
    gone = F.exists("x", lambda v: v.isNull() | F.isnan(v))
    complete = rows.filter(~gone).withColumn("only", F.lit(None).cast("string"))
    short = rows.filter(gone)
    if not short.take(1):
        return complete
    lost = short.select("job", F.posexplode("x").alias("i", "v")).filter("v is null or isnan(v)").select("job", "i").distinct()
    values = met(rows.select("job", "cell", F.posexplode("x").alias("i", "v")).filter("v is not null and not isnan(v)"), lost, ["job", "i"])
    trained = met(values, wanted.select("job", F.col("cell").alias("f")), ["job"]).filter("not (cell <=> f)")
    medians = quantiles(trained, ["job", "f", "i"], {"v": [0.5]})
    maps = medians.groupBy("job", "f").agg(F.map_from_entries(F.collect_list(F.struct("i", F.get("v", F.lit(0)).alias("m")))).alias("medians"))
    each = met(short, wanted.select("job", F.col("cell").alias("only")), ["job"])
    told = each.join(maps.select(F.col("job").alias("__job"), F.col("f").alias("__f"), "medians"), F.col("job").eqNullSafe(F.col("__job")) & F.col("only").eqNullSafe(F.col("__f")), "left").drop("__job", "__f")
    fill = F.transform("x", lambda v, i: F.when(v.isNull() | F.isnan(v), F.coalesce(F.try_element_at("medians", i), F.lit(0.0))).otherwise(v))
    return complete.unionByName(told.withColumn("x", fill).drop("medians"))


def fit(rows: DataFrame, wanted: DataFrame, pca: int | None = None, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Models (job, cell, alpha, intercept, weights) of ``wanted`` (job, cell), each trained on the job's rows of other cells.

    rows: job, cell (strings), x array<double>, y, complete or filled (``only``). Weights are for raw features. Penalties
    apply to standardised features (after projection on ``pca`` components); ties go to the least.
    """
    some = F.when(F.col("only").isNull(), F.col("cell")).otherwise(F.col("only"))
    trains = rows.filter("only is null or not (only <=> cell)")
    cells = trains.select("job", some.alias("cell"), F.col("only").isNull().alias("own"), "x", "y")
    sums = cells.mapInArrow(_grams, "job string, cell string, own boolean, i long, v double").groupBy("job", "cell", "own", "i").agg(F.sum("v").alias("v"))
    asked = wanted.select("job", "cell", F.lit(None).cast("boolean").alias("own"), F.lit(-1).cast("long").alias("i"), F.lit(0.0).alias("v"))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        job, models = part["job"].iloc[0], []
        held = {k: g.sort_values("i")["v"].to_numpy() for k, g in part[part["i"] >= 0].groupby(["cell", "own"])}
        for cell in sorted(part.loc[part["i"] < 0, "cell"]):
            flat = [v for (c, own), v in held.items() if (own and c != cell) or (not own and c == cell)]
            if flat:
                side = int(round(len(flat[0]) ** 0.5))
                models.append((job, cell, pickle.dumps(solved(sum(flat).reshape(side, side), pca))))
        return pd.DataFrame(models, columns=["job", "cell", "model"])

    models = pin(sums.unionByName(asked).groupBy("job").applyInPandas(solve, "job string, cell string, model binary"))
    grid = np.array(sorted(alphas))
    chosen = models.withColumn("k", F.lit(0)) if len(grid) == 1 else _chosen(trains, models, grid)

    def final(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for job, cell, model, k in zip(frame["job"], frame["cell"], frame["model"], frame["k"], strict=True):
                m = pickle.loads(model)
                weights = m["turn"] @ (m["pull"] / (m["values"] + grid[k]))
                out.append((job, cell, float(grid[k]), float(m["centre"] - m["mean"] @ weights), weights.tolist()))
            yield pd.DataFrame(out, columns=["job", "cell", "alpha", "intercept", "weights"])

    return pin(chosen.select("job", "cell", "model", "k").mapInPandas(final, "job string, cell string, alpha double, intercept double, weights array<double>"))


def _chosen(trains: DataFrame, models: DataFrame, grid: np.ndarray) -> DataFrame:
    """``models`` with ``k``, the place of the penalty with the least leave-one-out error."""
    parts = trains.groupBy("job").agg(F.ceil(F.count("*") / F.lit(TASK_ROWS)).cast("int").alias("parts"))
    # Drawn from the pinned rows before anything moves, so a lost task draws the same again.
    salted = met(trains.withColumn("draw", F.rand(7)), parts, ["job"]).withColumn("part", F.floor(F.col("draw") * F.col("parts")).cast("int"))
    copies = met(models, parts, ["job"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    none = lambda kind: F.lit(None).cast(kind)
    stream = copies.select("job", "part", F.lit(0).alias("kind"), "cell", none("string").alias("only"), "model", none("array<double>").alias("x"), none("double").alias("y"))
    stream = stream.unionByName(salted.select("job", "part", F.lit(1).alias("kind"), "cell", "only", none("binary").alias("model"), "x", "y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, total = None, {}, {}
        for batch in batches:
            for (job, part, kind), rows in _by_job(batch, "part", "kind") if batch.num_rows else ():
                if (job, part) != at:
                    at, held = (job, part), {}
                if kind == 0:
                    held |= {c: pickle.loads(m) for c, m in zip(rows.column("cell").to_pylist(), rows.column("model").to_pylist(), strict=True)}
                    continue
                x, y = as_matrix(rows.column("x")), np.asarray(rows.column("y"))
                cells, only = (np.array(rows.column(c).to_pylist(), dtype=object) for c in ("cell", "only"))
                every = np.array([o is None for o in only])
                for cell, model in held.items():
                    mine = (every & (cells != cell)) | (~every & (only == cell))
                    if mine.any():
                        total[job, cell] = total.get((job, cell), 0) + errors(model, x[mine], y[mine], grid)
        for (job, cell), sums in total.items():
            n = len(sums)
            yield pa.RecordBatch.from_arrays([pa.array([job] * n), pa.array([cell] * n), pa.array(np.arange(n), pa.int32()), pa.array(sums)], names=["job", "cell", "k", "e"])

    dealt = stream.repartition("job", "part").sortWithinPartitions("job", "part", "kind")
    scores = dealt.mapInArrow(run, "job string, cell string, k int, e double").groupBy("job", "cell", "k").agg(F.sum("e").alias("e"))
    best = scores.groupBy("job", "cell").agg(F.min_by("k", F.struct("e", "k")).alias("k"))
    return met(models, best, ["job", "cell"])


def job_name(job: list[str]):
    return F.to_json(F.struct(*job)) if job else F.lit("")


def labelled(frame: DataFrame, job: list[str], key: str, features: str, target: str, fold: str) -> DataFrame:
    """The rows with a target and features, as ``fit`` and ``predict`` take them; ``row`` holds job and key."""
    rows = frame.filter(F.col(target).isNotNull() & F.col(features).isNotNull())
    return rows.select(F.struct(*job, key).alias("row"), job_name(job).alias("job"), F.col(fold).cast("string").alias("cell"), F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"))


def predict(rows: DataFrame, models: DataFrame) -> DataFrame:
    """(columns of ``row``, fold, y_true, y_pred) of filled rows by the model that leaves their cell out; NULL where there is none."""
    own = rows.filter("only is null or only <=> cell")
    told = met(own, models, ["job", "cell"], "left")
    dot = F.aggregate(F.zip_with("x", "weights", lambda a, b: a * b), F.col("intercept"), lambda s, v: s + v)
    return told.select("row.*", F.col("cell").alias("fold"), F.col("y").alias("y_true"), dot.alias("y_pred"))


def fold_predictions(frame: DataFrame, job: list[str], key: str, features: str, target: str, fold: str, least: int = 20, pca: int | None = None, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """Out-of-fold predictions of every job: (job, key, fold, y_true, y_pred).

    ``features`` is array<double> of one length a job. Missing features take the median of the training rows (with ``pca``
    zero). Jobs with fewer than ``least`` labelled rows or two folds give NULL predictions.
    """
    rows = pin(labelled(frame, job, key, features, target, fold))
    sizes = rows.groupBy("job").agg(F.count("*").alias("n"), F.count_distinct("cell").alias("folds"))
    enough = sizes.filter((F.col("n") >= least) & (F.col("folds") > 1)).select("job")
    wanted = pin(met(rows.select("job", "cell").distinct(), enough, ["job"]))
    filled = without_missing(rows) if pca else pin(_filled(rows, wanted))
    models = fit(met(filled, enough, ["job"], "left_semi"), wanted, pca, alphas)
    predicted = predict(filled, models)
    lost = rows.join(enough.withColumnRenamed("job", "__job"), F.col("job").eqNullSafe(F.col("__job")), "left_anti").filter(F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    # Rows with missing features of jobs that get no model were filled for none.
    return predicted.unionByName(lost.select("row.*", F.col("cell").alias("fold"), F.col("y").alias("y_true"), F.lit(None).cast("double").alias("y_pred"))) if not pca else predicted


def without_missing(rows: DataFrame) -> DataFrame:
    """Missing features as zeros."""
    return rows.withColumn("x", F.transform("x", lambda v: F.when(v.isNull() | F.isnan(v), F.lit(0.0)).otherwise(v))).withColumn("only", F.lit(None).cast("string"))


def external_predictions(train: DataFrame, external: DataFrame, job: list[str], key: str, features: str, target: str, alphas: tuple[float, ...] = ALPHAS) -> tuple[DataFrame, DataFrame]:
    """(models with their penalty, predictions of ``external``) of every job, trained on all of ``train``. No target of ``external``
    is read but to be handed through."""
    outside = F.lit("external")
    rows = labelled(train.withColumn("__cell", F.lit("train")), job, key, features, target, "__cell")
    asked = pin(rows.select("job").distinct().withColumn("cell", outside))
    other = external.select(F.struct(*job, key).alias("row"), job_name(job).alias("job"), outside.alias("cell"), F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"))
    # One fill for both: external rows lie in the cell that is left out, so no median sees them.
    filled = pin(_filled(pin(rows.unionByName(other)), asked))
    models = fit(filled.filter("cell = 'train'"), asked, None, alphas)
    return models, predict(filled.filter("cell = 'external'"), models)


#: Bytes of bootstrap models that one pass broadcasts.
BLOCK_BYTES = 64_000_000
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 16)]))


def multiplicities(row: np.ndarray, replicates: np.ndarray, seed: int) -> np.ndarray:
    """How often each row (64-bit hash) is in each bootstrap replicate: Poisson with mean one, drawn from the hash of row,
    replicate and seed, so every pass and every retry draws alike."""
    x = row.astype(np.uint64)[:, None] ^ (np.uint64(seed) + replicates.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return np.searchsorted(_POISSON, (x >> np.uint64(11)).astype(float) / 2**53, side="right").astype(float)


def bootstrap_weights(frame: DataFrame, key: str, features: str, target: str, replicates: int = 300, seed: int = 7, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(b, alpha, weights) of each replicate: standardised ridge weights, penalty by leave-one-out as in ``fit``.

    No row is copied: one pass sums the weighted Gram matrices of all replicates, a second one their weighted
    leave-one-out errors. Keys should be unique, rows of one key are drawn together. Rows with missing features are left out.
    """
    known = F.col(features).isNotNull() & ~F.exists(features, lambda v: v.isNull() | F.isnan(v)) & F.col(target).isNotNull()
    rows = frame.filter(known).select(F.xxhash64(key).alias("h"), F.col(features).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"))
    every = np.arange(replicates)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = as_matrix(batch.column("x")) if batch.num_rows else np.zeros((0, 0))
            for i in range(0, len(x), 1024):
                z = np.column_stack([np.ones(len(x[i : i + 1024])), x[i : i + 1024], np.asarray(batch.column("y"))[i : i + 1024]])
                m = multiplicities(np.asarray(batch.column("h"))[i : i + 1024], every, seed)
                grams = m.T @ (z[:, :, None] * z[:, None, :]).reshape(len(z), -1)
                total = grams if total is None else total + grams
        if total is not None:
            for b, v in enumerate(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), b), pa.int32()), pa.array(np.arange(len(v))), pa.array(v)], names=["b", "i", "v"])

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        flat = part.sort_values("i")["v"].to_numpy()
        side = int(round(len(flat) ** 0.5))
        z = flat.reshape(side, side)
        return pd.DataFrame({"b": [part["b"].iloc[0]], "model": [pickle.dumps(solved(z, None))]} if z[0, 0] >= 2 else {"b": [], "model": []})

    grams = rows.mapInArrow(sums, "b int, i long, v double").groupBy("b", "i").agg(F.sum("v").alias("v"))
    models = pin(grams.groupBy("b").applyInPandas(solve, "b int, model binary"))
    grid = np.array(sorted(alphas))
    size = models.agg(F.max(F.length("model"))).first()[0] or 1
    step = max(1, BLOCK_BYTES // size)
    scores = None
    for begin in range(0, replicates, step):
        held = {r["b"]: pickle.loads(r["model"]) for r in models.filter(F.col("b").between(begin, begin + step - 1)).collect()}
        part = rows.mapInArrow(_bootstrap_errors(frame.sparkSession.sparkContext.broadcast(held), grid, seed), "b int, k int, e double")
        scores = part if scores is None else scores.unionByName(part)
    best = scores.groupBy("b", "k").agg(F.sum("e").alias("e")).groupBy("b").agg(F.min_by("k", F.struct("e", "k")).alias("k"))

    def final(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in frames:
            out = []
            for b, model, k in zip(part["b"], part["model"], part["k"], strict=True):
                m = pickle.loads(model)
                out.append((b, float(grid[k]), (m["scale"] * (m["turn"] @ (m["pull"] / (m["values"] + grid[k])))).tolist()))
            yield pd.DataFrame(out, columns=["b", "alpha", "weights"])

    return models.join(best, "b").mapInPandas(final, "b int, alpha double, weights array<double>")


def _bootstrap_errors(shared, grid: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        names, total = np.array(sorted(models)), {}
        for batch in batches:
            if not batch.num_rows or not len(names):
                continue
            x, y, h = as_matrix(batch.column("x")), np.asarray(batch.column("y")), np.asarray(batch.column("h"))
            for b in names.tolist():
                m = multiplicities(h, np.array([b]), seed)[:, 0]
                drawn = m > 0
                total[b] = total.get(b, 0) + errors(models[b], x[drawn], y[drawn], grid, m[drawn])
        for b, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(sums), b), pa.int32()), pa.array(np.arange(len(sums)), pa.int32()), pa.array(sums)], names=["b", "k", "e"])

    return run


def bootstrap_coefficients(frame: DataFrame, key: str, features: str, names: list[str], target: str, replicates: int = 300, seed: int = 7) -> DataFrame:
    """Mean, deviation, 2.5 and 97.5 % quantiles, mean size and sign agreement of standardised ridge weights over bootstrap replicates."""
    weights = bootstrap_weights(frame, key, features, target, replicates, seed)
    named = F.array(*map(F.lit, names))
    long = weights.select(F.posexplode("weights").alias("i", "w")).select(F.get(named, F.col("i")).alias("feature"), "w")
    w = F.col("w")
    return long.groupBy("feature").agg(
        F.avg(w).alias("mean"), F.stddev_pop(w).alias("sd"), F.percentile(w, F.lit(0.025)).alias("low"), F.percentile(w, F.lit(0.975)).alias("high"),
        F.avg(F.abs(w)).alias("size"), F.greatest(F.avg((w > 0).cast("double")), F.avg((w < 0).cast("double"))).alias("sign_agreement"),
    )


#: Predictions of a feature and repeat that one task sorts, about; rows from which a slice's borders are drawn, which decide only how
#: even slices are; and rows a task packs at once.
SLICE_ROWS = 1 << 16
BORDER_ROWS = 1 << 12
PACKED_ROWS = 1 << 16


def _slice_borders(ranked: DataFrame) -> np.ndarray:
    """Borders of every feature's slices (features x slices - 1), from rows of least hash whose shares are exchanged."""
    slices = max(1, -(-ranked.count() // SLICE_ROWS))
    drawn = ranked.select("predicted", "shares").orderBy(F.xxhash64("at")).limit(BORDER_ROWS).toPandas()
    if not len(drawn):
        return np.zeros((0, 0))
    shares = np.array(drawn["shares"].tolist(), dtype=float)
    other = drawn["predicted"].to_numpy(float)[:, None] - shares + np.roll(shares, 1, axis=0)
    return np.quantile(other, np.arange(1, slices) / slices, axis=0).T


def _importance_packs(borders: np.ndarray):
    """Rows (replicate, predicted, shares, other, ry) in; predictions with a feature's share exchanged out, packed by slice, beside twice
    the target's rank less its mean, a whole number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= PACKED_ROWS:
                yield from packed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held, rows = [], 0
        if rows:
            yield from packed(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def packed(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        p = np.asarray(batch.column("predicted"))[:, None] - as_matrix(batch.column("shares")) + as_matrix(batch.column("other"))
        ry, replicate = np.rint(2 * np.asarray(batch.column("ry"))).astype("<i8"), np.asarray(batch.column("replicate"))
        if np.abs(ry).max() < 1 << 31:
            ry = ry.astype("<i4")
        for i in range(p.shape[1]):
            place = np.searchsorted(borders[i], p[:, i], "right")
            order = np.lexsort((place, replicate))
            r, s, v, y = replicate[order], place[order], p[order, i], ry[order]
            cuts = [0, *(np.flatnonzero((r[1:] != r[:-1]) | (s[1:] != s[:-1])) + 1).tolist(), len(r)]
            starts = cuts[:-1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(starts), i), pa.int32()), pa.array(r[starts], pa.int32()), pa.array(s[starts], pa.int32()),
                    *[pa.array([x[b:e].tobytes() for b, e in zip(cuts, cuts[1:], strict=False)], pa.binary()) for x in (v.astype("<f8"), y)],
                ],
                names=["i", "replicate", "slice", "p", "ry"],
            )

    return run


def _slice_ranks(part: pd.DataFrame) -> pd.DataFrame:
    """Of a slice: rows, sums of their average ranks inside it, of the ranks' squares and products with the target's, and the target's."""
    p = np.concatenate([np.frombuffer(x, "<f8") for x in part["p"]])
    y = np.concatenate([np.frombuffer(b, "<i4" if 2 * len(b) == len(x) else "<i8") for x, b in zip(part["p"], part["ry"], strict=True)]) / 2
    order = np.argsort(p)
    p, y = p[order], y[order]
    begins = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    many = np.diff(np.append(begins, len(p)))
    a = np.repeat(begins + (many + 1) / 2, many)
    return part[["i", "replicate", "slice"]].head(1).assign(n=len(p), a=a.sum(), aa=a @ a, ay=a @ y, y=y.sum())


def permutation_importance(frame: DataFrame, key: str, features: str, names: list[str], target: str, repeats: int = 50, seed: int = 7) -> DataFrame:
    """(feature, importance, sd): drop of the training Spearman correlation when a feature is permuted, over ``repeats``.

    One ridge is fitted to all rows. A permutation moves one feature's share of the prediction from row to row, the same way for all
    features: the array of shares is moved once for a repeat. The target is ranked once. Predictions of a feature and repeat are packed
    with the target's ranks, 12 bytes a row, and sorted slice by slice; of a slice only sums go on. Rows with missing features are left out.
    """
    known = frame.filter(F.col(features).isNotNull() & ~F.exists(features, lambda v: v.isNull() | F.isnan(v)))
    rows = pin(labelled(known.withColumn("__cell", F.lit("train")), [], key, features, target, "__cell").withColumn("only", F.lit(None).cast("string")))
    model = fit(rows, rows.select("job").distinct().withColumn("cell", F.lit("all")))
    told = met(rows.drop("cell"), model.select("job", "intercept", "weights"), ["job"]).select(F.col(f"row.{key}").alias("key"), "y", "intercept", F.zip_with("x", "weights", lambda a, b: a * b).alias("shares"))
    told = pin(told.withColumn("predicted", F.aggregate("shares", F.col("intercept"), lambda s, v: s + v)))
    base = spearman(told, [], "y", "predicted").select(F.col("spearman").alias("base"))
    # Rows are the same for all features and repeats, so are the target's ranks, less their mean, and the sum of their squares.
    size = told.agg(F.count("*").alias("size"))
    ranked = average_rank(told, [], "y", "ry").crossJoin(F.broadcast(size))  # one row
    ranked = by_key(ranked.select("key", "predicted", "shares", (F.col("ry") - (F.col("size") + 1) / 2).alias("ry")), [], "key")
    ranked = pin(ranked.filter("shares is not null").withColumnRenamed("__i", "at"))
    squares = ranked.agg(F.sum(F.col("ry") * F.col("ry")).alias("yy"))
    # Only numbers are put in order for a repeat: whose shares a row gets. Rows and shares are then met once.
    moved = shuffle_replicates(ranked.select("key", "at"), [], "key", "at", list(range(seed, seed + repeats))).select("replicate", "at", "shuffled")
    got = ranked.select(F.col("at").alias("shuffled"), F.col("shares").alias("other")).hint("shuffle_hash")
    whole = moved.join(got, "shuffled").join(ranked.drop("key").hint("shuffle_hash"), "at").select("replicate", "predicted", "shares", "other", "ry")
    packs = whole.mapInArrow(_importance_packs(_slice_borders(ranked)), "i int, replicate int, slice int, p binary, ry binary")
    parts = packs.groupBy("i", "replicate", "slice").applyInPandas(_slice_ranks, "i int, replicate int, slice int, n long, a double, aa double, ay double, y double")
    line = Window.partitionBy("i", "replicate")
    before = F.coalesce(F.sum("n").over(line.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = before - (F.sum("n").over(line) + 1) / 2  # a row's rank less the mean is its rank inside its slice and this
    at = parts.select("i", "replicate", "n", "a", "aa", "ay", "y", shift.alias("s"))
    s = F.col("s")
    sums = at.groupBy("i", "replicate").agg(F.sum("n").alias("rows"), F.sum(F.col("ay") + s * F.col("y")).alias("py"), F.sum(F.col("aa") + 2 * s * F.col("a") + s * s * F.col("n")).alias("pp")).crossJoin(F.broadcast(squares))  # one row
    rho = sums.select("i", "replicate", F.when((F.col("rows") >= 3) & (F.col("pp") > 0) & (F.col("yy") > 0), F.col("py") / F.sqrt("pp") / F.sqrt("yy")).alias("spearman"))
    drops = rho.crossJoin(F.broadcast(base))  # one row
    drop = F.coalesce("base", F.lit(0.0)) - F.coalesce("spearman", F.lit(0.0))
    named = F.get(F.array(*map(F.lit, names)), F.col("i"))
    return drops.groupBy(named.alias("feature")).agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("sd"))


#: Levels of all controls together: their Gram matrix, and a model of that width, are worked out on the driver and broadcast.
LEVELS = 2_000


def residualise(frame: DataFrame, target: str, controls: list[str], alphas: tuple[float, ...] = ALPHAS) -> tuple[DataFrame, DataFrame]:
    """(rows with ``<target>_residual``, one row of n, alpha, control_r2, residual_sd): what a ridge on one-hot controls leaves.

    Levels are compared as text and NULL is a level of its own. All sums come from the cells, the combinations of levels that
    occur: counts of pairs of levels make the Gram matrix, and as rows of a cell share fit and leverage, the leave-one-out errors too.
    Rows without target keep a NULL residual.
    """
    text = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("")).alias(f"c{i}") for i, c in enumerate(controls)]
    names = [f"c{i}" for i in range(len(controls))]
    y = F.col(target).cast("double")
    cells = pin(frame.filter(y.isNotNull()).select(*text, y.alias("y")).groupBy(*names).agg(F.count("*").alias("n"), F.sum("y").alias("s"), F.sum(F.col("y") * F.col("y")).alias("q")))
    each = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("level")) for i, c in enumerate(names)])
    levels = cells.select(F.explode(each).alias("e")).select("e.*").distinct().orderBy("i", "level").limit(LEVELS + 1).collect()
    if len(levels) > LEVELS:
        raise ValueError(f"controls of more than {LEVELS} levels")
    place = {(r["i"], r["level"]): k for k, r in enumerate(levels)}
    p = len(place)
    pairs = cells.select("n", "s", F.explode(each).alias("a"), each.alias("all")).select("n", "s", "a", F.explode("all").alias("b"))
    z = np.zeros((p + 2, p + 2))
    for r in pairs.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        a, b = place[tuple(r["a"])] + 1, place[tuple(r["b"])] + 1
        z[a, b] = r["n"]
        if a == b:
            z[0, a] = z[a, 0] = r["n"]
            z[a, p + 1] = z[p + 1, a] = r["s"]
    n, s, q = cells.agg(F.sum("n"), F.sum("s"), F.sum("q")).first()
    if not n:
        summary = frame.sparkSession.createDataFrame([(0, None, None, None)], "n long, alpha double, control_r2 double, residual_sd double")
        return frame.withColumn(f"{target}_residual", F.lit(None).cast("double")), summary
    z[0, 0], z[0, p + 1], z[p + 1, 0], z[p + 1, p + 1] = n, s, s, q
    model, grid = solved(z, None, scaled=False), np.array(sorted(alphas))
    shared = frame.sparkSession.sparkContext.broadcast((place, model))  # at most LEVELS squared

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where, m = shared.value
        inverse = 1 / (m["values"][:, None] + grid)
        for part in frames:
            u = sum(m["turn"][[where[i, v] for v in part[c]]] for i, c in enumerate(names)) - m["mean"] @ m["turn"]
            fit_ = m["centre"] + u @ (inverse * m["pull"][:, None])
            left = np.maximum(1 - 1 / m["n"] - (u * u) @ inverse, 1e-12)
            count, total, squares = (part[c].to_numpy(float)[:, None] for c in ("n", "s", "q"))
            yield part[names].assign(fits=list(fit_), errors=list((squares - 2 * fit_ * total + count * fit_ * fit_) / left**2))

    schema = ", ".join([*[f"{c} string" for c in names], "fits array<double>, errors array<double>"])
    told = pin(cells.mapInPandas(fitted, schema))
    sums = told.select(F.posexplode("errors").alias("k", "e")).groupBy("k").agg(F.sum("e").alias("e")).collect()
    k = min(sums, key=lambda r: (r["e"], r["k"]))["k"]
    named = frame.withColumns({f"__c{i}": t for i, t in enumerate(text)})
    fits = told.select(*[F.col(c).alias(f"__c{i}") for i, c in enumerate(names)], F.get("fits", F.lit(k)).alias("__fit"))
    rows = named.join(fits, [f"__c{i}" for i in range(len(names))], "left").withColumn(f"{target}_residual", y - F.col("__fit")).drop("__fit", *[f"__c{i}" for i in range(len(names))])
    r = F.col(f"{target}_residual")
    summary = rows.filter(r.isNotNull()).agg(F.count("*").alias("n"), F.lit(float(grid[k])).alias("alpha"), (1 - F.try_divide(F.sum(r * r), F.nullif(F.var_pop(y) * F.count("*"), F.lit(0.0)))).alias("control_r2"), F.stddev_pop(r).alias("residual_sd"))
    return rows, summary
