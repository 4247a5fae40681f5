"""Null models by seeded hash order, and the verdicts drawn from them. Groups may be of any size: rows are numbered and shifted
bucket by bucket of the order (see ``order``), and all replicates are rows of one table; ``null_correlations`` packs them."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators.order import PLACE, hash_bucket, hashed, in_buckets, met, numbered, numbered_by
from siftline.operators.ranking import both_ranked
from siftline.tables import pin, union


def _replicated(frame: DataFrame, seeds: list[int], key: str) -> DataFrame:
    """Every row once for each seed (``replicate``), with its place ``__h`` in that seed's order."""
    many = frame.withColumn("replicate", F.explode(F.array(*map(F.lit, seeds))))
    return many.withColumn("__h", hashed(F.col("replicate"), key))


def derange_replicates(frame: DataFrame, by: list[str], key: str, value: str, seeds: list[int], out: str = "scrambled") -> DataFrame:
    """One derangement for each seed, as rows with ``replicate``: every row gets ``value`` of the next row of its group in a
    seeded order, the last row the first one's, so no row keeps its own and composition stays. A group of one
    cannot be deranged (``non_derangeable``).

    The next row is in the same bucket of the order, or it is the first of the next bucket that holds any: only those
    first rows, at most one a bucket, are brought into line.
    """
    dealt = in_buckets(_replicated(frame, seeds, key), [*by, "replicate"], hash_bucket(F.col("__h")))
    order = Window.partitionBy(*PLACE).orderBy("__h", key)
    held = F.struct(F.col(value).alias("v"))  # tells a NULL value from no next row
    firsts = dealt.groupBy(*PLACE).agg(F.min_by(held, F.struct("__h", key)).alias("__first"), F.count("*").alias("__n"))
    line = Window.partitionBy("__k").orderBy("__bucket")
    around = F.coalesce(F.lead("__first").over(line), F.first_value("__first").over(line))
    total = F.sum("__n").over(Window.partitionBy("__k"))
    after = firsts.select(*PLACE, around.alias("__after"), (total <= 1).alias("non_derangeable"))
    moved = dealt.withColumn("__next", F.lead(held).over(order)).join(after, PLACE)
    return moved.withColumn(out, F.coalesce("__next", "__after")["v"]).drop("__h", *PLACE, "__next", "__after")


def derange(frame: DataFrame, by: list[str], key: str, value: str, seed: int, out: str = "scrambled") -> DataFrame:
    """The derangement of one seed."""
    return derange_replicates(frame, by, key, value, [seed], out).drop("replicate")


def by_key(frame: DataFrame, by: list[str], key: str) -> DataFrame:
    """Adds ``__i``: numbers by ``key``, or by its hash where it is no number."""
    if isinstance(frame.schema[key].dataType, T.NumericType):
        return numbered_by(frame, by, key, "__i")
    return numbered(frame.withColumn("__h", hashed(F.lit(""), key)), by, [F.col("__h"), F.col(key)], hash_bucket(F.col("__h")), "__i").drop("__h")


def shuffle_replicates(frame: DataFrame, by: list[str], key: str, label: str, seeds: list[int], out: str = "shuffled") -> DataFrame:
    """One permutation of ``label`` inside each group for each seed, as rows with ``replicate``: the i-th row in a seeded
    order gets the label of the i-th row by ``key``, which is numbered once for all seeds (keys that are no numbers by their hash)."""
    plain = by_key(frame.select(*by, key, F.col(label).alias(out)), by, key)
    drawn = numbered(_replicated(frame, seeds, key), [*by, "replicate"], [F.col("__h"), F.col(key)], hash_bucket(F.col("__h")), "__i").drop("__h")
    # The labels of one replicate are the small side whatever the number of replicates: hashed, not sorted.
    return met(drawn, plain.select(*by, "__i", out).hint("shuffle_hash"), [*by, "__i"]).drop("__i")


def shuffle_labels(frame: DataFrame, by: list[str], key: str, label: str, seed: int, out: str = "shuffled") -> DataFrame:
    """The permutation of one seed."""
    return shuffle_replicates(frame, by, key, label, [seed], out).drop("replicate")


def ranked_once(frame: DataFrame, by: list[str], key: str, x: str, y: str) -> DataFrame:
    """Complete pairs (by, key) with ``cx`` and ``cy``: ranks of x and y less the group's mean rank, pinned. Permuting one
    side inside a group moves its ranks along, so no null needs a ranking of its own."""
    return pin(centred(both_ranked(frame, by, x, y, key), by, key))


def centred(ranked: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, key, cx, cy) of rows with ranks ``rx`` and ``ry`` of ``x_total``."""
    middle = (F.col("x_total") + 1) / 2
    return ranked.select(*by, key, (F.col("rx") - middle).alias("cx"), (F.col("ry") - middle).alias("cy"))


def rank_correlations(ranked: DataFrame, by: list[str], x: str = "cx", y: str = "cy", least: int = 3) -> DataFrame:
    """(by, n, spearman) of centred ranks; NULL for fewer than ``least`` rows or a constant side."""
    a, b = F.col(x), F.col(y)
    sums = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum(a * b).alias("ab"), F.sum(a * a).alias("aa"), F.sum(b * b).alias("bb"))
    return sums.select(*by, "n", _correlation(least).alias("spearman"))


def _correlation(least: int) -> Column:
    known = (F.col("n") >= least) & (F.col("aa") > 0) & (F.col("bb") > 0)
    return F.when(known, F.col("ab") / F.sqrt("aa") / F.sqrt("bb"))


#: Leading bits of a hash that part a group's seeded order into slices, each sorted in one task for one seed at a time. A group of
#: fewer than ``SLICE_ROWS`` rows a slice has fewer.
SLICE_BITS = 6
SLICE_ROWS = 4096
#: Rows whose places in all seeded orders a task packs at once, and rows below which a task is not worth its smaller packs.
PACKED_ROWS = 1 << 17
LEAST_ROWS = 1 << 14
#: Bytes that tell a row's hash from others of its slice.
TOLD = 6
COUNTED = "__g long, __slice int, replicate int, n long"
PACKED = f"{COUNTED}, h binary, v binary, w binary"
SUMS = f"{COUNTED}, vw double, ties long, __first double, __last double"


def _bytes_of(x: np.ndarray) -> np.ndarray:
    """A row of bytes for each number, as few as lose nothing: 3 for halves, as centred ranks in groups of up to 8 million rows are."""
    twice = 2 * x + (1 << 23)
    if ((twice == np.floor(twice)) & (twice >= 0) & (twice < 1 << 24)).all():
        return twice.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
    short = x.astype(np.float32)
    return (short if (short == x).all() else x).view(np.uint8).reshape(len(x), -1)


def _floats(x: bytes, n: int) -> np.ndarray:
    if len(x) != 3 * n:
        return np.frombuffer(x, np.float32 if len(x) == 4 * n else np.float64).astype(np.float64)
    wide = np.zeros((n, 4), np.uint8)
    wide[:, :3] = np.frombuffer(x, np.uint8).reshape(n, 3)
    return (wide.view("<u4").ravel().astype(np.float64) - (1 << 23)) / 2


def _steps(h: np.ndarray) -> bytes:
    """Ascending hashes as their differences, byte by byte of all: the leading bytes are mostly zero, which a shuffle's codec leaves out."""
    return np.diff(h, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOLD].T.tobytes()


def _hashes(x: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :TOLD] = np.frombuffer(x, np.uint8).reshape(TOLD, n).T
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def _seeded(seeds: list[int], second: bool | None):
    """Rows (__g, __bits, key, v, w) in, one row out for each seed, group and slice of its order that they fall in: their number, and
    unless ``second`` is None, their hashes in ascending order and values. So a row costs a seed some eight bytes, a sixth of what it
    takes as a row of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= PACKED_ROWS:
                yield from packed(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            yield from packed(pa.Table.from_batches(held))

    def packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        g, bits, v, w = (rows.column(c).to_numpy() for c in ("__g", "__bits", "v", "w"))
        groups, g = np.unique(g, return_inverse=True)
        v, w, one = _bytes_of(v), _bytes_of(w), np.uint64(1)
        # ``concat_ws`` leaves out a NULL and its separator.
        keys = [b"" if k is None else b"|" + k for k in rows.column("key").cast(pa.binary()).to_pylist()]
        for seed in seeds:
            name = str(seed).encode()
            h = np.frombuffer(b"".join([md5(name + k).digest()[:8] for k in keys]), ">u8").astype(np.uint64) >> np.uint64(4)
            cell = g << SLICE_BITS | (h >> (60 - bits).astype(np.uint64)).astype(np.int64)
            order = np.lexsort((h, g))  # the leading bits are the slice
            cells, begin, many = np.unique(cell[order], return_index=True, return_counts=True)
            columns = [pa.array(groups[cells >> SLICE_BITS]), pa.array((cells & ((1 << SLICE_BITS) - 1)).astype(np.int32)), pa.array(np.full(len(cells), seed, np.int32)), pa.array(many)]
            if second is not None:
                cut = lambda x: np.split(x[order], begin[1:])  # noqa: B023, E731
                told = (h & ((one << (60 - bits).astype(np.uint64)) - one)) >> (60 - bits - 8 * TOLD).astype(np.uint64)
                columns += [pa.array(c, pa.binary()) for c in (list(map(_steps, cut(told))), [x.tobytes() for x in cut(v)], [x.tobytes() for x in cut(w)] if second else [None] * len(cells))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in (COUNTED if second is None else PACKED).split(", ")])

    return run


def _slice_sums(second: bool):
    """Rows (__g, __slice, kind, replicate, n, x, h, v, w), sorted so, in, ``SUMS`` of each slice and seed out.

    With ``second`` each row's w is met with the v of the next one in the slice, whose ends are told. Else v is met with the value
    ``x`` at the same place ``n`` of the order by key: kind 0 are those that any seed needs here, kind 1 says where a seed's slice begins.
    """
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in SUMS.split(", ")])

    def summed(at: tuple, seed: int, rows: list[tuple], first: int, values: np.ndarray, start: int) -> dict:
        size = sum(n for n, *_ in rows)
        h = np.concatenate([_hashes(told, n) for n, told, *_ in rows])
        order = np.argsort(h, kind="stable")
        v = np.concatenate([_floats(v, n) for n, _, v, _ in rows])[order]
        w = np.concatenate([_floats(w, n) for n, *_, w in rows])[order] if second else v
        total = v[1:] @ w[:-1] if second else v @ values[start - first : start - first + size]
        ties = int((h[order][1:] == h[order][:-1]).sum())
        return dict(zip(schema.names, (*at, seed, size, float(total), ties, float(v[0]), float(w[-1])), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seed, held, known, starts, values = None, None, [], [], {}, np.zeros(0)
        for batch in batches:
            done = []
            for g, part, kind, replicate, n, x, *packed in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and ((g, part) != now or replicate != seed):
                    done.append(summed(now, seed, held, known[0][0] if known else 0, values, starts.get(seed, 0)))
                    held = []
                if (g, part) != now:
                    now, known, starts, values = (g, part), [], {}, np.zeros(0)
                if kind == 0:
                    known.append((n, x))
                elif kind == 1:
                    starts[replicate] = n
                else:
                    if known and not len(values):
                        known.sort()
                        values = np.array([x for _, x in known])
                    seed = replicate
                    held.append((n, *packed))
            yield pa.RecordBatch.from_pylist(done, schema)
        if held:
            yield pa.RecordBatch.from_pylist([summed(now, seed, held, known[0][0] if known else 0, values, starts.get(seed, 0))], schema)

    return run


def null_correlations(ranked: DataFrame, by: list[str], key: str, seeds: list[int], moved: str = "cx", how: str = "shuffle") -> DataFrame:
    """(by, replicate, n, spearman) of ``ranked_once`` rows with one side shuffled or deranged inside each group, by seed.

    A seed only moves values along, so its sum of products is all that it takes. No row is copied: tasks deal the hashes and values of
    their rows to slices of each seed's order, packed, and a slice is sorted for one seed at a time. Rows of a slice are told apart
    by 48 bits; a seed for which two are equal is done again row by row, where the key decides.
    """
    other, second = ("cy" if moved == "cx" else "cx"), how == "derange"
    sizes = ranked.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("cx") * F.col("cx")).alias("aa"), F.sum(F.col("cy") * F.col("cy")).alias("bb"))
    bits = F.least(F.lit(SLICE_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / SLICE_ROWS)))).cast("int")
    groups = pin(sizes.withColumns({"__g": F.monotonically_increasing_id(), "__bits": bits}))
    rows = met(ranked.select(*by, key, "cx", "cy"), F.broadcast(groups.select(*by, "__g", "__bits")), by)  # a row of a group
    if not by:
        rows = rows.select("__g", "__bits", key, "cx", "cy")
    v, w = (moved, other) if second else (other, moved)
    own = rows.select("__g", "__bits", F.col(key).cast("string").alias("key"), F.col(v).alias("v"), F.col(w).alias("w"))
    many = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]  # one number
    tasks = max(-(-many // PACKED_ROWS), min(own.sparkSession.sparkContext.defaultParallelism, -(-many // LEAST_ROWS)), 1)
    own = own.repartition(tasks, "key")  # full packs: what a row takes falls with their size
    slices = own.mapInArrow(_seeded(seeds, second), PACKED).withColumns({"kind": F.lit(2), "x": F.lit(None).cast("double")})
    if not second:
        # Where each seed's slices begin, and the values in the order by key that any seed needs of a slice: about its share of a group.
        counts = own.mapInArrow(_seeded(seeds, None), COUNTED).groupBy("__g", "replicate", "__slice").agg(F.sum("n").alias("n"))
        before = Window.partitionBy("__g", "replicate").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        starts = pin(counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))))
        reach = starts.groupBy("__g", "__slice").agg(F.min("start").alias("low"), F.max(F.col("start") + F.col("n")).alias("high"))
        reach = reach.groupBy("__g").agg(F.collect_list(F.struct("__slice", "low", "high")).alias("reach"))  # 64 at most
        placed = by_key(rows.select("__g", key, moved), ["__g"], key).withColumn("n", F.col("__i") - 1).join(reach, "__g")
        needed = F.filter("reach", lambda r: (r["low"] <= F.col("n")) & (F.col("n") < r["high"]))
        values = placed.select("__g", F.explode(needed).alias("r"), "n", F.col(moved).alias("x")).select("__g", "r.__slice", "n", "x", F.lit(0).alias("kind"))
        slices = union([slices, values, starts.select("__g", "__slice", "replicate", F.col("start").alias("n"), F.lit(1).alias("kind"))])
    columns = ["__g", "__slice", "kind", "replicate", "n", "x", "h", "v", "w"]
    dealt = slices.select(*columns).repartition("__g", "__slice").sortWithinPartitions(*columns[:4])
    sums = pin(dealt.mapInArrow(_slice_sums(second), SUMS))
    line = Window.partitionBy("__g", "replicate").orderBy("__slice")
    following = F.coalesce(F.lead("__first").over(line), F.first_value("__first").over(line))
    whole = sums.withColumn("vw", F.col("vw") + F.when(F.lit(second), following * F.col("__last")).otherwise(0.0))
    total = whole.groupBy("__g", "replicate").agg(F.sum("vw").alias("ab")).join(groups, "__g")
    found = total.select(*by, "replicate", "n", _correlation(3).alias("spearman"))
    if not (again := [r.replicate for r in sums.filter("ties > 0").select("replicate").distinct().collect()]):  # a number of each seed
        return found
    many = {"shuffle": shuffle_replicates, "derange": derange_replicates}[how](ranked.select(*by, key, "cx", "cy"), by, key, moved, again, "__m")
    return found.filter(~F.col("replicate").isin(again)).unionByName(rank_correlations(many, [*by, "replicate"], "__m", other))


def scramble_diagnostics(scrambled: DataFrame, by: list[str], value: str, out: str = "scrambled") -> DataFrame:
    """Rows, share of rows that differ from their own value, and whether the group is too small to derange."""
    return scrambled.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((F.col(value) != F.col(out)).cast("double")).alias("moved_fraction"), F.max("non_derangeable").alias("non_derangeable")
    )


def gate_verdict(metrics: DataFrame, delta: float = 0.05, null_cutoff: float = 0.15, low_n: int = 100) -> DataFrame:
    """One row per assay from (assay, feature_block, n, spearman).

    Blocks: global_composition, surface_composition, real_topology, scrambled_topology_*, label_shuffle_*. Shuffled labels
    away from zero void the gate. Otherwise PASS needs the real topology to beat the scrambles (by ``delta`` and by a
    standard deviation) and the surface composition, WEAK PASS the scrambles only; few rows are marked.
    """
    block, rho = F.col("feature_block"), F.col("spearman")

    def one(name: str) -> Column:
        return F.max(F.when(block == name, rho))

    def over(f, prefix: str) -> Column:
        return f(F.when(block.startswith(prefix), rho))

    rows = metrics.groupBy("assay").agg(
        F.coalesce(F.max(F.when(block == "real_topology", F.col("n"))), F.lit(0)).cast("long").alias("n"),
        one("global_composition").alias("global"),
        one("surface_composition").alias("surface"),
        one("real_topology").alias("real"),
        over(F.avg, "scrambled_topology_").alias("scrambled_mean"),
        over(F.stddev_pop, "scrambled_topology_").alias("scrambled_sd"),
        over(F.avg, "label_shuffle_").alias("shuffle_mean"),
        over(F.stddev_pop, "label_shuffle_").alias("shuffle_sd"),
    )
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    beats_scrambled = yes((c("real") - c("scrambled_mean") > delta) & (c("real") > c("scrambled_mean") + c("scrambled_sd")))
    beats_surface = yes(c("real") - c("surface") > delta)
    grade = F.when(beats_scrambled & beats_surface, "PASS").when(beats_scrambled, "WEAK PASS").otherwise("FAIL")
    caution = F.when((c("n") > 0) & (c("n") < low_n), "; LOW-N CAUTION").otherwise("")
    verdict = F.when(yes(F.abs("shuffle_mean") >= null_cutoff), "NEGATIVE CONTROL FAIL").otherwise(F.concat(grade, caution))
    return rows.withColumn("delta_surface", c("real") - c("surface")).withColumn("delta_scrambled", c("real") - c("scrambled_mean")).withColumn("verdict", verdict)


def positive_controls(metrics: DataFrame, margin: float = 0.15, tolerance: float = 0.10, cutoff: float = 0.15) -> DataFrame:
    """One row for each synthetic assay from (assay, feature_block, spearman): what is compared, and PASS or FAIL. An assay
    is named by its control; a colon and a name of its own may follow."""
    c = F.col
    rows = gate_verdict(metrics.withColumn("n", F.lit(0))).select("assay", "surface", "real", "scrambled_mean", "scrambled_sd")
    kind = F.substring_index("assay", ":", 1)
    delta = (
        F.when(kind == "positive_control_composition", c("real") - c("surface"))
        .when(kind == "positive_control_topology", c("real") - c("scrambled_mean"))
        .when(kind == "positive_control_shuffled", c("real"))
    )
    passed = (
        F.when(kind == "positive_control_composition", F.abs(delta) <= tolerance)
        .when(kind == "positive_control_topology", (delta > margin) & (c("real") > c("scrambled_mean") + c("scrambled_sd")))
        .when(kind == "positive_control_shuffled", F.abs(delta) <= cutoff)
    )
    return rows.withColumn("diagnostic_delta", delta).withColumn("verdict", F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise("FAIL"))


def zscores(frame: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Each column less its group's mean over its sample deviation; 0 where it is constant. Moments are aggregated first, then joined."""
    moments = frame.groupBy(*by).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    met = frame.join(moments, by) if by else frame.crossJoin(F.broadcast(moments))  # one row
    z = [F.coalesce(F.try_divide(F.col(c) - F.col(f"__m_{c}"), F.nullif(F.col(f"__s_{c}"), F.lit(0.0))), F.lit(0.0)).alias(c) for c in columns]
    return met.select(*[c for c in frame.columns if c not in columns], *z)


def bootstrap_means(frame: DataFrame, key: str, value: str, replicates: int, seed: int = 7) -> DataFrame:
    """Mean and 95 % interval of bootstrap means: row i of a replicate is row (hash of seed, replicate, i) mod n.

    Multiplicities are drawn for row numbers, aggregated to one sum for each replicate before anything moves on.
    """
    known = frame.filter(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("x"))
    rows = pin(numbered_by(known, [], key, "i", keep_size="n").select((F.col("i") - 1).alias("i"), "x", "n"))
    many = rows.select("i", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("b"))
    picked = many.select("b", F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("b"), F.col("i"))), 1, 8), 16, 10).cast("long"), F.col("n")).alias("i"))
    means = picked.join(rows.select("i", "x"), "i").groupBy("b").agg(F.avg("x").alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd"), F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
