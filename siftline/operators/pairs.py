"""Pair operators: similarity matrices in long form, k nearest neighbours, and nearest-point joins.

A pair operator looks at all pairs only where the question is about all pairs of a small table. Nearest neighbours
multiply shuffled blocks of both sides and merge the best; a grid of points is broadcast behind a check of its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.functions.sequences import aligned_identity
from siftline.operators.order import numbered_by
from siftline.operators.ranking import value_positions
from siftline.tables import both, pin, union

#: Rows of a block of vectors, and points of a grid that may be broadcast.
BLOCK_ROWS = 20_000
BROADCAST_ROWS = 20_000
#: Products of queries and a block that a task holds at once.
PRODUCTS = 1 << 20


def correlation_network(frame: DataFrame, key: str, columns: list[str], least: float = 0.65, min_rows: int = 3) -> DataFrame:
    """Edges (a, b, correlation, abs_correlation) between columns whose Spearman correlation reaches ``least``.

    Ranks are taken over rows where both columns are known; columns that share their missing rows share one ranking. No row is
    copied for a pair: rows take the ranks of the column with fewer values, by broadcast where it has few, and are summed by the value of the
    other, which is ranked as a value. ``frame`` is read a few times for each column.
    """
    names = [f"c{i}" for i in range(len(columns))]
    title = dict(zip(names, columns, strict=True))
    wide = frame.select(*[F.col(title[c]).cast("double").alias(c) for c in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    found = [frame.sparkSession.createDataFrame([], "a string, b string, correlation double")]
    if pairs:
        unlike = wide.agg(*[F.count_if(F.col(a).isNull() != F.col(b).isNull()).alias(f"{a}_{b}") for a, b in pairs]).first()
        first = {c: next(d for d in names if d == c or not unlike[f"{d}_{c}"]) for c in names}
        for kinds in sorted({tuple(sorted((first[a], first[b]))) for a, b in pairs}):
            own = [(a, b) for a, b in pairs if tuple(sorted((first[a], first[b]))) == kinds]
            found += _pair_correlations(wide.filter(both([F.col(c).isNotNull() for c in kinds])), own, title, min_rows)
    rho = union(found).withColumn("abs_correlation", F.abs("correlation"))
    return rho.filter(F.col("abs_correlation") >= least)


def _pair_correlations(rows: DataFrame, pairs: list[tuple[str, str]], title: dict[str, str], min_rows: int) -> list[DataFrame]:
    """(a, b, correlation) of pairs of columns that are known in all rows; one row for each column reaches the driver."""
    ranks, sums = {}, {}
    for c in sorted({c for pair in pairs for c in pair}):
        centred = (F.col("below") + (F.col("n") + 1) / 2 - (F.col("total") + 1) / 2).alias(f"r_{c}")
        ranks[c] = pin(value_positions(rows.select(c), [], c).select(c, centred, "n"))
        sums[c] = ranks[c].agg(F.count("*").alias("values"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col(f"r_{c}") * F.col(f"r_{c}")).alias("squares")).first()
    known = {c for c, s in sums.items() if (s["n"] or 0) >= min_rows and s["squares"] > 0}
    fewer = lambda c: (sums[c]["values"], c)
    out = []
    for c in sorted(known, key=fewer):
        partners = [next(d for d in pair if d != c) for pair in pairs if c in pair and known.issuperset(pair) and max(pair, key=fewer) == c]
        if not partners:
            continue
        met = rows.select(c, *partners)
        for d in partners:
            side = ranks[d].select(d, f"r_{d}")
            met = met.join(F.broadcast(side) if sums[d]["values"] <= BROADCAST_ROWS else side, d)
        by_value = met.groupBy(c).agg(*[F.sum(f"r_{d}").alias(f"s_{d}") for d in partners]).join(ranks[c], c)
        totals = by_value.agg(*[F.sum(F.col(f"s_{d}") * F.col(f"r_{c}")).alias(d) for d in partners])
        rho = [F.struct(*[F.lit(title[x]).alias(k) for k, x in zip("ab", sorted((c, d), key=list(title).index), strict=True)], (F.col(d) / F.lit(sums[c]["squares"] ** 0.5) / F.lit(sums[d]["squares"] ** 0.5)).alias("correlation")) for d in partners]
        out.append(totals.select(F.explode(F.array(*rho)).alias("e")).select("e.*"))
    return out


def pairwise_identity(frame: DataFrame, key: str, sequence: str) -> DataFrame:
    """(i, j, identity) for i < j: positions that agree over positions without a gap."""
    a = frame.select(F.col(key).alias("i"), F.col(sequence).alias("x"))
    b = frame.select(F.col(key).alias("j"), F.col(sequence).alias("y"))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", aligned_identity(F.col("x"), F.col("y")).alias("identity"))


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten()).astype(float).reshape(len(column), -1)


def _best(keys: np.ndarray, vectors: np.ndarray, groups: np.ndarray | None, part: pa.RecordBatch, k: int, itself: bool) -> pa.RecordBatch:
    """The best ``k`` of a block of reference rows, sorted by key, for some queries."""
    names = np.asarray(part.column("key"))
    score = np.round(_matrix(part.column("v")) @ vectors.T, 9)
    if not itself:
        score[names[:, None] == keys[None]] = -np.inf
    if groups is not None:
        score[np.asarray(part.column("g"))[:, None] == groups[None]] = -np.inf
    most = min(k, len(keys))
    bar = np.partition(score, len(keys) - most, axis=1)[:, len(keys) - most]
    row, col = np.nonzero((score >= bar[:, None]) & np.isfinite(score))
    order = np.lexsort((keys[col], -score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, col = row[place < k], col[place < k]
    return pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(keys[col]), pa.array(score[row, col])], names=["q", "r", "similarity"])


def _tiles(k: int, itself: bool):
    """Rows sorted by tile, reference before queries: holds a tile's reference block and streams its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, block = None, [], None
        for batch in batches:
            tiles, kinds = np.asarray(batch.column("tile")), np.asarray(batch.column("kind"))
            cuts = np.flatnonzero((tiles[1:] != tiles[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(tiles)], strict=True):
                if begin == end:
                    continue
                if tiles[begin] != tile:
                    tile, held, block = tiles[begin], [], None
                part = batch.slice(begin, end - begin)
                if kinds[begin] == 0:
                    held.append(part)
                    continue
                if block is None and held:
                    rows = pa.Table.from_batches(held).sort_by("key").combine_chunks()
                    column = lambda c: rows.column(c).combine_chunks()
                    block = (np.asarray(column("key")), _matrix(column("v")), np.asarray(column("g")) if "g" in rows.column_names else None)
                step = max(1, PRODUCTS // len(block[0])) if block else 1
                for i in range(0, part.num_rows if block else 0, step):
                    yield _best(*block, part.slice(i, step), k, itself)

    return run


def nearest_by_dot(queries: DataFrame, reference: DataFrame, k: int, query_key: str, reference_key: str, vector: str, group: str | None = None, itself: bool = True, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(q, r, similarity) of the ``k`` reference vectors with the largest inner product, on the executors.

    Both sides are shuffled into blocks, the reference by falling norm, and a tile multiplies a block of one with a
    block of the other. The first round meets the longest reference vectors; what a query has found there bounds the
    rest: it goes on only to blocks whose longest vector could still reach its k-th best. Best of tiles are merged.
    Similarities are rounded to nine digits, ties go to the least key. NULL vectors are left out; with ``group`` a
    query's own group is, and without ``itself`` its own key.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")
    own = lambda frame, key: frame.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), *([F.col(group).alias("g")] if group else []))
    known = own(reference, reference_key)
    place = numbered_by(known.select("*", norm), [], "norm", "n", "key", keep_size="size")
    blocks = pin(place.select(*known.columns, "norm", F.floor((F.col("size") - F.col("n")) / block_rows).cast("int").alias("block")))
    asked = own(queries, query_key).select("*", norm)
    parts = max(1, -(-asked.count() // block_rows))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int"))
    longest = blocks.groupBy("block").agg(F.max("norm").alias("longest"))
    schema = f"q {queries.schema[query_key].dataType.simpleString()}, r {reference.schema[reference_key].dataType.simpleString()}, similarity double"
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def round_of(met_blocks: DataFrame, given: DataFrame) -> DataFrame:
        """One product of each query with each block it is given."""
        left = met_blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("kind", F.lit(0))
        both_sides = left.unionByName(given.withColumn("kind", F.lit(1)), allowMissingColumns=True).withColumn("tile", F.col("part") + F.col("block").cast("long") * parts)
        dealt = both_sides.select("tile", "kind", *known.columns).repartition(tasks, "tile").sortWithinPartitions("tile", "kind")
        return dealt.mapInArrow(_tiles(k, itself), schema)

    first = round_of(blocks.filter("block = 0"), asked.withColumn("block", F.lit(0)))
    if not blocks.filter("block > 0").take(1):
        return _merged(first, k) if parts > 1 else first
    first = pin(first)
    given = _in_reach(asked, first, longest, k)
    return _merged(first.unionByName(round_of(blocks.filter("block > 0"), given)), k)


def _in_reach(asked: DataFrame, first: DataFrame, longest: DataFrame, k: int) -> DataFrame:
    """Queries once for each further block whose longest vector times their own length could reach their k-th best so far."""
    bars = first.groupBy("q").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("bar")).withColumnRenamed("q", "key")
    rest = longest.filter("block > 0").agg(F.collect_list(F.struct("block", "longest")).alias("blocks"))
    more = asked.join(bars, "key", "left").crossJoin(F.broadcast(rest))  # one row: a number for each block of vectors
    open_ = F.filter("blocks", lambda b: F.col("bar").isNull() | (b["longest"] * F.col("norm") * (1 + 1e-12) + 1e-8 >= F.col("bar")))
    return more.withColumn("b", F.explode(open_)).select(*asked.columns, F.col("b.block").alias("block"))


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("similarity"), "r")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k).drop("n")


def knn_predictions(frame: DataFrame, key: str, vector: str, target: str, k: int = 8, group: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Leave-one-out mean of the k nearest rows' targets; with ``group``, rows of the query's own group are left out."""
    known = frame.filter(F.col(target).isNotNull())
    near = nearest_by_dot(frame, known, k, key, key, vector, group, itself=False, block_rows=block_rows)
    targets = known.select(F.col(key).alias("r"), F.col(target).cast("double").alias("rt"))
    means = near.join(targets, "r").groupBy("q").agg(F.avg("rt").alias("y_pred"), F.avg("similarity").alias("mean_similarity"))
    return frame.select(F.col(key).alias("q"), F.col(target).cast("double").alias("y_true")).join(means, "q")


def external_knn(train: DataFrame, test: DataFrame, key: str, vector: str, target: str, k: int) -> DataFrame:
    """Mean target of the k training rows nearest to each test row."""
    known = train.filter(F.col(target).isNotNull())
    near = nearest_by_dot(test, known, k, key, key, vector)
    means = near.join(known.select(F.col(key).alias("r"), F.col(target).cast("double").alias("rt")), "r").groupBy("q").agg(F.avg("rt").alias("y_pred"))
    return test.select(F.col(key).alias("q"), F.col(target).cast("double").alias("y_true")).join(means, "q")


def nearest_point(rows: DataFrame, points: DataFrame, key: str, scales: dict[str, float], tie: list[str]) -> DataFrame:
    """Each row with the point at the least weighted L1 distance over the columns of ``scales``.

    ``points`` is a grid of bounded size (checked); its columns come with the prefix ``mapped_``.
    """
    if points.count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} points")
    named = points.select(*[F.col(c).alias(f"mapped_{c}") for c in points.columns])
    gap = sum((F.abs(F.col(c) - F.col(f"mapped_{c}")) * w for c, w in scales.items()), F.lit(0.0))
    found = rows.join(F.broadcast(named)).withColumn("mapping_distance", F.round(gap, 9))
    carried = [c for c in found.columns if c != key]
    least = F.min_by(F.struct(*carried), F.struct("mapping_distance", *[f"mapped_{t}" for t in tie]))
    return found.groupBy(key).agg(least.alias("m")).select(key, "m.*")
