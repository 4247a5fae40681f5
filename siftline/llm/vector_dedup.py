"""Near-duplicate vectors by cosine: int8 tile products with error bounds, full precision only near the threshold.

Every distinct vector is scaled to length one and quantised once: a byte for each component, one scale, and the measured
length of what rounding took off. Two quantised vectors' product with both errors bounds the cosine from both sides;
only pairs whose bounds straddle the threshold are computed again from the vectors themselves, inside their tile.

Tiles are blocks of rows against blocks of rows. Pivots (centroids of a bounded sample) part the vectors into cells, and a
vector meets another cell only if it lies within the threshold's angle of the plane between the two pivots: no pair at or
above the threshold is lost, whatever the pivots are. A tile sends counts and a spanning forest of its links, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from siftline.llm.common import NULL_ID, carried, doc_key, need, quoted, settle, shuffle_partitions, table
from siftline.llm.components import components

THRESHOLD = 0.9
#: Rows of a block at least: a tile multiplies two of them. A row is sent to as many tiles as there are blocks, so blocks grow
#: with the table where they would be over ``BLOCKS``, up to ``SIDE`` bytes of rows as a task holds them (20 a component).
TILE = 8_192
BLOCKS, SIDE = 8, 64 << 20
#: Rows of a tile that are multiplied at once, and pairs that are computed again at once.
STRIP, AGAIN = 256, 65_536
#: Pivots at most, and vectors they are drawn from; both bound what the driver fits and every task holds.
PIVOTS, SAMPLE = 256, 2_048
#: What double rounding may add to a bound.
SLACK = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one in double precision; a power of two first, so no square over- or underflows."""
    power = np.frexp(np.abs(vectors).max(axis=1))[1]
    scaled = np.ldexp(vectors, -power[:, None])
    return scaled / np.sqrt((scaled * scaled).sum(axis=1))[:, None]


def quantise(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, scale, length of the rounding error) of every row of length one."""
    scale = np.abs(units).max(axis=1) / 127
    q = np.rint(units / scale[:, None]).astype(np.int8)
    gone = units - q * scale[:, None]
    return q, scale, np.sqrt((gone * gone).sum(axis=1)) + SLACK


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def fit_pivots(nodes: DataFrame, most: int, sample: int) -> dict[int, np.ndarray]:
    """Vector length -> unit pivots, by a few rounds of spherical k-means over the ``sample`` vectors of least hash."""
    drawn = nodes.select("v", "h1", "h2").orderBy("h1", "h2").limit(sample).toArrow().column("v").to_pylist()
    found = {}
    for d in {len(v) for v in drawn}:
        u = unit(np.array([v for v in drawn if len(v) == d], dtype=np.float64))
        centres = u[: max(1, min(most, len(u)))].copy()
        for _ in range(8):
            own = np.argmax(u @ centres.T, axis=1)
            for k in range(len(centres)):
                total = u[own == k].sum(axis=0)
                if (length := np.sqrt(total @ total)) > 1e-6:
                    centres[k] = total / length
        found[d] = np.unique(centres, axis=0)
    return found


def _placed(pivots: dict[int, np.ndarray], threshold: float):
    """Quantises vectors and names their cell and, beside it, every cell that may hold a partner."""
    apart = float(np.sqrt(max(0.0, 1.0 - threshold * threshold)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("d"))
            for d in np.unique(lengths):
                part = batch.filter(pa.array(lengths == d))
                v = _matrix(part.column("v"))
                u = unit(v.astype(np.float64))
                q, scale, gone = quantise(u)
                base = int(d) * 1_000_000
                centres = pivots.get(int(d))
                if centres is None or threshold <= 0:
                    own, meets = np.full(len(u), base), [[base]] * len(u)
                else:
                    near = u @ centres.T
                    cell = np.argmax(near, axis=1)
                    between = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0.0))
                    over = (near[np.arange(len(u)), cell][:, None] - near) <= between[cell] * apart + SLACK
                    over[np.arange(len(u)), cell] = True
                    own, meets = base + cell, [(base + np.flatnonzero(o)).tolist() for o in over]
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in ("id", "h1", "h2", "m")], pa.array(own, pa.int64()), pa.array(meets, pa.list_(pa.int64())), pa.array([r.tobytes() for r in q], pa.binary()),
                        pa.array(scale), pa.array(gone), pa.array([r.tobytes() for r in v], pa.binary()),
                    ],
                    names=["id", "h1", "h2", "m", "own", "meets", "q", "scale", "gone", "v"],
                )

    return run


PLACED = "id long, h1 long, h2 long, m long, own long, meets array<long>, q binary, scale double, gone double, v binary"


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of linked rows: ``label`` holds each row's least row."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label[:] = parent[label]


class Side:
    """One block of a tile."""

    def __init__(self, rows: list[pa.RecordBatch]):
        get = lambda c: np.concatenate([np.asarray(r.column(c)) for r in rows])
        self.id, self.h1, self.h2, self.m, self.scale, self.gone = map(get, ("id", "h1", "h2", "m", "scale", "gone"))
        join = lambda c, t: np.frombuffer(b"".join(x for r in rows for x in r.column(c).to_pylist()), t).reshape(len(self.id), -1)
        self.q = join("q", np.int8)
        # A vector of floats travels as floats: four bytes a component, or eight.
        wide = len(rows[0].column("v")[0].as_py()) // max(1, self.q.shape[1])
        self.v = join("v", np.float32 if wide == 4 else np.float64)

    def units(self) -> np.ndarray:
        return unit(self.v.astype(np.float64))


def tile_links(a: Side, b: Side | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Linked pairs (row of a, row of b) strip by strip, and how many were computed again; ``b`` None: a with itself."""
    same, b = b is None, a if b is None else b
    # Products of bytes sum to whole numbers: single precision holds them up to 1,040 dimensions.
    kind = np.float32 if a.q.shape[1] <= 1_040 else np.float64
    qa, qb = a.q.astype(kind), b.q.astype(kind)
    ua = a.units()
    ub = ua if same else b.units()
    worst, widest = b.gone.max(), b.scale.max()
    for i in range(0, len(qa), STRIP):
        j = i if same else 0
        whole = qa[i : i + STRIP] @ qb[j:].T
        # The least product that could reach the threshold with any row of b.
        least = threshold - a.gone[i : i + STRIP] - (1 + a.gone[i : i + STRIP]) * worst
        bar = np.where(least > 0, least / (a.scale[i : i + STRIP] * widest), -np.inf)
        r, c = np.nonzero(whole >= np.floor(bar)[:, None].astype(kind))
        r, c, near = r + i, c + j, whole[r, c].astype(np.float64)
        if same:
            r, c, near = r[c > r], c[c > r], near[c > r]
        near *= a.scale[r] * b.scale[c]
        off = a.gone[r] + (1 + a.gone[r]) * b.gone[c]
        yes = near - off >= threshold
        open_ = np.flatnonzero(~yes & (near + off >= threshold))
        for k in range(0, len(open_), AGAIN):
            at = open_[k : k + AGAIN]
            yes[at] = (ua[r[at]] * ub[c[at]]).sum(axis=1) >= threshold
        yield r[yes], c[yes], len(open_)


def _tile(a: Side, b: Side | None, threshold: float) -> Iterator[pa.RecordBatch]:
    n = len(a.id)
    total = n + (0 if b is None else len(b.id))
    label, count = np.arange(total), np.zeros(total, dtype=np.int64)
    weight = a.m if b is None else np.concatenate([a.m, b.m])
    for r, c, _ in tile_links(a, b, threshold):
        c = c if b is None else c + n
        count += np.bincount(r, weight[c], total).astype(np.int64) + np.bincount(c, weight[r], total).astype(np.int64)
        _joined(label, r, c)
    some = np.flatnonzero(count)
    if len(some):
        key = [getattr(a, k) if b is None else np.concatenate([getattr(a, k), getattr(b, k)]) for k in ("id", "h1", "h2")]
        yield pa.RecordBatch.from_arrays([*[pa.array(k[some]) for k in key], pa.array(count[some]), *[pa.array(k[label[some]]) for k in key]], names=["id", "h1", "h2", "n", "to_id", "to_h1", "to_h2"])


def _tiles(threshold: float):
    """Rows sorted by tile and side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, sides = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            if 0 in sides:
                yield from _tile(Side(sides[0]), None, threshold)
            elif 1 in sides and 2 in sides:
                yield from _tile(Side(sides[1]), Side(sides[2]), threshold)

        for batch in batches:
            tiles, kinds = np.asarray(batch.column("tile")), np.asarray(batch.column("side"))
            cuts = np.flatnonzero((tiles[1:] != tiles[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(tiles)], strict=True):
                if begin == end:
                    continue
                if tiles[begin] != tile:
                    yield from done()
                    tile, sides = tiles[begin], {}
                sides.setdefault(int(kinds[begin]), []).append(batch.slice(begin, end - begin))
        yield from done()

    return run


LINKS = "id long, h1 long, h2 long, n long, to_id long, to_h1 long, to_h2 long"


def link_vectors(nodes: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """Links of distinct vectors ``nodes`` (id, h1, h2, m copies, v), summed up by tile: each linked vector with the number
    of others it links with there, copies counted, and the vector that stands for its part of the tile's links."""
    spark = nodes.sparkSession
    count, widest = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    tile = max(tile, min(-(-count // BLOCKS), SIDE // (20 * widest)))
    centres = fit_pivots(nodes, max(1, min(pivots, count // tile)), sample)
    kind = "array<float>" if nodes.schema["v"].dataType.elementType == FloatType() else "array<double>"
    rows = nodes.select("id", "h1", "h2", "m", F.size("v").alias("d"), F.col("v").cast(kind).alias("v"))
    placed = settle(rows.mapInArrow(_placed(centres, threshold), PLACED), "placed")
    # At most pivots x pivots counts (times the lengths that occur): how many rows of a cell meet another one.
    met = {(r[0], r[1]): -(-r[2] // tile) for r in placed.select("own", F.explode("meets").alias("other")).groupBy("own", "other").count().collect()}
    layout, tiles = [], 0
    for (a, b), blocks in sorted(met.items()):
        if a <= b and (others := met.get((b, a))):
            # The greater cell's blocks number the tile's rows, the smaller one's its columns.
            layout.append((a, b, blocks, others, tiles, 2))
            if a < b:
                layout.append((b, a, others, blocks, tiles, 1))
            tiles += blocks * others
    grid = spark.createDataFrame(layout, "own long, other long, blocks long, others long, first long, side int")
    dealt = placed.withColumn("other", F.explode("meets")).join(F.broadcast(grid), ["own", "other"])  # pivots x pivots rows
    mine = F.pmod("h2", F.col("blocks"))
    there = F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("there")
    spread = dealt.select("id", "h1", "h2", "m", "q", "scale", "gone", "v", "own", "other", "blocks", "others", "first", "side", mine.alias("mine"), there)
    # Inside a cell a pair of blocks is one tile, the lesser block its rows; a block with itself has one side.
    inner = F.col("own") == F.col("other")
    low, high = F.least("mine", "there"), F.greatest("mine", "there")
    number = F.when(inner, low * F.col("blocks") + high).when(F.col("side") == 1, F.col("mine") * F.col("others") + F.col("there")).otherwise(F.col("there") * F.col("blocks") + F.col("mine"))
    side = F.when(inner, F.when(F.col("mine") == F.col("there"), 0).when(F.col("mine") < F.col("there"), 1).otherwise(2)).otherwise(F.col("side"))
    tasks = max(1, min(tiles, 16 * shuffle_partitions(spark)))
    cells = spread.select((F.col("first") + number).alias("tile"), side.alias("side"), "id", "h1", "h2", "m", "q", "scale", "gone", "v")
    dealt = cells.repartitionById(tasks, F.pmod("tile", F.lit(tasks)).cast("int")).sortWithinPartitions("tile", "side")
    return settle(dealt.mapInArrow(_tiles(threshold), LINKS), "links")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding", tile: int = TILE, pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """Every row of ``vectors`` (vec_id, ``vector``) with its links and its group.

    Rows link if the cosine of their vectors in double precision is at least ``threshold`` (over 0, at most 1). Returns vec_id,
    n_links (other rows linked directly), component_id (smallest vec_id reachable, itself included), kept (vec_id is
    component_id) and ``row`` (all other columns in a struct, whatever they are called).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do vectors of different
    length with each other. Every row is a vector of its own, so rows that repeat an id, or id and vector, link like any
    others; equal vectors are computed once, with the smallest id. Null ids come last: a group's id is null only if
    all its ids are. Very long vectors take part whole. An empty table gives an empty result.
    """
    need(vectors, "vec_id", vector)
    v = quoted(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    good = F.coalesce(v.isNotNull() & finite, F.lit(False))
    marks = {"h1": F.when(good, F.xxhash64(v)), "h2": F.when(good, F.xxhash64(F.lit(0x5DEECE66D), v))}
    rows = vectors.select(doc_key("vec_id").alias("id"), carried(vectors, "vec_id"), F.when(good, v).alias("v"), *[x.alias(c) for c, x in marks.items()])
    nodes = settle(rows.filter("v is not null").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.first("v").alias("v")), "vectors")
    links = link_vectors(nodes, threshold, tile, pivots, sample)
    node = lambda p: F.struct(F.col(f"{p}id").alias("id"), F.col(f"{p}h1").alias("h1"), F.col(f"{p}h2").alias("h2"))
    groups = components(links.select(node("").alias("a"), node("to_").alias("b"))).select("node.h1", "node.h2", F.col("label.id").alias("least"))
    counts = links.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    known = nodes.select("h1", "h2", "id", "m").join(counts, ["h1", "h2"], "left").join(groups, ["h1", "h2"], "left")
    known = known.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("least", "id").alias("least"))
    met = rows.drop("v").join(known, ["h1", "h2"], "left")
    least = F.coalesce("least", "id")
    back = lambda c: F.nullif(c, F.lit(NULL_ID))
    return met.select(back(F.col("id")).alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), back(least).alias("component_id"), (F.col("id") == least).alias("kept"), "row")


def op12_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).drop("row")


ORACLE_SQL = f"""
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), sized AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS l FROM good
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.l * b.l) >= {THRESHOLD}
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS m FROM reach GROUP BY a
), many AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept
FROM embeddings LEFT JOIN many ON many.a = vec_id LEFT JOIN least ON least.a = vec_id
"""
