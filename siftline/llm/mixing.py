"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is met with whole documents. Passes over all of its documents come first; the rest of the
budget is fitted on the histogram of exact document lengths: every length gives its proportional share, one more
document where the rounding left most, and what still lacks is closed by a bounded-knapsack dynamic programme
over length counts. No length is preferred, however large the table. Which documents of a length are taken is
decided by a seeded hash of id and text. What one task holds of a source is one row per distinct length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import carried, need, settle, shuffle_partitions, table

WEIGHTS = (5.0, 2.0, 1.0)
BUDGET = 1.5
MOST = 2
SEED = 42
#: Words that are left to the dynamic programme, of which it fits what whole documents can.
SPAN = 1 << 14
#: Steps of the programme between two states that are kept; those between are computed again.
KEPT = 64
#: Bits of the seeded hash in one range: only the ranges where a length's quota ends are looked into.
RANGE_BITS = 10
WORD = r"[^\x20\x09-\x0D]+"


def reachable(lengths: np.ndarray, counts: np.ndarray, budget: int) -> dict[int, int]:
    """Bounded knapsack: how many of each length to take for the sum nearest to ``budget``, not above it."""
    own = [(n, min(many, budget // n)) for n, many in zip(lengths.tolist(), counts.tolist(), strict=True) if 0 < n <= budget and many > 0]
    unit = int(np.gcd.reduce([n for n, _ in own])) if own else 1
    budget //= unit
    mask = (1 << (budget + 1)) - 1
    reach, steps, kept = 1, [], {0: 1}
    for n, many in own:
        size = 1
        while many > 0 and not reach >> budget & 1:
            size = min(size, many)
            steps.append((n, size))
            reach |= (reach << (n // unit * size)) & mask
            if len(steps) % KEPT == 0:
                kept[len(steps)] = reach
            many -= size
            size *= 2
    at, taken = reach.bit_length() - 1, {}
    for begin in range((len(steps) - 1) // KEPT * KEPT, -1, -KEPT):
        part = steps[begin : begin + KEPT]
        before = [kept[begin]]
        for n, size in part[:-1]:
            before.append(before[-1] | (before[-1] << (n // unit * size)) & mask)
        for (n, size), old in zip(reversed(part), reversed(before), strict=True):
            if not old >> at & 1:
                at -= n // unit * size
                taken[n] = taken.get(n, 0) + size
    return taken


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: float, span: int = SPAN) -> np.ndarray:
    """Documents to take of each length so that their words come nearest to ``budget``.

    ``span`` words or more are left to the programme where documents are short enough; where they are longer, it spans
    what the longest makes it.
    """
    total = int((lengths * counts).sum())
    whole = int(round(min(max(budget, 0.0), total)))
    if whole == 0:
        return np.zeros(len(lengths), dtype=np.int64)
    if 2 * whole > total:  # fewer documents are left out than taken: those are fitted
        return counts - fit_lengths(lengths, counts, total - whole, span)
    share = counts * (whole / total)
    take = np.minimum(counts, np.floor(share).astype(np.int64))
    rest = whole - int((take * lengths).sum())
    mixed = np.random.default_rng(SEED).permutation(len(lengths))  # among equals, and where the programme stops early, no length comes first
    for i in mixed[np.argsort((take - share)[mixed], kind="stable")]:
        if take[i] < counts[i] and 0 < lengths[i] <= rest - span:
            take[i] += 1
            rest -= int(lengths[i])
    found = reachable(lengths[mixed], (counts - take)[mixed], rest)
    for i, n in enumerate(lengths.tolist()):
        take[i] += found.get(n, 0)
    return take


def numbered(sources: DataFrame) -> DataFrame:
    """Adds ``place``, from 0 by code point with null last: sampled ranges are sorted one by one, none sees all sources."""
    spark = sources.sparkSession
    rows = sources.withColumn("sn", F.col("source").isNull()).repartitionByRange(shuffle_partitions(spark), "sn", "source")
    rows = settle(rows.withColumn("part", F.spark_partition_id()), "sources")
    sizes = sorted(tuple(r) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a range
    before = dict(zip([p for p, _ in sizes], np.cumsum([0] + [n for _, n in sizes]).tolist(), strict=False))
    offsets = F.create_map(*[F.lit(x).cast("long") for p, n in before.items() for x in (p, n)]) if before else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("sn", "source")) - 1
    return rows.withColumn("place", offsets[F.col("part").cast("long")] + within).drop("part", "sn")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size): shares of budget x all words by weight, none above most x its size.

    Weights repeat over the sources by code point, null last. The excess above a cap is shared again by weight: a
    common level per unit of weight rises until the sources that it does not fill are the same as before. Sums are of whole numbers, so they
    are exact in any order.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod("place", F.lit(len(weights))).cast("int") + 1)
    rows = settle(numbered(sources).withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double")), "shares")
    words = (rows.agg(F.sum("source_size")).first()[0] or 0) * budget
    level, before = 0.0, -1
    while True:
        full = F.col("cap") < F.lit(level) * F.col("w")
        capped, cap, weight = rows.agg(F.count_if(full), F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        if not weight or capped == before:
            break
        level, before = (words - (cap or 0.0)) / weight, capped
    target = F.least("cap", F.lit(level) * F.col("w")) if weight else F.col("cap")
    return rows.withColumn("target", target).drop("place", "w", "cap")


def _fit_source(most: int):
    def run(hist: pd.DataFrame) -> pd.DataFrame:
        hist = hist.sort_values("size")
        total = int((hist["size"] * hist["n"]).sum())
        target = float(hist["target"].iloc[0])
        passes = min(most, int(target // total)) if total else 0
        lengths, counts = hist["size"].to_numpy(np.int64), hist["n"].to_numpy(np.int64)
        take = fit_lengths(lengths, counts, target - passes * total) if passes < most else np.zeros(len(hist), np.int64)
        return pd.DataFrame({"sk": hist["sk"], "sn": hist["sn"], "size": lengths, "passes": passes, "take": take})

    return run


def _quotas(cells: DataFrame, keys: list[str], cell: str) -> DataFrame:
    """cells (keys, cell, n, want): adds ``quota``, the documents of a cell that are taken, cells of a key in order."""
    below = F.sum("n").over(Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1))
    return cells.withColumn("quota", F.least(F.greatest(F.col("want") - F.coalesce(below, F.lit(0)), F.lit(0)), F.col("n"))).drop("want")


#: Whether a cell is taken whole or not at all, or its quota ends inside.
WHOLE = "quota = 0 OR quota = n"
PART = "quota > 0 AND quota < n"


def _first(rows: DataFrame, keys: list[str], cells: list[str]) -> DataFrame:
    """Adds ``extra`` to rows (keys, want, cells): 1 for the first ``want`` rows of a key by the cells, 0 for others.

    Each level counts its cells and looks further only into the cell where the quota ends, so no task ranks a key's rows.
    """
    done = None
    for cell in cells:
        counted = _quotas(rows.groupBy(*keys, cell, "want").agg(F.count("*").alias("n")), keys, cell)
        met = settle(rows.drop("want").join(counted, [*keys, cell]), "cells")
        keys = [*keys, cell]
        part = met.filter(WHOLE).withColumn("extra", (F.col("quota") > 0).cast("long")).drop("quota", "n")
        done = part if done is None else done.unionByName(part)
        rows = met.filter(PART).withColumnRenamed("quota", "want").drop("n")
        if rows.isEmpty():
            return done
    # Only equal rows of one salt are left, which are interchangeable.
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(cells[-1]))
    return done.unionByName(rows.withColumn("extra", (rank <= F.col("want")).cast("long")).drop("want"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    budget: float = BUDGET,
    most: int = MOST,
    seed: int = SEED,
    *,
    keep_text: bool = False,
) -> DataFrame:
    """How often the mix takes each document: row (a struct of all columns, but the text unless ``keep_text``), size,
    source_size, target, copies, taken.

    Size is the number of words in the text (null: 0). A null source is a source, the last one. Documents of one
    length are taken in order of a seeded hash of id and text; rows that repeat an id, or have none, are separate
    documents, and rows that repeat both are interchangeable. Documents without words are never taken; very long texts
    are counted whole. An empty table gives an empty result. Other columns are carried unread. Reruns agree.
    """
    need(docs, "doc_id", "text", "source")
    draw = F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), F.col("doc_id"), F.col("text"))
    sizes = settle(
        docs.select(
            carried(docs, *(() if keep_text else ("text",))),
            F.coalesce(F.col("source"), F.lit("")).alias("sk"),
            F.col("source").isNull().alias("sn"),
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            draw.alias("draw"),
            F.shiftrightunsigned(draw, 64 - RANGE_BITS).cast("int").alias("range"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "sizes",
    )
    slim = sizes.select("number", "sk", "sn", "size", "draw", "range", F.pmod("number", F.lit(1 << RANGE_BITS)).cast("int").alias("salt"))
    ranges = settle(sizes.groupBy("sk", "sn", "size", "range").agg(F.count("*").alias("n")), "lengths")
    hist = ranges.groupBy("sk", "sn", "size").agg(F.sum("n").alias("n"))
    sources = hist.groupBy("sk", "sn").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = targets(sources.select(F.when(~F.col("sn"), F.col("sk")).alias("source"), "source_size"), weights, budget, most)
    goal = goal.select(F.coalesce("source", F.lit("")).alias("sk"), F.col("source").isNull().alias("sn"), "source_size", "target")
    fitted = (
        hist.join(goal.select("sk", "sn", "target"), ["sk", "sn"])
        .groupBy("sk", "sn")
        .applyInPandas(_fit_source(most), "sk string, sn boolean, size long, passes long, take long")
    )
    key = ["sk", "sn", "size"]
    plan = _quotas(ranges.join(fitted.withColumnRenamed("take", "want"), key), key, "range")
    plan = settle(plan.join(goal, ["sk", "sn"]), "mix-plan")
    met = slim.join(plan, [*key, "range"])
    sure = met.filter(WHOLE).withColumn("extra", (F.col("quota") > 0).cast("long")).drop("quota", "n")
    open_ = settle(met.filter(PART).withColumnRenamed("quota", "want").drop("n"), "mix-open")
    finer = open_.withColumn("next", F.shiftrightunsigned(F.shiftleft("draw", RANGE_BITS), 64 - RANGE_BITS).cast("int"))
    ranked = _first(finer, [*key, "range"], ["next", "draw", "salt"]).drop("next")
    copies = F.when(F.col("size") > 0, F.col("passes") + F.col("extra")).otherwise(F.lit(0)).cast("long")
    told = sure.unionByName(ranked).select("number", "source_size", "target", copies.alias("copies"))
    # The documents move once, to what was told of them by number.
    return sizes.select("number", "row", "size").join(told, "number").select("row", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken")
