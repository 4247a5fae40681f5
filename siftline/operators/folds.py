"""Folds of whole groups, balanced like a greedy deal, for any number of groups.

The greedy deal takes groups by falling size, each to the lightest fold. Its outcome hangs on the histogram of sizes alone:
groups of one size are interchangeable, so they are numbered by hash, and the folds that a run of equal groups goes to
repeat in cycles, which a few rows for each size describe. Only those, never groups, are worked out on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators.order import hash_bucket, hashed, met, numbered
from siftline.tables import pin


def deal(histogram: list[tuple[int, int]], folds: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """(size, first, last, cycle): the first to last group of a size (from 1) go to the folds of ``cycle`` in turn.

    histogram: (size, groups of that size), sizes falling. Ties go to the first fold.
    """
    loads = [0] * folds
    for size, many in histogram:
        at = 1
        while at <= many:
            line = sorted(range(folds), key=lambda f: (loads[f], f))
            low = loads[line[0]]
            active = [f for f in line if loads[f] < low + size]
            rest = [loads[f] for f in line if loads[f] >= low + size]
            # The active folds take one each, in turn, as long as the last of them still lies below all others.
            turns = (many - at + 1) // len(active)
            if rest:
                turns = min(turns, max(0, (min(rest) - 1 - loads[active[-1]]) // size + 1))
            if turns < 1:
                active, turns = active[:1], 1
            yield size, at, at + turns * len(active) - 1, active
            for f in active:
                loads[f] += turns * size
            at += turns * len(active)


def group_folds(frame: DataFrame, group: str, folds: int = 5, seed: int = 7) -> DataFrame:
    """Adds ``fold``: whole groups, largest first to the lightest fold, equal ones by a seeded hash. NULL is a group; with fewer
    groups than ``folds`` there are as many folds as groups."""
    sizes = pin(frame.groupBy(group).agg(F.count("*").alias("__size")))
    histogram = [(r["__size"], r["n"]) for r in sizes.groupBy("__size").agg(F.count("*").alias("n")).orderBy(F.desc("__size")).collect()]
    k = max(1, min(folds, sum(n for _, n in histogram)))
    rows = list(deal(histogram, k))
    plan = frame.sparkSession.createDataFrame(rows, "__size long, first long, last long, cycle array<int>")
    plan = plan.groupBy("__size").agg(F.collect_list(F.struct("first", "last", "cycle")).alias("plan"))
    placed = numbered(sizes.withColumn("__h", hashed(F.lit(seed), group)), ["__size"], [F.col("__h"), F.col(group)], hash_bucket(F.col("__h")), "__i")
    own = F.get(F.filter("plan", lambda p: (p["first"] <= F.col("__i")) & (F.col("__i") <= p["last"])), F.lit(0))
    dealt = placed.join(plan, "__size").select(F.col(group), F.get(own["cycle"], ((F.col("__i") - own["first"]) % F.size(own["cycle"])).cast("int")).alias("fold"))
    return met(frame, dealt, [group])
