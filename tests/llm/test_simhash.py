import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from siftline.llm import simhash
from siftline.llm.bktree import BKForest
from siftline.llm.components import components

SCHEMA = "doc_id long, text string, fp string, component_id int"


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    least = {x: min((d for (d, _), y in zip(rows, label) if y == x and d is not None), default=None) for x in label}
    return sorted((str(d), f"{p:016x}", least[x]) for (d, _), p, x in zip(rows, prints, label))


def rows_of(spark, rows):
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    found = simhash.near_duplicates(docs).select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("p"), "component_id")
    return sorted((str(r[0]), r[1], r[2]) for r in found.collect())


def test_near_duplicates_match_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = rng.choice(vocabulary, 120).tolist()
        rows.append((1000 - i, " ".join(base)))
        for k in range(3):
            copy = list(base)
            copy[int(rng.integers(120))] = f"x{k}"
            rows.append((i * 5 + k, " ".join(copy)))
    rows += [(7777, None), (7778, ""), (7779, " \t\n"), (None, "only"), (7780, "ONLY"), (7780, "only"), (9, "a b"), (9, "a b")]
    rows.append((8000, "long " * 50_000))
    got = rows_of(spark, rows)
    assert got == brute(rows)
    assert len({r[2] for r in got}) < len(rows) - 20


def test_empty_table(spark):
    assert rows_of(spark, []) == []


def test_null_ids_only(spark):
    assert rows_of(spark, [(None, "same text here"), (None, "same text here")]) == brute([(None, "same text here")] * 2)


def test_forest_finds_all_pairs():
    rng = np.random.default_rng(2)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64)) for c in centres]))
    shards = np.arange(len(prints)) % 3
    found = {(int(a), int(b)) for x, y in BKForest(prints, shards).within(2) for a, b in zip(x, y)}
    want = {
        (j, i)
        for i, j in itertools.combinations(range(len(prints)), 2)
        if shards[i] == shards[j] and int(prints[i] ^ prints[j]).bit_count() <= 2
    }
    assert found == want and want


def test_pairs_of_blocks_cover_every_link():
    masks = simhash.blocks(2)
    assert len(masks) == 6
    for bits in itertools.combinations(range(64), 2):
        changed = sum(1 << b for b in bits)
        assert any(changed & m == 0 for m in masks)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 9), (9, 7)], "a long, b long")
    labels = {r.node: r.label for r in components(edges).collect()}
    assert labels == {i: 100 for i in range(100, 161)} | {7: 7, 9: 7}


@pytest.mark.parametrize("radius", [2, 3])
def test_dense_shards_are_parted_until_they_are_small(spark, radius):
    """Fingerprints that differ in 12 bits only: every first shard holds most of them, and so do many of the second step."""
    rng = np.random.default_rng(31)
    spread = rng.choice(64, 12, replace=False)
    base = int(rng.integers(1 << 62))
    prints = sorted({base ^ sum(1 << int(b) for b, on in zip(spread, rng.random(12) < 0.5, strict=True) if on) for _ in range(900)} | {int(x) for x in rng.integers(1 << 62, size=50)})
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    dealt = simhash._sharded(frame, radius, 40)
    assert max(r["count"] for r in dealt.groupBy("mask", "key").count().collect()) <= 40
    links = simhash.link_fingerprints(frame, radius, forest=100, shard=40)
    label = {p: p for p in prints}
    for r in links.collect():
        a, b = label[r.a], label[r.b]
        if a != b:
            label = {p: min(a, b) if x in (a, b) else x for p, x in label.items()}
    array = np.array(prints, dtype=np.uint64)
    near = np.bitwise_count(array[:, None] ^ array[None]) <= radius
    want = np.arange(len(prints))
    while True:
        least = np.where(near, want[None], len(prints)).min(axis=1)
        if (least == want).all():
            break
        want = least
    groups = {}
    for p, w in zip(prints, want.tolist(), strict=True):
        groups.setdefault(w, set()).add(p)
    got = {}
    for p, x in label.items():
        got.setdefault(x, set()).add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))
