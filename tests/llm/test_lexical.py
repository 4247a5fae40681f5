import math
import random
import re
from collections import Counter

import pyarrow.parquet as pq

from siftline.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(text or "")]


def brute(docs, items, best):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for i, c in held:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 20 * m)) for w in set(terms(text)) if c[w])
            if s > 0:
                scores.append((-s, 2**63 - 1 if i is None else i, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2])[:best])]
    return sorted(out, key=str)


def found(spark, docs, items, best=50, shard_bytes=300, block_bytes=10_000):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, `a.b` string").repartition(3)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, rank int")
    return sorted([tuple(r) for r in lexical.search(lexical.build_index(d, shard_bytes=shard_bytes), q, best, block_bytes).collect()], key=str)


def test_against_the_definition_in_shards_and_blocks(spark):
    rng = random.Random(3)
    vocabulary = ["Alpha", "beta", "GAMMA", "δέλτα", "Σίγμα", "e2", "7", "co-op", "x_y", "naïve", "İ"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=range(len(vocabulary), 0, -1), k=rng.randint(0, 80)))) for i in range(200)]
    items = [(i, ", ".join(rng.choices(vocabulary, k=rng.randint(1, 9)))) for i in range(12)]
    want = brute(docs, items, 10)
    assert found(spark, docs, items, 10) == want
    assert found(spark, docs, items, 10, shard_bytes=1 << 20, block_bytes=40) == want


def test_ties_nulls_repeats_and_long_texts(spark):
    docs = [(i, "same words here") for i in range(90, 10, -1)] + [(5, None), (6, ""), (7, "-- !"), (None, "same words here"), (None, "rare"), (8, "rare"), (8, "rare"), (9, "rare " * 20_000)]
    items = [(1, "SAME"), (1, "same"), (1, "rare"), (1, "rare"), (2, None), (3, ""), (4, "absent"), (None, "here rare"), (5, "words same here")]
    for best in (3, 50, 500):
        assert found(spark, docs, items, best) == brute(docs, [x for x in items if x[1]], best)


def test_empty(spark):
    assert found(spark, [], [(1, "a")]) == []
    assert found(spark, [(1, None)], [(1, "a")]) == []
    assert found(spark, [(1, "a b")], []) == []


def test_terms_of_all_documents_weigh_nothing(spark):
    docs = [(i, "common" if i else "common odd") for i in range(9)]
    assert found(spark, docs, [(1, "common"), (2, "common odd")]) == brute(docs, [(1, "common"), (2, "common odd")], 50)


def test_stored_shards_are_read_a_few_at_a_time(spark):
    """A reader decodes a row group at once: a task's shards are many groups, not one."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.getrandbits(60):x}" for _ in range(60_000))) for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    shards, _ = lexical.build_index(docs, shard_bytes=1 << 20)
    groups = [m.row_group(k) for f in shards.inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 24 and max(g.total_byte_size for g in groups) < 16 << 20
