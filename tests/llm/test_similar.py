import itertools

import numpy as np

from siftline.llm import simhash


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        either = len(sets[i] | sets[j])
        if sets[i] == sets[j] or (either and len(sets[i] & sets[j]) / either >= 0.8):
            old, new = label[j], label[i]
            label = [new if x == old else x for x in label]
    first = {x: min(d for (d, _), y in zip(rows, label) if y == x) for x in label}
    return sorted((d, first[x]) for (d, _), x in zip(rows, label))


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(15)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(60):
        n = int(rng.integers(8, 500))
        base = rng.choice(vocabulary, n).tolist()
        rows.append((i * 10, " ".join(base)))
        for k in range(1, 5):
            copy = list(base)
            for at in rng.integers(0, n, int(rng.integers(0, max(1, n // 40) + 1))):
                copy[at] = f"x{rng.integers(9)}"
            rows.append((i * 10 + k, " ".join(copy)))
    rows += [(5000, None), (5001, ""), (5002, "a b"), (5003, "A  B"), (5004, "a c"), (5005, "long " * 30_000)]
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, same string, n int").repartition(4)
    got = sorted((r.doc, r.first_doc) for r in simhash.similar_documents(docs).collect())
    want = brute(rows)
    assert got == want
    assert sum(a != b for a, b in got) > 60


def test_repeated_rows_and_nothing(spark):
    docs = spark.createDataFrame([(1, "same words here and there again"), (1, "same words here and there again"), (None, "same words here and there again")], "doc_id long, text string")
    assert {(r.first_doc, r["row"]["doc_id"]) for r in simhash.similar_documents(docs).collect()} == {(1, 1), (1, None)}
    assert simhash.similar_documents(docs.filter("false")).collect() == []


def groups_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted((r.doc, r.first_doc) for r in simhash.similar_documents(docs).collect())


def test_copies_linked_by_one_original_only(spark):
    """300 copies are >= 0.8 to the original and < 0.8 to each other; the original is not the least id."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    rows = [(150, " ".join(base))]
    for i in range(300):
        copy = list(base)
        for k, at in enumerate(rng.choice(39, 4, replace=False)):
            copy[5 * at + 2] = f"x{i}_{k}"
        rows.append((i + (i >= 150), " ".join(copy)))
    got = groups_of(spark, rows)
    assert got == brute(rows)
    assert {f for _, f in got} == {0}


def test_groups_without_a_centre(spark):
    """Windows that slide over one long text: each is near to its neighbours only, and ids say nothing of the order."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(4000)]
    ids = rng.permutation(250).tolist()
    rows = [(d, " ".join(words[15 * k : 15 * k + 200])) for k, d in enumerate(ids)]
    got = groups_of(spark, rows)
    assert got == brute(rows)
    assert {f for _, f in got} == {0}


def test_prefix_join_misses_no_pair(spark):
    rng = np.random.default_rng(8)
    sets = []
    for i in range(40):
        base = rng.choice(2000, int(rng.integers(1, 80)), replace=False)
        for _ in range(int(rng.integers(1, 12))):
            sets.append(np.unique(np.where(rng.random(len(base)) < 0.1, rng.integers(2000, 2050, len(base)), base)).astype(np.uint64))
    token, many = np.unique(np.concatenate(sets), return_counts=True)
    common = token[many > 5], many[many > 5]
    old, simhash.BLOCK = simhash.BLOCK, 3
    try:
        rows = [(int(t), i, i, len(s) << 32 | p, *simhash.parity_bitmap(s).tolist()) for i, s in enumerate(sets) for p, t in enumerate(simhash.prefix(s, common, 0.8), 1)]
        frame = spark.createDataFrame(rows, simhash.HEAD)
        got = {(r.a, r.b) for r in simhash._prefix_pairs(frame, 0.8).collect()}
    finally:
        simhash.BLOCK = old
    near = lambda x, y: (both := len(np.intersect1d(x, y))) >= 0.8 * (len(x) + len(y) - both)
    want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if near(sets[i], sets[j])}
    assert want <= got and len(want) > 20
    assert all(a < b for a, b in got)


def test_pairs_at_the_border_are_all_found(spark):
    """Many pairs just above 0.8, of any size: the classes of shingles miss none."""
    rng = np.random.default_rng(21)
    rows = []
    for i in range(400):
        n = int(rng.integers(12, 600))
        base = [f"v{i}_{x}" for x in range(n)]
        copy = list(base)
        for at in rng.choice(n, max(1, n // 46), replace=False):
            copy[at] = "x"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    got = groups_of(spark, rows)
    want = []
    for (d, x), (e, y) in zip(rows[::2], rows[1::2]):
        x, y = shingles(x), shingles(y)
        want += [(d, d), (e, d if len(x & y) >= 0.8 * len(x | y) else e)]
    assert got == want
    assert sum(d != f for d, f in want) > 150


def test_unlike_texts_without_id_or_of_one_id_stay_apart(spark):
    texts = [f"text number {i} has words that no other text of them has {i * 7} {i * 13}" for i in range(50)]
    rows = [(None, t, 1, "a", 2) for t in texts] + [(7, t + " at all but", 1, "a", 2) for t in texts[:5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, doc int, `a.b` string, m1 int")
    got = simhash.similar_documents(docs).collect()
    assert len({(r.first_doc, r.first_m1, r.first_m2) for r in got}) == 55
    assert {tuple(r["row"])[1:] for r in got} == {(1, "a", 2)}


def test_a_template_family_of_unlike_labels_is_not_copied(spark, monkeypatch):
    """Texts that share 85 of 100 shingles reach a similarity of 0.74: at 0.8 no two of them can be links, however many share a shingle."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    template = " ".join(f"common{i}" for i in range(89))
    texts = [(i, i, template + " " + " ".join(f"own{i}x{j}" for j in range(15))) for i in range(400)]
    frame = spark.createDataFrame(texts, "short long, label long, text string")
    common = simhash.common_shingles(frame, 5)
    heads = frame.mapInArrow(simhash._heads(5, 0.8, common), simhash.HEAD).cache()
    assert heads.groupBy("token").count().filter("count > 300").count() > 0
    assert simhash._cells(heads, 0.8).count() < heads.count()
    assert simhash._prefix_pairs(heads, 0.8).count() == 0
    # At 0.7 all pairs are links, and all are found, block by block.
    some = frame.filter("short < 60")
    assert simhash._prefix_pairs(some.mapInArrow(simhash._heads(5, 0.7, simhash.common_shingles(some, 5)), simhash.HEAD), 0.7).count() == 60 * 59 // 2
