import hashlib
import re

import numpy as np
import pyarrow.parquet as pq

from siftline.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        if item is None or text is None:
            continue
        w = WORD.findall(lower(text))
        for i in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = WORD.findall(lower(text))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= own
        ids = ",".join(sorted(found))
        out.append((str(doc), len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out)


def tables(spark):
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(30)] + ["ÉTÉ", "x-y", "It's"]
    items = [(i, " ".join(rng.choice(words, int(rng.integers(1, 25))))) for i in range(25)]
    items += [(90, None), (None, "w1 w2 w3"), (91, ""), (92, "..."), (7, "another text of an item that is there twice over now"), (93, "w1")]
    docs = []
    for i in range(60):
        parts = list(rng.choice(words, int(rng.integers(0, 60))))
        if i % 3 == 0:
            own = items[i % 25][1].upper().split()
            parts[5:5] = own[: len(own) - (i % 2)]
        docs.append((i, ", ".join(parts)))
    docs += [(100, None), (101, ""), (None, docs[0][1]), (0, docs[0][1]), (102, "w2 " * 60_000 + items[2][1])]
    return docs, items


def frames(spark, docs, items):
    a = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, hits string, n_words int")
    return a.repartition(3), spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")


def test_report_matches_brute_force_in_one_block_or_many(spark, monkeypatch):
    docs, items = tables(spark)
    a, b = frames(spark, docs, items)
    want = brute(docs, items)
    key = lambda f: sorted((str(r[0]), *r[1:]) for r in f.collect())
    assert key(d.report(a, b)) == want
    stored = []
    real = d.settle
    monkeypatch.setattr(d, "settle", lambda df, what: stored.append((what, df.columns)) or real(df, what))
    monkeypatch.setattr(d.find_items, "__defaults__", (d.WINDOW, None, 200, 1000))
    assert key(d.report(a, b)) == want
    # Many blocks, and none of them writes postings or rows of documents again.
    assert [w for w, _ in stored][:2] == ["index", "windows"] and {w for w, _ in stored[2:]} == {"found"} and len(stored) > 4
    assert all(c == ["segment", "at", "hits", "items"] for w, c in stored if w == "found")
    assert any(r[5] for r in want) and not all(r[5] for r in want)


def test_clean_documents_keep_their_columns(spark):
    docs, items = tables(spark)
    a, b = frames(spark, docs, items)
    kept = d.decontaminate(a, b)
    assert kept.columns == a.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(r[0] for r in brute(docs, items) if not r[5])


def test_proximity(spark):
    rows = [(1, "b a x c d e f g h i j"), (2, "a b c d e f g h i x x x x j"), (3, "a b c d e f g h i j")]
    a, b = frames(spark, rows, [(1, "a b c d e f g h i j")])
    got = {r.doc_id: (r.n_hit, list(r["items"])) for r in d.find_items(a, b, slop=2).collect()}
    assert got == {1: (0, ["1"]), 2: (0, []), 3: (10, ["1"])}


def test_empty_tables(spark):
    docs, items = tables(spark)
    a, b = frames(spark, docs, items)
    assert d.report(a.filter("false"), b).collect() == []
    assert not any(r.contaminated for r in d.report(a, b.filter("false")).collect())


def brute_near(words, window, slop):
    """Whether some run of len(window) + slop words holds the window's words with their multiplicity."""
    span = len(window) + slop
    runs = [words[i : i + span] for i in range(max(1, len(words) - span + 1))]
    return any(all(r.count(w) >= window.count(w) for w in window) for r in runs)


def test_proximity_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(names, int(rng.integers(0, 40))))) for i in range(40)] + [(90, None)]
    items = [(i, " ".join(rng.choice(names, int(rng.integers(2, 7))))) for i in range(12)]
    a, b = frames(spark, docs, items)
    got = {r.doc_id: list(r["items"]) for r in d.find_items(a, b, 4, slop=3).collect()}
    for doc, text in docs:
        words = (text or "").split()
        want = []
        for item, t in items:
            w = t.split()
            windows = [w[i : i + 4] for i in range(max(1, len(w) - 3))]
            if any(brute_near(words, x, 3) for x in windows):
                want.append(str(item))
        assert got[doc] == sorted(want)


def test_stored_segments_answer_any_test_set(spark):
    docs, items = tables(spark)
    a, b = frames(spark, docs, items)
    index = d.build_index(a, slice_bytes=500)
    assert index.count() > 3
    for half in (b.filter("item_id < 10"), b):
        got = sorted((str(r["row"]["doc_id"]), r.n_words, r.n_hit) for r in d.search_index(index, half).collect())
        assert got == [w[:3] for w in brute(docs, [tuple(r)[:2] for r in half.collect()])]


def test_columns_of_any_name_come_back(spark):
    docs = spark.createDataFrame([(1, "a b c", 5, "x", 7), (None, "one two three", 6, "y", 8)], "doc_id long, text string, k int, `a.b` string, size int")
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    assert [tuple(r) for r in d.decontaminate(docs, items).collect()] == [(1, "a b c", 5, "x", 7)]


def test_stored_segments_are_read_a_few_at_a_time(spark):
    """A reader decodes a row group at once: a task's segments, texts with them, are many groups, not one."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"{x:x}" for x in rng.integers(1 << 60, size=60_000).tolist())) for i in range(24)]
    index = d.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), True, 1 << 20)
    groups = [m.row_group(k) for f in index.inputFiles() for m in [pq.read_metadata(f.removeprefix("file://"))] for k in range(m.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 24 and max(g.total_byte_size for g in groups) < 16 << 20
