import hashlib
import re
from collections import defaultdict

import numpy as np

from siftline.llm import line_dedup as ld


def key_of(line):
    k = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)


def rank(doc):
    return -(10**9) if doc is None else doc


def brute(rows, min_docs=5):
    holders = defaultdict(list)
    for doc, text in rows:
        for k in {key_of(x) for x in (text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(rank(doc))
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if not (len(k := key_of(x)) >= 40 and len(holders[k]) >= min_docs and rank(doc) < max(holders[k]))]
        out.append((str(doc), len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    return sorted(out)


def found(spark, rows, **k):
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, gone int, kept string").repartition(3)
    got = ld.dedup_lines(frame, digest=True, **k).collect()
    return sorted((str(r["row"]["doc_id"]), r.n_lines, r.n_dropped, r.kept) for r in got)


def corpus():
    rng = np.random.default_rng(22)
    pool = ["A line that is long enough to count as one, number %d." % i for i in range(12)] + ["short line", "é" * 39, "é" * 40, "x" * 39 + " "]
    rows = []
    for i in range(50):
        lines = [f"own line {i}, {j} with more than forty characters in it" if rng.random() < 0.3 else "  " * int(rng.integers(3)) + (p.upper() if rng.random() < 0.3 else p) + "\t\r" for j, p in enumerate(rng.choice(pool, int(rng.integers(1, 12))))]
        rows.append((int(i * 7 % 50), "\n".join(lines)))
    return rows + [(900, None), (901, ""), (902, "\n\n"), (None, rows[1][1]), (3, rows[2][1]), (3, rows[2][1]), (903, (rows[0][1] + "\n") * 3000)]


def test_matches_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert found(spark, rows) == want and sum(r[2] for r in want) > 50
    assert found(spark, rows, batches=9) == want
    assert found(spark, []) == []
    nobody = [(None, "only rows without an id hold this line, all of them keep it")] * 6
    assert found(spark, nobody) == brute(nobody)


def test_runs_are_levelled_and_hold_a_line_once(spark):
    index = ld.LineRuns(spark, fanout=2)
    rows = [r for r in corpus() if r[0] is not None]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = ld.line_hashes(frame)
    for b in range(5):
        index.ingest(hashes.filter(f"doc_id % 5 = {b}"))
        lines = [(r.h1, r.h2) for run in index.runs() for r in run.filter("not known").collect()]
        assert len(lines) == len(set(lines)) == hashes.filter(f"doc_id % 5 <= {b}").select("h1", "h2").distinct().count()
    assert [len(level) for level in index.levels] == [1, 0, 1] and len(index.changes) == 1
    assert index.unseen(hashes).count() == 0
    other = ld.line_hashes(spark.createDataFrame([(1, "a new line that no run has seen so far, long enough")], "doc_id long, text string"))
    assert index.unseen(other.unionByName(hashes)).count() == 1
    for least in (1, 2, 5, 30):
        want = hashes.groupBy("h1", "h2").agg({"doc_id": "max", "*": "count"}).collect()
        assert {tuple(r) for r in index.frequent(least).collect()} == {(r[0], r[1], r["max(doc_id)"]) for r in want if r["count(1)"] >= least}
    index.close()
    assert not [d for d in spark.catalog.listDatabases() if d.name.startswith("siftline_")]


def test_result_hangs_on_the_anti_join(spark, monkeypatch):
    """With runs that never tell a line apart, or always do, the counts of a line fall to pieces."""
    rows = corpus()
    for told in ("false", "true"):
        real = ld.LineRuns._write
        with monkeypatch.context() as m:
            m.setattr(ld.LineRuns, "_write", lambda self, rows, level, told=told: real(self, rows.selectExpr("h1", "h2", "n_docs", "max_doc", f"{told} as known"), level))
            assert found(spark, rows, batches=3) != brute(rows)
    assert not [d for d in spark.catalog.listDatabases() if d.name.startswith("siftline_")]
