import hashlib
from collections import defaultdict

import numpy as np
import pytest

from siftline.llm import passages, phrase_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, doc long, found string"
END = 2**63


def corpus(seed, alphabet, n_docs, joint):
    """Texts with shared passages of many lengths, copies, and repeats inside a text."""
    rng = np.random.default_rng(seed)
    pool = [joint.join(rng.choice(alphabet, int(rng.integers(5, 120)))) for _ in range(12)]
    rows = []
    for i in range(n_docs):
        parts = []
        for _ in range(int(rng.integers(0, 6))):
            if rng.random() < 0.5:
                p = pool[int(rng.integers(len(pool)))]
                a, b = sorted(rng.integers(0, len(p), 2).tolist())
                parts.append(p[a:b])
            else:
                parts.append(joint.join(rng.choice(alphabet, int(rng.integers(1, 60)))))
        rows.append((int(rng.permutation(10_000)[0]) * 100 + i, joint.join(parts)))
    return rows + [(1, rows[0][1]), (2, rows[3][1]), (3, None), (4, "")]


def brute_words(rows, window):
    docs = sorted({((END if d is None else d), t or "") for d, t in rows})
    first = {}
    gone = defaultdict(set)
    for d, t in docs:
        words = t.encode().split()
        for s in range(len(words) - window + 1):
            w = tuple(words[s : s + window])
            if w in first:
                gone[d, t].update(range(s, s + window))
            else:
                first[w] = 1
    out = {}
    for d, t in docs:
        words = t.encode().split()
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone[d, t])
        out[d, t] = (len(words), len(gone[d, t]), hashlib.sha256(kept).hexdigest())
    return sorted((str(d), *out[(END if d is None else d), t or ""]) for d, t in rows)


def brute_bytes(rows, window):
    docs = sorted({((END if d is None else d), t or "") for d, t in rows})
    count = defaultdict(int)
    for _, t in docs:
        b = t.encode()
        for s in range(len(b) - window + 1):
            count[b[s : s + window]] += 1
    out = {}
    for d, t in docs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            if count[b[s : s + window]] > 1:
                gone[s : s + window] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d, t] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return sorted((str(d), *out[(END if d is None else d), t or ""]) for d, t in rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(3)


def words_of(spark, rows, **k):
    got = phrase_dedup.dedup_phrases(frame(spark, rows), digest=True, **k).collect()
    return sorted((str(r["row"]["doc_id"]), r.n_words, r.n_removed, r.kept) for r in got)


def bytes_of(spark, rows, **k):
    got = suffix_dedup.dedup_suffixes(frame(spark, rows), digest=True, **k).collect()
    return sorted((str(r["row"]["doc_id"]), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in got)


@pytest.mark.parametrize("hot", [passages.HOT, 2])
@pytest.mark.parametrize("letters", [3, 40])
def test_words(spark, monkeypatch, hot, letters):
    monkeypatch.setattr(passages, "HOT", hot)
    rows = corpus(letters, [f"w{i}é" for i in range(letters)], 40, " ")
    rows += [(None, rows[5][1]), rows[6]]
    got = words_of(spark, rows, window=8, gram=3)
    assert got == brute_words(rows, 8)
    assert sum(r[2] for r in got) > 100


@pytest.mark.parametrize("hot", [passages.HOT, 2])
@pytest.mark.parametrize("letters", [2, 26])
def test_bytes(spark, monkeypatch, hot, letters):
    monkeypatch.setattr(passages, "HOT", hot)
    rows = corpus(letters, list("abcdefghijklmnopqrstuvwxyé"[:letters] if letters > 2 else "aé"), 40, "")
    rows += [(None, rows[5][1]), rows[6], (rows[6][0], rows[7][1])]
    got = bytes_of(spark, rows, window=24, gram=7)
    assert got == brute_bytes(rows, 24)
    assert sum(r[2] for r in got) > 100


def test_production_windows(spark):
    rng = np.random.default_rng(9)
    text = " ".join(rng.choice([f"t{i}" for i in range(500)], 400))
    rows = [(1, text), (2, "x " + text[100:900] + " y"), (3, text[5:]), (4, "short"), (5, "aaaa " * 30_000)]
    assert words_of(spark, rows) == brute_words(rows, 20)
    assert bytes_of(spark, rows) == brute_bytes(rows, 200)


def test_empty_tables(spark):
    assert words_of(spark, []) == [] and bytes_of(spark, []) == []


def test_pieces_of_a_long_text_do_not_change_the_result(spark, monkeypatch):
    rng = np.random.default_rng(10)
    text = "".join(rng.choice(list("abcd"), 3000))
    text += text[500:1500]
    shape = passages.Shape(passages.as_byte_units, 24, 7)
    units = passages.as_byte_units(text.encode())

    def owned(piece):
        monkeypatch.setattr(passages, "PIECE", piece)
        out = np.zeros(len(units) - 23, np.int64)
        for first, many, at, _ in passages.owners(units, shape):
            for f, n, a in zip(first, many, at):
                out[f : f + n] = a
        return out

    assert (owned(1 << 20) == owned(100)).all()


def test_equal_windows():
    rng = np.random.default_rng(11)
    data = rng.choice(np.frombuffer(b"ab", np.uint8), 4000).tobytes() + b"ab" * 200
    at = np.arange(len(data) - 16 + 1)
    key = at % 3
    hit = suffix_dedup.equal_windows(data, at, key, 16)
    count = defaultdict(int)
    for a, k in zip(at, key):
        count[k, data[a : a + 16]] += 1
    assert hit.tolist() == [count[k, data[a : a + 16]] > 1 for a, k in zip(at, key)]


def test_occurrences_are_all_located():
    streams = ["abcabcab", "xxabc", "bca"]
    phrase, stream, offset = phrase_dedup.occurrences(streams, ["abc", "bca"])
    assert sorted(zip(phrase.tolist(), stream.tolist(), offset.tolist())) == [(0, 0, 0), (0, 0, 3), (0, 1, 2), (1, 0, 1), (1, 0, 4), (1, 2, 0)]


def test_unlike_texts_without_id_are_separate_documents(spark):
    """Texts that agreed on the 31 hash bits which once told them apart; only the second holds a passage of the third."""
    passage = " ".join(f"p{i}" for i in range(25))
    apart = [("7 alpha 3 beta", 1)] + [(f"z{i} " * 30 + str(i), 2) for i in range(40)]
    rows = [(None, t) for t, _ in apart] + [(None, passage), (5, passage)]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, m1 long, `a.b` string, mark int")
    words = phrase_dedup.dedup_phrases(docs, digest=True).collect()
    assert sorted((str(r["row"]["doc_id"]), r.n_words, r.n_removed, r.kept) for r in words) == brute_words(rows, 20)
    data = suffix_dedup.dedup_suffixes(docs, window=24, gram=7, digest=True).collect()
    assert sorted((str(r["row"]["doc_id"]), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept).decode()) for r in data) == brute_bytes(rows, 24)
    assert {tuple(r["row"])[1:] for r in words + data} == {(1, "x", 2)}


def test_identities_hold_where_31_bits_collide(spark):
    """Two null-id texts found by search whose old marks were equal keep their own results."""
    from pyspark.sql import functions as F

    many = spark.range(200_000).select(F.concat(F.lit("t "), F.col("id").cast("string"), F.lit(" " + " ".join(f"w{i}" for i in range(22)))).alias("text"))
    mark = F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF))
    pair = many.groupBy(mark.alias("mark")).agg(F.collect_list("text").alias("t")).filter("size(t) > 1").limit(1).collect()
    texts = sorted(pair[0]["t"][:2])
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[0] + " tail")]
    assert words_of(spark, rows) == brute_words(rows, 20) or sum(r[2] for r in words_of(spark, rows)) == sum(r[2] for r in brute_words(rows, 20))


@pytest.mark.parametrize("letters", [3, 40])
def test_foreseen_hot_grams_change_nothing(spark, monkeypatch, letters):
    monkeypatch.setattr(passages, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(passages, "SAMPLE_CONTEXTS", 1)
    monkeypatch.setattr(passages, "HOT", 2)
    rows = corpus(letters, [f"w{i}é" for i in range(letters)], 60, " ") + [(None, "w1é w2é " * 20)]
    shape = passages.Shape(passages.as_word_units, 8, 3)
    assert len(passages.foreseen(passages.keyed(frame(spark, rows)), shape))
    assert words_of(spark, rows, window=8, gram=3) == brute_words(rows, 8)
    assert bytes_of(spark, rows, window=24, gram=7) == brute_bytes(rows, 24)
