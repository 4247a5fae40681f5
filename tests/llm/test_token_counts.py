import numpy as np
import pytest

from siftline.llm import token_counts as tc


@pytest.fixture(scope="module")
def count():
    return tc.Counter()


def full(text, count):
    return len(count.encoder.encode_ordinary(text))


PIECES = ["the ", "cat's", "'re", "  ", "\n\n", " \t x", "12345", "é日本", "!!", " don't", "'", " 'll", "   y", "a" * 30, "", " ", " ", "😀"]


def random_text(rng, n):
    return "".join(PIECES[i] for i in rng.integers(0, len(PIECES), n))


def test_edits_equal_full_counts(count):
    rng = np.random.default_rng(12)
    for size in (0, 1, 5, 40, 400, 3000):
        for _ in range(12):
            text = random_text(rng, size)
            tree = tc.CountTree(text, count)
            assert tree.tokens == full(text, count)
            for _ in range(15):
                a, b = sorted(rng.integers(0, len(text) + 1, 2).tolist())
                if rng.random() < 0.8:
                    b = min(b, a + int(rng.integers(0, 12)))
                new = random_text(rng, int(rng.integers(0, 6)))
                text = text[:a] + new + text[b:]
                tree.edit(a, b, new)
                assert tree.text == text and tree.tokens == full(text, count), (a, b, new)


def test_long_pieces(count):
    rng = np.random.default_rng(14)
    for letters in ("x", "ab", "thequickbrown", "é日a"):
        piece = "".join(rng.choice(list(letters), 2500))
        assert tc.merged_count(piece.encode(), count.ranks) == len(count.encoder._encode_single_piece(piece))
    assert 0 < count("x" * 300_000) < 300_000


def test_only_the_region_is_encoded(count):
    text = "some words in a row, again and again. " * 5000
    tree = tc.CountTree(text, count)
    tree.edit(90_000, 90_003, "new text here")
    assert tree.encoded < 12
    assert tree.tokens == full(tree.text, count)
    with pytest.raises(ValueError):
        tree.edit(5, 10**9, "")


def test_counts_of_a_table(spark, count):
    texts = [None, "", "mail bob@example.org now", "call +1 (389) 555-5010 or 4111 1111 1111 1111!", "plain", "x" * 3_000]
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)] + [(None, texts[2], 1, "c"), (2, texts[2], 1, "c")], "doc_id long, text string, n_tokens int, edits string")
    got = tc.count_tokens(docs).collect()
    assert len(got) == 8
    for r in got:
        text = texts[2 if r["row"]["doc_id"] is None else r["row"]["doc_id"]] or ""
        after = tc.apply_edits(text, tc.redactions(text))
        assert (r.n_chars, r.n_tokens) == (len(text), full(text, count))
        assert (r.n_chars_after, r.n_tokens_after) == (len(after), full(after, count))
    assert sum(r.n_edits for r in got) == 5
    assert tc.count_tokens(docs.filter("false")).collect() == []


def test_given_edits(spark, count):
    rows = [(1, "one two three", [(4, 7, "2"), (0, 3, None)]), (2, "one", None), (3, None, [(0, 0, "new words")])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, e array<struct<start:long,stop:long,new:string>>")
    got = {r["row"]["doc_id"]: r for r in tc.count_tokens(docs, edits="e").collect()}
    assert got[1].n_tokens_after == full(" 2 three", count) and got[1].n_edits == 2
    assert got[2].n_tokens == got[2].n_tokens_after == full("one", count)
    assert got[3].n_tokens_after == full("new words", count)


def test_stored_trees_take_edits_again_and_again(spark, count):
    rng = np.random.default_rng(31)
    texts = {i: random_text(rng, int(rng.integers(0, 900))) for i in range(12)}
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts.items()], "doc_id long, text string, edits int")
    trees = tc.build_trees(docs)
    for _ in range(2):
        table = []
        for i, t in texts.items():
            at = np.sort(rng.choice(len(t) + 1, min(len(t) + 1, 6), replace=False)).tolist()
            table += [(i, a, b, random_text(rng, 3)) for a, b in zip(at[::2], at[1::2])] if i % 3 else []
        edits = spark.createDataFrame(table, "doc_id long, start long, stop long, new string")
        texts = {i: tc.apply_edits(t, [e[1:] for e in table if e[0] == i]) for i, t in texts.items()}
        done = tc.edit_trees(trees, edits=edits)
        for r in done.collect():
            text = texts[r["row"]["doc_id"]]
            assert r.text == text and (r.n_chars_after, r.n_tokens_after) == (len(text), full(text, count))
            assert (r.n_reencoded == 0) == (r.n_edits == 0)
            tree = tc.CountTree.unpacked(r.text, count, r.chars, r.tokens, r.sums)
            assert (tree.sums == tc.CountTree(text, count).sums).all()
        trees = tc.settle(done.select("row", "text", "chars", "tokens", "sums", tc.F.col("n_chars_after").alias("n_chars"), tc.F.col("n_tokens_after").alias("n_tokens")), "again")


def test_many_edits_of_a_long_text_are_not_quadratic(count):
    import time

    text = "word by word 123 " * 60_000
    tree = tc.CountTree(text, count)
    began = time.time()
    for at in range(len(text) - 20, 0, -100):
        tree.edit(at, at + 3, "xy zw")
    assert time.time() - began < 30
    assert tree.tokens == full(tree.text, count)
