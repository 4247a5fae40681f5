"""Ranked lexical search: document shards with CSR postings and precomputed integer impacts.

``build_index`` turns every slice of documents into a shard, stored in the shared folder: its sorted terms, and for each
term the places of the documents that hold it with what one occurrence count and one length are worth there, an
integer that needs only the number and mean length of all documents. How many documents hold a term is summed over the
shards' list lengths. ``search`` broadcasts queries in blocks of bounded size; a task adds up a query's lists term
by term in a dense array over the shard's documents, keeps the best of all its shards, and only those are merged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType, StructField, StructType

from siftline.llm.common import NULL_ID, as_bytes, doc_key, forget, need, settle, slices, table
from siftline.llm.decontaminate import words

BEST = 50
#: Bytes of document text of a shard, and of query text that one pass broadcasts (some 20 bytes for each).
SHARD_BYTES = 4_000_000
BLOCK_BYTES = 2_000_000
#: Terms whose counts a task holds before it sends them on.
HELD_TERMS = 500_000
#: The score: a term's weight floor(IDF * ln((2 N + 2) / (2 df + 1))) times floor(SCALE tf / (1000 tf + 20 m)),
#: m = 100 - 50 + floor(50 n N / L). All but the weight is 64-bit integer arithmetic.
IDF, SCALE = 1000, 1_000_000_000

SHARD = "docs binary, n_docs long, n_terms long, terms binary, df binary, places binary, lengths binary, tf binary"
INDEX = "docs binary, terms binary, df binary, places binary, impacts binary"


def shard_of(ids: np.ndarray, texts: list[bytes | None]) -> list:
    """The columns ``SHARD`` of some documents."""
    numbers: dict[bytes, int] = {}
    term, place, tf, lengths = [], [], [], []
    for at, text in enumerate(texts):
        own = words(text)
        lengths.append(len(own))
        for w, n in Counter(own).items():
            term.append(numbers.setdefault(w, len(numbers)))
            place.append(at)
            tf.append(n)
    names = sorted(numbers)
    rank = np.empty(len(names), dtype=np.int64)
    rank[[numbers[w] for w in names]] = np.arange(len(names))
    term = rank[np.array(term, dtype=np.int64)]
    order = np.argsort(term, kind="stable")
    lengths = np.array(lengths, dtype=np.int64)
    packed = lambda x, kind: np.asarray(x).astype(kind).tobytes()
    return [
        packed(ids, "<i8"), int((lengths > 0).sum()), int(lengths.sum()), b" ".join(names), packed(np.bincount(term, minlength=len(names)), "<i4"),
        packed(np.array(place, dtype=np.int64)[order], "<i4"), packed(lengths, "<i8"), packed(np.array(tf, dtype=np.int64)[order], "<i8"),
    ]


def _shards(shard_bytes: int):
    fields = [(c.split()[0], pa.int64() if c.endswith("long") else pa.binary()) for c in SHARD.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", shard_bytes):
            row = shard_of(np.asarray(batch.column("id")), as_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, (_, kind) in zip(row, fields, strict=True)], names=[n for n, _ in fields])

    return run


def impact(tf: np.ndarray, lengths: np.ndarray, documents: int, words_in_all: int) -> np.ndarray:
    """What ``tf`` occurrences in a document of so many words are worth, before the term's weight."""
    m = 50 + (50 * lengths * documents) // max(1, words_in_all)
    return (SCALE * tf) // (1000 * tf + 20 * m)


def _impacts(documents: int, words_in_all: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                places, lengths, tf = (np.frombuffer(one.column(c)[0].as_py(), t) for c, t in (("places", "<i4"), ("lengths", "<i8"), ("tf", "<i8")))
                worth = impact(tf, lengths[places], documents, words_in_all).astype("<i4").tobytes()
                yield pa.RecordBatch.from_arrays([*[one.column(c) for c in ("docs", "terms", "df", "places")], pa.array([worth], pa.binary())], names=["docs", "terms", "df", "places", "impacts"])

    return run


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, df) summed over a task's shards, sent on whenever there are many."""
    held: Counter[bytes] = Counter()

    def sent() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["term", "df"])

    for batch in batches:
        for terms, df in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist(), strict=True):
            for w, n in zip(terms.split(b" ") if terms else [], np.frombuffer(df, "<i4").tolist(), strict=True):
                held[w] += n
            if len(held) > HELD_TERMS:
                yield sent()
                held.clear()
    if held:
        yield sent()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(shards, terms) of ``docs``, both stored: a row for each shard (``INDEX``), and each term with its weight.

    A null or empty text has no terms and counts in no statistic; every row is a document of its own, also where ids repeat
    or are null; very long texts are shards of their own; other columns are not looked at.
    """
    need(docs, id_col, text_col)
    shards = settle(docs.select(doc_key(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_shards(shard_bytes), SHARD), "shards")
    documents, words_in_all = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    index = settle(shards.mapInArrow(_impacts(documents, words_in_all), INDEX), "impacts")
    forget(docs.sparkSession, shards)
    counted = index.select("terms", "df").mapInArrow(_document_counts, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(IDF * F.ln((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return index, settle(counted.select("term", "df", weight.alias("weight")), "terms")


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A query's terms, once each."""
    for batch in batches:
        own = [sorted(set(words(t))) for t in as_bytes(batch.column("text"))]
        row = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]))
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(row) for c in ("item_id", "mark", "block")], pa.array([w for x in own for w in x], pa.binary())], names=["item_id", "mark", "block", "term"])


def top(score: np.ndarray, docs: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the ``best`` scores above 0, equal ones by ascending id: all that equal the last are weighed."""
    at = np.flatnonzero(score > 0)
    if len(at) > best:
        own = score[at]
        last = own[np.argpartition(-own, best - 1)[best - 1]]
        at = at[own >= last]
    order = np.lexsort((docs[at], -score[at]))[:best]
    return docs[at[order]], score[at[order]]


def _search(shared, best: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, items, asked, weights = shared.value
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(items)
        for batch in batches:
            for k in range(batch.num_rows):
                docs, terms, df, places, impacts = (batch.column(c)[k].as_py() for c in ("docs", "terms", "df", "places", "impacts"))
                held = {q: i for i, w in enumerate(terms.split(b" ") if terms else []) if (q := vocabulary.get(w)) is not None}
                if not held:
                    continue
                docs, places, impacts = np.frombuffer(docs, "<i8"), np.frombuffer(places, "<i4"), np.frombuffer(impacts, "<i4")
                begins = np.concatenate([[0], np.cumsum(np.frombuffer(df, "<i4"), dtype=np.int64)])
                total = np.zeros(len(docs), dtype=np.int64)
                for item, own in enumerate(asked):
                    total[:] = 0
                    for q in own:
                        if (i := held.get(q)) is not None:
                            part = slice(begins[i], begins[i + 1])
                            total[places[part]] += weights[q] * impacts[part]
                    who, what = top(total, docs, best)
                    if len(who):
                        before = found[item]
                        found[item] = top(np.concatenate([before[1], what]), np.concatenate([before[0], who]), best)
        many = [len(f[0]) for f in found]
        if sum(many):
            row = np.repeat(np.arange(len(items)), many)
            names, marks = pa.array([i for i, _ in items], kind), pa.array([m for _, m in items], pa.int64())
            yield pa.RecordBatch.from_arrays([names.take(pa.array(row)), marks.take(pa.array(row)), *[pa.array(np.concatenate([f[c] for f in found])) for c in (0, 1)]], names=["item_id", "mark", "id", "score"])

    return run


def search(index: tuple[DataFrame, DataFrame], items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of each item's ``best`` documents with a score above 0 in the index of ``build_index``.

    Equal scores rank by ascending doc_id, null ids last. Null, empty and term-less items rank nothing; rows that repeat an
    item are one item, different texts under one item_id are ranked each on its own; other columns are not looked at.
    Blocks hold about ``block_bytes`` of items (a longer item is a block of its own size); each reads the shards once.
    """
    need(items, "item_id", "text")
    shards, terms = index
    spark = shards.sparkSession
    given = items.select("item_id", "text").filter("text is not null").distinct()
    size = given.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    marked = given.select("item_id", "text", F.xxhash64("text").alias("mark"), F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int").alias("block"))
    kind = items.schema["item_id"].dataType
    schema = StructType([StructField("item_id", kind), *StructType.fromDDL("mark long, block int, term binary").fields])
    asked = settle(marked.mapInArrow(_asked, schema).join(terms.select("term", "weight"), "term"), "asked")
    found = None
    for b in range(blocks):
        vocabulary, items_of, weights = {}, {}, []
        for r in asked.filter(F.col("block") == b).orderBy("item_id", "mark", "term").toLocalIterator():
            term = bytes(r["term"])
            if term not in vocabulary:
                vocabulary[term] = len(vocabulary)
                weights.append(r["weight"])
            items_of.setdefault((r["item_id"], r["mark"]), []).append(vocabulary[term])
        shared = spark.sparkContext.broadcast((vocabulary, list(items_of), list(items_of.values()), np.array(weights, dtype=np.int64)))
        out = StructType([StructField("item_id", kind), *[StructField(c, LongType()) for c in ("mark", "id", "score")]])
        part = shards.mapInArrow(_search(shared, best, to_arrow_type(kind)), out)
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("item_id", "mark").orderBy(F.desc("score"), "id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
    return ranked.select("item_id", "rank", F.nullif("id", F.lit(NULL_ID)).alias("doc_id"), "score")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents
), total AS (SELECT count(*) AS nd, CAST(coalesce(sum(len(w)), 0) AS BIGINT) AS l FROM d WHERE len(w) > 0
), asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark
), tf AS (
  SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY r, doc_id, n, t
), weight AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY t, nd
), worth AS (SELECT r, doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + ((50 * n * nd) // l)))) AS s FROM tf JOIN weight USING (t), total
), scores AS (SELECT item_id, r, doc_id, CAST(sum(s) AS BIGINT) AS score FROM asked JOIN worth USING (t) GROUP BY item_id, r, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""
