"""Substring dedup on words with repeated-phrase automata.

Recurring passages are confirmed by the shared steps (``passages``): only contexts of grams that recur in other
surroundings remain to be compared. They are sharded by gram. A shard compiles the windows that recur in it into
Aho-Corasick automata (pyahocorasick; each word is one symbol) and streams its contexts through them, which locates
every occurrence exactly; all but the earliest of a window are repeats. An automaton holds the windows of at most
about ``CHUNK`` contexts. A document's text is streamed as its contexts: the rest of it has no recurring gram.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import passages
from siftline.llm.common import as_bytes, row_schema, slices, table

WINDOW = 20
GRAM = 8
CHUNK = 8192
#: Words of a shard are numbered from here: above it every code point is a symbol.
SYMBOL = 0x10000


def recurring(streams: list[str], window: int) -> list[str]:
    """Distinct windows that the streams hold more than once."""
    seen: set[str] = set()
    twice: set[str] = set()
    for s in streams:
        for i in range(len(s) - window + 1):
            w = s[i : i + window]
            (twice if w in seen else seen).add(w)
    return list(twice)


def occurrences(streams: list[str], phrases: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, stream, offset) of every occurrence of every phrase; all are equally long."""
    automaton = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        automaton.add_word(p, i)
    automaton.make_automaton()
    back = len(phrases[0]) - 1
    found = [(p, s, end - back) for s, stream in enumerate(streams) for end, p in automaton.iter(stream)]
    phrase, stream, offset = np.array(found, dtype=np.int64).reshape(-1, 3).T
    return phrase, stream, offset


def _locate(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in passages.whole_groups(batches, "shard", CHUNK):
            rows = passages.once(rows)
            symbols: dict[bytes, str] = {}
            streams = []
            for context in rows.column("bytes").to_pylist():
                streams.append("".join([symbols.setdefault(w, chr(SYMBOL + len(symbols))) for w in context.split(b" ")]))
            phrases = recurring(streams, window)
            if not phrases:
                continue
            phrase, item, offset = occurrences(streams, phrases)
            *who, first = (np.asarray(rows.column(c)) for c in (*passages.IDENTITY, "first"))
            order = np.lexsort((first[item] + offset, *[x[item] for x in who[::-1]], phrase))
            phrase, item, offset = phrase[order], item[order], offset[order]
            later = np.concatenate([[False], phrase[1:] == phrase[:-1]])
            item, offset = item[later], offset[later]
            order = np.lexsort((offset, item))
            yield passages.runs_of(rows, item[order], offset[order])

    return run


def _cut(shape: passages.Shape, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", passages.SLICE_BYTES):
            n_words, n_removed, kept = [], [], []
            for text, found in zip(as_bytes(batch.column("text")), batch.column("found").to_pylist(), strict=True):
                units = shape.units(text)
                gone = passages.covered(len(units), found, shape.window)
                n_words.append(len(units))
                n_removed.append(int(gone.sum()))
                data = units.data
                if n_removed[-1]:
                    stay = np.flatnonzero(~gone)
                    data = b" ".join([data[b:e] for b, e in zip(units.begins[stay].tolist(), units.ends[stay].tolist(), strict=True)])
                kept.append(hashlib.sha256(data).hexdigest() if digest else data.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                names=["row", "n_words", "n_removed", "kept"],
            )

    return run


def dedup_phrases(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """Remove every word that a ``window`` of words covers which also starts earlier.

    Earlier: in a smaller doc_id, or in the same document at an earlier word. Windows are judged on the input.
    Returns ``row`` (a struct of all input columns but text), n_words, n_removed and kept: the words that stay,
    joined by one space, or with ``digest`` their SHA-256.

    Null and empty texts have no words; texts of fewer words than a window lose none. Rows that repeat both
    doc_id and text are one document and have one result; different texts that carry one id, or none, are separate
    documents (told apart by 128 bits), ordered by their hash; null ids come last. Very long texts are taken whole, in pieces. An empty table
    gives an empty result; other columns are carried unread.
    """
    shape = passages.Shape(passages.as_word_units, window, gram)
    own = passages.keyed(docs)
    found = passages.placed(own, shape, True)
    parts = passages.contexts(own, found, shape)
    shards = parts.filter("shard is not null").select("shard", *passages.IDENTITY, "first", "bytes")
    dealt = shards.repartition("shard").sortWithinPartitions("shard")
    rest = dealt.mapInArrow(_locate(window), passages.REMOVED).unionByName(passages.hot_repeats(parts, True))
    out = passages.collect(own, found, rest)
    return out.mapInArrow(_cut(shape, digest), row_schema(out, "n_words long, n_removed long, kept string"))


def op7_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_phrases(docs, digest=True).select("row.doc_id", "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, s, md5_number(array_to_string(w[s : s + 19], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM w WHERE len(w) >= 20)
), later AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS n FROM win) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM later
), words AS (
  SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM w
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
