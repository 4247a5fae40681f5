"""Substring dedup on bytes with range-partitioned suffixes.

The suffixes that matter are those at the minimisers of windows (``passages``): all copies of a window hold the
same one at the same place, and the shared steps leave the suffixes whose leading gram recurs in other
surroundings. Sampled splitters range-partition them by that gram; suffixes with one gram never straddle a
splitter, so no pair is lost between buckets. A bucket sorts the windows of its suffixes by multikey quicksort,
eight bytes a step, refining only what still has an equal, and compares neighbours; a gram's rows that go on over
the border of two Arrow batches are held until all are there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import passages
from siftline.llm.common import as_bytes, row_schema, slices, table

WINDOW = 200
GRAM = 40
CHUNK = 2048
STEP = 8


def equal_windows(data: bytes, at: np.ndarray, key: np.ndarray, window: int) -> np.ndarray:
    """Which of the windows that start at ``at`` have an equal among those with the same key.

    Multikey quicksort by words of eight bytes: each step sorts the groups whose word differs inside the
    group, parts them by it, and drops what is alone. ``window`` is a multiple of eight.
    """
    words = np.ndarray((len(data) - STEP + 1,), dtype=">u8", buffer=data, strides=(1,))
    live = np.argsort(key, kind="stable")
    group = key[live]
    new = np.concatenate([[True], group[1:] != group[:-1]])
    group = np.cumsum(new) - 1
    for depth in range(0, window, STEP):
        many = np.bincount(group)
        keep = many[group] > 1
        live, group = live[keep], group[keep]
        if not len(live):
            break
        new = np.concatenate([[True], group[1:] != group[:-1]])
        group = np.cumsum(new) - 1
        word = words[at[live] + depth].astype(np.uint64)
        mixed = np.zeros(group[-1] + 1, dtype=bool)
        mixed[group[word != word[np.flatnonzero(new)[group]]]] = True
        part = np.flatnonzero(mixed[group])
        if len(part):
            order = part[np.lexsort((word[part], group[part]))]
            live[part], word[part] = live[order], word[order]
            new = np.concatenate([[True], (group[1:] != group[:-1]) | (word[1:] != word[:-1])])
            group = np.cumsum(new) - 1
    many = np.bincount(group) if len(group) else np.zeros(0, np.int64)
    out = np.zeros(len(at), dtype=bool)
    out[live[many[group] > 1]] = True
    return out


def _compare(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in passages.whole_groups(batches, "lead", CHUNK):
            rows = passages.once(rows)
            leads = rows.column("lead").to_pylist()
            lead = np.cumsum([0] + [a != b for a, b in zip(leads[1:], leads, strict=False)])
            parts = rows.column("bytes").to_pylist()
            meta = np.asarray(rows.column("meta")).astype(np.int64)
            many, before = meta >> 8, meta & 0xFF
            begins = np.cumsum([0] + [len(p) for p in parts])[:-1]
            item = np.repeat(np.arange(len(parts)), many)
            offset = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            # Equal windows hold the gram at the same place.
            key = lead[item] * 256 + before[item] - offset + 255 * 2
            hit = equal_windows(b"".join(parts), begins[item] + offset, key, window)
            known = np.asarray(rows.column("known").to_numpy(zero_copy_only=False)).astype(bool)
            hit &= ~known[item]  # these are removed already
            yield passages.runs_of(rows, item[hit], offset[hit])

    return run


def _cut(shape: passages.Shape, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", passages.SLICE_BYTES):
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            for text, found in zip(as_bytes(batch.column("text")), batch.column("found").to_pylist(), strict=True):
                data = text or b""
                gone = passages.covered(len(data), found, shape.window)
                n_bytes.append(len(data))
                n_removed.append(int(gone.sum()))
                n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                if n_removed[-1]:
                    data = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                kept.append(hashlib.sha256(data).hexdigest().encode() if digest else data)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), *[pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)], pa.array(kept, pa.binary())],
                names=["row", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def dedup_suffixes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """Remove every byte that a ``window`` of bytes covers which also starts anywhere else.

    Returns ``row`` (a struct of all input columns but text), n_bytes, n_removed, n_spans (maximal removed runs)
    and kept: the bytes that stay, or with ``digest`` their SHA-256. A cut may part a character; so kept is binary.

    Texts are UTF-8 bytes, null is empty; matches never cross documents, and overlapping ones count. Rows that repeat
    both doc_id and text are one document and have one result; different texts that carry one id, or none, are
    separate documents, told apart by 128 bits. Texts shorter than a window lose nothing; very long texts are taken whole, in pieces. An
    empty table gives an empty result; other columns are carried unread. ``window`` is a multiple of eight, less than 256
    above ``gram``.
    """
    if window % STEP or not 0 < window - gram < 255:
        raise ValueError("window: a multiple of 8, over gram by less than 255")
    shape = passages.Shape(passages.as_byte_units, window, gram)
    own = passages.keyed(docs)
    found = passages.placed(own, shape, False)
    parts = passages.contexts(own, found, shape)
    leads = parts.filter("shard is not null").select("lead", "known", *passages.IDENTITY, "first", "meta", "bytes")
    dealt = leads.repartitionByRange("lead").sortWithinPartitions("lead")
    rest = dealt.mapInArrow(_compare(window), passages.REMOVED).unionByName(passages.hot_repeats(parts, False))
    out = passages.collect(own, found, rest)
    return out.mapInArrow(_cut(shape, digest), row_schema(out, "n_bytes long, n_removed long, n_spans long, kept binary"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_suffixes(docs, digest=True)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept").cast("string").alias("kept_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (
  SELECT r, s, array_slice(b, s, s + 199) AS x FROM (SELECT r, b, unnest(generate_series(1, octet_length(b) - 199)) AS s FROM d WHERE octet_length(b) >= 200)
), twice AS (SELECT x FROM w GROUP BY x HAVING count(*) > 1
), hit AS (SELECT r, s FROM w SEMI JOIN twice USING (x)
), marked AS (SELECT r, s, CASE WHEN s > lag(s) OVER (PARTITION BY r ORDER BY s) + 200 THEN 1 ELSE 0 END AS fresh FROM hit
), spans AS (SELECT r, min(s) AS a, max(s) + 199 AS z FROM (SELECT r, s, sum(fresh) OVER (PARTITION BY r ORDER BY s) AS g FROM marked) GROUP BY r, g
), stay AS (
  SELECT r, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) + 1 AS f, a - 1 AS t FROM spans
  UNION ALL SELECT r, max(z) + 1, octet_length(any_value(b)) FROM spans JOIN d USING (r) GROUP BY r
), kept AS (SELECT r, string_agg(hex(array_slice(b, f, t)), '' ORDER BY f) FILTER (t >= f) AS h FROM stay JOIN d USING (r) GROUP BY r
), sums AS (SELECT r, sum(z - a + 1) AS n, count(*) AS k FROM spans GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans,
  CASE WHEN k IS NULL THEN sha256(b) ELSE sha256(unhex(coalesce(h, ''))) END AS kept_sha256
FROM d LEFT JOIN sums USING (r) LEFT JOIN kept USING (r)
"""
