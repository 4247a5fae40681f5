"""Benchmark decontamination on a stored, distributed positional inverted index.

``build_index`` turns every slice of documents into a segment: the postings (term -> ascending positions) of all
its words, written once to the shared folder. Segments are spread over the executors and hold whole documents, so
postings never cross the network and a phrase never spans two segments. ``find_items`` streams the segments
past the test set: a window's lists are offset-adjusted and intersected, beginning with the terms rarest in the
segment. The test set is compiled into blocks of about ``block_bytes`` of its text on the executors and broadcast block
by block. The index is only ever read: a block writes what it has found, a row for each document that holds an item,
and with several blocks these rows meet their segment at the end.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from siftline.llm.common import as_bytes, carried, need, settle, slices, table

#: A-Z fold to a-z; every other ASCII byte that is no letter or digit parts words.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else 0x20 if b <= 0x2F or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b
    for b in range(256)
)
WINDOW = 10
#: Bytes of test text that one pass broadcasts: windows of term numbers, some 20 bytes for each byte of text.
BLOCK_BYTES = 2_000_000
#: Bytes of document text that one segment covers.
SLICE_BYTES = 4_000_000
#: Postings that are checked together.
CANDIDATES = 200_000


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


@dataclass
class Windows:
    """A block of test items: vocabulary, and per window length the distinct windows and the items that have them."""

    vocabulary: dict[bytes, int]
    #: length -> (windows, one row of term numbers each; where each one's items begin in the next; items)
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    item_ids: list[str]


def compile_windows(items: Iterable[tuple[str, bytes]], width: int = WINDOW) -> Windows:
    vocabulary: dict[bytes, int] = {}
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    item_ids: dict[str, int] = {}
    for item_id, text in items:
        ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(text)], dtype=np.int32)
        if len(ids):
            item = item_ids.setdefault(item_id, len(item_ids))
            own = np.lib.stride_tricks.sliding_window_view(ids, min(width, len(ids)))
            parts.setdefault(own.shape[1], []).append((own, np.full(len(own), item, dtype=np.int32)))
    by_length = {}
    for n, found in sorted(parts.items()):
        both = np.unique(np.concatenate([np.hstack([w, i[:, None]]) for w, i in found]), axis=0)
        new = np.concatenate([[True], (both[1:, :n] != both[:-1, :n]).any(axis=1)])
        begins = np.flatnonzero(np.concatenate([new, [True]]))
        by_length[n] = (np.ascontiguousarray(both[new, :n]), begins, both[:, n].copy())
    return Windows(vocabulary, by_length, list(item_ids))


@dataclass
class Segment:
    """Postings of a slice of documents: the positions of term i are postings[offsets[i]:offsets[i + 1]], ascending; a gap of
    one position parts documents."""

    n_words: np.ndarray
    terms: list[bytes]
    counts: np.ndarray
    postings: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Segment:
        numbers: dict[bytes, int] = {}
        n_words, ids = [], []
        for t in texts:
            own = [numbers.setdefault(w, len(numbers)) for w in words(t)]
            n_words.append(len(own))
            ids += own
        n_words, ids = np.array(n_words, dtype=np.int64), np.array(ids, dtype=np.int64)
        order = np.argsort(ids, kind="stable")
        place = np.arange(len(ids)) + np.repeat(np.arange(len(n_words)), n_words)
        return cls(n_words, list(numbers), np.bincount(ids, minlength=len(numbers)), place[order])

    def packed(self) -> tuple[bytes, bytes, bytes, bytes]:
        steps = np.diff(self.postings, prepend=0)
        return self.n_words.astype("<i4").tobytes(), b" ".join(self.terms), self.counts.astype("<i4").tobytes(), steps.astype("<i4").tobytes()

    @classmethod
    def unpacked(cls, n_words: bytes, terms: bytes, counts: bytes, postings: bytes) -> Segment:
        n, c, p = (np.frombuffer(x, "<i4").astype(np.int64) for x in (n_words, counts, postings))
        return cls(n, terms.split(b" ") if terms else [], c, np.cumsum(p))

    def __post_init__(self):
        self.begins = np.concatenate([[0], np.cumsum(self.n_words + 1)])

    def over(self, vocabulary: dict[bytes, int]) -> PositionalIndex:
        return PositionalIndex(self, vocabulary)


class PositionalIndex:
    """The lists of a segment over the terms of a block of test items."""

    def __init__(self, segment: Segment, vocabulary: dict[bytes, int]):
        self.begins, self.end = segment.begins, int(segment.begins[-1])
        offsets = np.concatenate([[0], np.cumsum(segment.counts)])
        held = [(k, i) for i, t in enumerate(segment.terms) if (k := vocabulary.get(t)) is not None]
        held.sort()
        which = np.array([k for k, _ in held], dtype=np.int64)
        of = np.array([i for _, i in held], dtype=np.int64)
        self.counts = np.zeros(len(vocabulary), dtype=np.int64)
        self.counts[which] = segment.counts[of]
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])
        many = self.counts[which]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        self.postings = segment.postings[np.repeat(offsets[of], many) + within]
        #: All lists as one ascending list: a term's positions lie in its own range.
        self.joint = np.repeat(which, many) * self.end + self.postings

    def holds(self, term: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the term's list holds the position."""
        key = term * self.end + at
        return self.joint[np.minimum(np.searchsorted(self.joint, key), len(self.joint) - 1)] == key

    def starts(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, position) of every exact phrase match. windows: one row of term numbers for each."""
        if not len(windows) or not len(self.postings):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        frequency = self.counts[windows]
        live = np.flatnonzero(frequency.min(axis=1) > 0)
        by_rarity = np.argsort(frequency[live], axis=1, kind="stable")
        many = frequency[live].min(axis=1)
        # Common windows have long lists even of their rarest term: so many candidates are looked at together.
        part = np.cumsum(many) // CANDIDATES
        borders = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(live)]
        found = [self._intersected(windows[live[b:e]].astype(np.int64), by_rarity[b:e], many[b:e], live[b:e]) for b, e in zip(borders, borders[1:], strict=False) if e > b]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _intersected(self, windows: np.ndarray, by_rarity: np.ndarray, many: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matches of a few windows: the list of the rarest term, less its offset, cut with that of the next rarest and so on."""
        first = by_rarity[:, 0]
        term = windows[np.arange(len(windows)), first]
        row = np.repeat(np.arange(len(windows)), many)
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = self.postings[self.offsets[term][row] + within] - first[row]
        keep = (at >= 0) & (at + windows.shape[1] <= self.end)
        row, at = row[keep], at[keep]
        for k in range(1, windows.shape[1]):
            if not len(row):
                break
            offset = by_rarity[row, k]
            keep = self.holds(windows[row, offset], at + offset)
            row, at = row[keep], at[keep]
        return names[row], at

    def near(self, windows: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, position of its rarest term) where all terms of the window, with their multiplicity, lie within
        its length plus ``slop`` consecutive words of one document, in any order."""
        found_w, found_at = [], []
        for i, window in enumerate(windows):
            terms, need_n = np.unique(window, return_counts=True)
            if self.counts[terms].min() == 0:
                continue
            span = len(window) + slop
            order = np.argsort(self.counts[terms], kind="stable")
            at = self.postings[self.offsets[terms[order[0]]] : self.offsets[terms[order[0]] + 1]]
            doc = np.searchsorted(self.begins, at, "right") - 1
            # Where a run of ``span`` words around the place may begin, within the document.
            low = np.maximum(self.begins[doc], at - span + 1)
            begin = low[:, None] + np.arange(span)
            end = np.minimum(begin + span, self.begins[doc + 1][:, None] - 1)
            good = begin <= at[:, None]
            for k in order:
                own = self.postings[self.offsets[terms[k]] : self.offsets[terms[k] + 1]]
                good &= np.searchsorted(own, end) - np.searchsorted(own, begin) >= need_n[k]
                stay = good.any(axis=1)
                at, begin, end, good = at[stay], begin[stay], end[stay], good[stay]
            found_w += [i] * len(at)
            found_at += at.tolist()
        return np.array(found_w, np.int64), np.array(found_at, np.int64)


SEGMENT = "n_words binary, terms binary, counts binary, postings binary"
PACKED = [c.split()[0] for c in SEGMENT.split(", ")]


def _index(slice_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", slice_bytes):
            packed = Segment.of(as_bytes(batch.column("text"))).packed()
            rows = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("row"))
            yield pa.RecordBatch.from_arrays([rows, pa.array([uuid.uuid4().hex]), *[pa.array([x], pa.binary()) for x in packed]], names=["rows", "segment", *PACKED])

    return run


def build_index(docs: DataFrame, keep_text: bool = False, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The index of ``docs`` (doc_id, text, any others), stored: one row for each segment, with a name, and with the documents'
    rows (a struct of all columns, but the text unless ``keep_text``) in the order of their positions."""
    need(docs, "doc_id", "text")
    own = docs.select(carried(docs, *(() if keep_text else ("text",))), "text")
    schema = StructType([StructField("rows", ArrayType(own.schema["row"].dataType)), *StructType.fromDDL(f"segment string, {SEGMENT}").fields])
    return settle(own.mapInArrow(_index(slice_bytes), schema), "index")


FOUND = "hits binary, items array<string>"


def _search(shared, slop: int | None, whole: bool):
    """One block over segments: for every document that holds an item its words hit (bitmap) and its items; with ``whole`` for
    every document, in place of its segment's row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Windows = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment.unpacked(*[batch.column(c)[k].as_py() for c in PACKED])
                index = segment.over(block.vocabulary)
                delta = np.zeros(index.end + 1, dtype=np.int64)
                names: dict[int, set[str]] = {}
                for n, (windows, begins, items) in block.by_length.items():
                    which, at = index.starts(windows)
                    np.add.at(delta, at, 1)
                    np.add.at(delta, at + n, -1)
                    if slop is not None:
                        extra, where = index.near(windows, slop)
                        which, at = np.concatenate([which, extra]), np.concatenate([at, where])
                    docs = np.searchsorted(index.begins, at, "right") - 1
                    for w, d in set(zip(which.tolist(), docs.tolist(), strict=True)):
                        names.setdefault(d, set()).update(block.item_ids[i] for i in items[begins[w] : begins[w + 1]].tolist())
                hit = np.cumsum(delta[:-1]) > 0
                found = {d: (np.packbits(hit[segment.begins[d] : segment.begins[d] + segment.n_words[d]]).tobytes(), names[d]) for d in names}
                if whole:
                    yield _documents(batch.column("rows")[k].values, segment.n_words, found)
                elif found:
                    at = sorted(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column("segment")[k].as_py()] * len(at)), pa.array(at, pa.int32()), pa.array([found[d][0] for d in at], pa.binary()), pa.array([sorted(found[d][1]) for d in at], pa.list_(pa.string()))],
                        names=["segment", "at", "hits", "items"],
                    )

    return run


def _documents(rows: pa.Array, n_words: np.ndarray, found: dict[int, tuple[bytes, set[str]]]) -> pa.RecordBatch:
    hits = [found[d][0] if d in found else b"" for d in range(len(n_words))]
    many = [int(np.bitwise_count(np.frombuffer(h, np.uint8)).sum()) for h in hits]
    return pa.RecordBatch.from_arrays(
        [rows, pa.array(n_words, pa.int64()), pa.array(many, pa.int64()), pa.array([h if n else b"" for h, n in zip(hits, many, strict=True)], pa.binary()), pa.array([sorted(found[d][1]) if d in found else [] for d in range(len(n_words))], pa.list_(pa.string()))],
        names=["row", "n_words", "n_hit", "hits", "items"],
    )


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments with what all blocks have found in their documents."""
    for batch in batches:
        for k in range(batch.num_rows):
            n_words = np.frombuffer(batch.column("n_words")[k].as_py(), "<i4").astype(np.int64)
            found: dict[int, tuple[bytes, set[str]]] = {}
            for f in batch.column("found")[k].as_py() or []:
                hits, items = found.get(f["at"], (bytes(len(f["hits"])), set()))
                found[f["at"]] = (np.bitwise_or(np.frombuffer(hits, np.uint8), np.frombuffer(f["hits"], np.uint8)).tobytes(), items | set(f["items"]))
            yield _documents(batch.column("rows")[k].values, n_words, found)


def _compiled(width: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["item_id", "text"])
        block = compile_windows(zip(part["item_id"], (t.encode() for t in part["text"]), strict=True), width)
        return pd.DataFrame({"block": [part["block"].iloc[0]], "windows": [pickle.dumps(block)]})

    return run


def search_index(index: DataFrame, items: DataFrame, width: int = WINDOW, slop: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, n_words, n_hit, hits, items) of every indexed document; see ``find_items``."""
    need(items, "item_id", "text")
    spark = index.sparkSession
    asked = items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id is not null and text is not null")
    size = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    windows = settle(dealt.groupBy("block").applyInPandas(_compiled(width), "block int, windows binary"), "windows")
    schema = StructType([StructField("row", index.schema["rows"].dataType.elementType), *StructType.fromDDL("n_words long, n_hit long, hits binary, items array<string>").fields])

    def broadcast(b: int):
        """One block, of bounded size."""
        row = windows.filter(F.col("block") == b).first()
        return spark.sparkContext.broadcast(pickle.loads(row["windows"]) if row else compile_windows([], width))

    if blocks == 1:
        return index.mapInArrow(_search(broadcast(0), slop, True), schema)
    found = None
    for b in range(blocks):
        shared = broadcast(b)
        part = settle(index.select("segment", *PACKED).mapInArrow(_search(shared, slop, False), f"segment string, at int, {FOUND}"), "found")
        shared.destroy()
        found = part if found is None else found.unionByName(part)
    per = found.groupBy("segment").agg(F.collect_list(F.struct("at", "hits", "items")).alias("found"))  # a row for each document and block that met
    return index.select("segment", "rows", "n_words").join(per, "segment", "left").mapInArrow(_together, schema)


def find_items(
    docs: DataFrame,
    items: DataFrame,
    width: int = WINDOW,
    slop: int | None = None,
    block_bytes: int = BLOCK_BYTES,
    slice_bytes: int = SLICE_BYTES,
    *,
    keep_text: bool = False,
) -> DataFrame:
    """Every document with the test items found in it.

    docs: doc_id, text; items: item_id, text. Returns doc_id, row (a struct of all columns, but the text unless
    ``keep_text``), n_words, n_hit, hits (bitmap of the words inside an exact match, empty if none) and items (sorted
    ids). With ``slop``, items that match only in proximity (all words of a window within its length plus
    ``slop`` words, any order) are listed too; they hit no word.

    Null or empty texts have no words; items without words or id are ignored; rows that repeat an item_id are
    one item with several texts; rows that repeat a doc_id are separate documents; other columns are carried
    unread. Very long texts are segments of their own. Empty tables give empty results.
    """
    need(docs, "doc_id", "text")
    found = search_index(build_index(docs, keep_text, slice_bytes), items, width, slop, block_bytes)
    return found.select("row.doc_id", "row", "n_words", "n_hit", "hits", "items")


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Documents in which no item window occurs; same columns, whatever they are called. Rows are judged one by one, as in
    ``find_items``."""
    kept = find_items(docs, items, width, keep_text=True).filter("n_hit = 0")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def report(docs: DataFrame, items: DataFrame, width: int = WINDOW) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated; edge cases as in ``find_items``."""
    found = find_items(docs.select("doc_id", "text"), items, width)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS s FROM iw WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM win
), hit AS (
  SELECT d.doc_id, d.s, win.n, win.item
  FROM (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS phrase
        FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM dw, sizes WHERE len(w) >= n)) d
  JOIN win ON win.n = d.n AND win.phrase = d.phrase
), per AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id)
"""
