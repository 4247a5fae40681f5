"""Edit-aware token counts: a stored segment tree over the pre-tokens of each document.

``build_trees`` encodes every text once and stores, beside it, the characters and tokens of its pre-tokens and the
sums over them: a leaf is a few dozen pre-tokens, inner nodes hold the sums below them. ``edit_trees`` takes stored
trees and edits. An edit finds its leaves by characters, splits and encodes again only from a pre-token before the
touched region to the first old boundary behind it, and updates the sums above the leaves it changed; all other
leaves are never looked at, and documents without edits not even read. A byte-pair encoder never merges across
pre-tokens, and a split depends on nothing before it, so the count equals that of the whole edited text.
Tokenizers are read from ``path`` and never trained.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import carried, need, quoted, row_schema, settle, slices, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed by the tokenizer: how its texts are split before merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
#: Characters beyond its end that decide where a pre-token ends.
AHEAD = 3
CACHE = 200_000
#: Characters of a pre-token beyond which merges go by a heap: the encoder's time grows with the square.
LONG = 512
SLICE_BYTES = 8_000_000
#: What a redaction replaces: mail addresses and long numbers as in telephone or card numbers.
REDACT = r"[\w.+-]++@[\w-]++(?:\.[\w-]++)+|\+?\(?\d[\d() -]{8,}\d"
REPLACEMENT = "[redacted]"


def merged_count(piece: bytes, ranks: dict[bytes, int]) -> int:
    """Tokens of a long pre-token: merges the pair of least rank, leftmost first, from a heap in n log n steps."""
    n = len(piece)
    end = list(range(1, n + 1))  # of the token that starts at i
    before = list(range(-1, n - 1))  # start of the token before it
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    left = n
    while heap:
        rank, i = heapq.heappop(heap)
        j = end[i]
        if j < 0 or j >= n or ranks.get(piece[i : end[j]]) != rank:
            continue  # one of the pair is gone or has grown
        stop = end[j]
        end[i], end[j] = stop, -1
        left -= 1
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i))
        h = before[i]
        if h >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h))
    return left


class Counter:
    """Tokens of pre-tokens, with a bounded memory of those seen."""

    def __init__(self, path: str = TOKENIZER, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        self.encoder = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.seen: dict[str, int] = {}

    def __call__(self, piece: str) -> int:
        n = self.seen.get(piece)
        if n is None:
            n = len(self.encoder.encode_ordinary(piece)) if len(piece) <= LONG else merged_count(piece.encode(), self.ranks)
            if len(piece) <= 64:
                if len(self.seen) >= CACHE:
                    self.seen.clear()
                self.seen[piece] = n
        return n


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers in one or four bytes each, told by the first byte."""
    small = not len(x) or x.max() < 256
    return bytes([int(small)]) + x.astype(np.uint8 if small else "<u4").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if data[0] else "<u4", offset=1).astype(np.int64)


class CountTree:
    """Token count of a text under edits: flat arrays of the pre-tokens as they were, and the leaves that edits changed."""

    def __init__(self, text: str, count: Counter, chars: np.ndarray | None = None, tokens: np.ndarray | None = None, sums: np.ndarray | None = None):
        self.count, self.encoded = count, 0
        if chars is None:
            pieces = count.pattern.findall(text)
            chars, tokens = (np.fromiter(map(f, pieces), np.int64, len(pieces)) for f in (len, count))
        self._take(text, chars, tokens, sums)

    def _take(self, text: str, chars: np.ndarray, tokens: np.ndarray, sums: np.ndarray | None = None) -> None:
        self.flat, self.chars, self.tokens_of = text, chars, tokens
        self.n = max(1, -(-len(chars) // LEAF))
        self.base = 1 << (self.n - 1).bit_length()
        self.sums = _sums(chars, tokens, self.base) if sums is None else sums
        self.starts = np.concatenate([[0], np.cumsum(self.sums[self.base : self.base + self.n, 0])])
        self.changed: dict[int, tuple[str, list[int], list[int]]] = {}

    def leaf(self, i: int) -> tuple[str, list[int], list[int]]:
        """Text, and characters and tokens of the pre-tokens, of leaf ``i``."""
        if i in self.changed:
            return self.changed[i]
        own = slice(i * LEAF, (i + 1) * LEAF)
        return self.flat[self.starts[i] : self.starts[i + 1]], self.chars[own].tolist(), self.tokens_of[own].tolist()

    def _set(self, i: int, leaf: tuple[str, list[int], list[int]]) -> None:
        self.changed[i] = leaf
        at = self.base + i
        self.sums[at] = sum(leaf[1]), sum(leaf[2])
        while at > 1:
            at //= 2
            self.sums[at] = self.sums[2 * at] + self.sums[2 * at + 1]

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def size(self) -> int:
        return int(self.sums[1, 0])

    def _joined(self, whole, part, empty: list) -> list:
        """Parts of changed leaves between whole stretches of the others."""
        out, begin = empty, 0
        for i in sorted(self.changed):
            out += [whole(begin, i), part(self.changed[i])]
            begin = i + 1
        return [*out, whole(begin, self.n)]

    @property
    def text(self) -> str:
        return "".join(self._joined(lambda a, b: self.flat[self.starts[a] : self.starts[b]], lambda leaf: leaf[0], []))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Characters and tokens of all pre-tokens as they are now."""
        return tuple(
            np.concatenate(self._joined(lambda a, b, x=x: x[a * LEAF : b * LEAF], lambda leaf, k=k: np.array(leaf[k], dtype=np.int64), []))
            for k, x in ((1, self.chars), (2, self.tokens_of))
        )

    def _find(self, char: int) -> tuple[int, int]:
        """(leaf, first character of it) of the leaf that holds ``char``; the last one beyond the end."""
        at, before = 1, 0
        while at < self.base:
            left = int(self.sums[2 * at, 0])
            if char - before < left or self.sums[2 * at + 1, 0] == 0:
                at = 2 * at
            else:
                before, at = before + left, 2 * at + 1
        return at - self.base, before

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace characters ``start`` to ``end`` - 1 by ``new``."""
        if not 0 <= start <= end <= self.size:
            raise ValueError("edit outside the text")
        shift = len(new) - (end - start)
        first, leaf_begin = self._find(max(0, start - AHEAD))
        head, chars, tokens = self.leaf(first)
        keep, begin = 0, leaf_begin
        while keep < len(chars) and begin + chars[keep] + AHEAD <= start:  # its end was decided before the edit
            begin += chars[keep]
            keep += 1
        # The new text from ``begin`` on, as far as leaves were read: ``reach`` old characters of it.
        ahead, reach, parts = first + 1, leaf_begin + len(head), [head[begin - leaf_begin :]]
        while reach < end:
            parts.append(self.leaf(ahead)[0])
            reach, ahead = reach + len(parts[-1]), ahead + 1
        old_text = "".join(parts)
        window = old_text[: start - begin] + new + old_text[end - begin :]
        # Old boundaries from ``begin`` on are passed as new pre-tokens catch up with them.
        leaf, skip, old, own = first, keep, begin, chars
        found: tuple[list[int], list[int]] = ([], [])
        at, step = 0, 1
        while True:
            while old + shift < begin + at or old < end:
                while skip >= len(own) and leaf + 1 < self.n:
                    leaf, skip = leaf + 1, 0
                    own = self.leaf(leaf)[1]
                if skip >= len(own):
                    break
                old += own[skip]
                skip += 1
            if old >= end and old + shift == begin + at:
                break
            match = self.count.pattern.match(window, at)
            if ahead < self.n and (match is None or match.end() + AHEAD > len(window)):  # what follows decides
                more = [self.leaf(i)[0] for i in range(ahead, min(self.n, ahead + step))]
                window, ahead, step = "".join([window, *more]), ahead + len(more), 2 * step
                continue
            if match is None:
                break
            found[0].append(len(match.group()))
            found[1].append(self.count(match.group()))
            at = match.end()
        self.encoded += len(found[0])
        tail_text, tail_chars, tail_tokens = self.leaf(leaf)
        left = sum(tail_chars[skip:])
        text = head[: begin - leaf_begin] + window[:at] + (tail_text[len(tail_text) - left :] if left else "")
        for i in range(first + 1, leaf + 1):
            self._set(i, ("", [], []))
        self._set(first, (text, chars[:keep] + found[0] + tail_chars[skip:], tokens[:keep] + found[1] + tail_tokens[skip:]))
        if len(self.changed[first][1]) > 8 * LEAF + self.n:  # as many more as the leaves that are dealt again
            self._take(self.text, *self.arrays())

    def packed(self) -> tuple[bytes, bytes, bytes]:
        """Characters and tokens of the pre-tokens, and the sums over the leaves that they make."""
        chars, tokens = self.arrays()
        base = 1 << (max(1, -(-len(chars) // LEAF)) - 1).bit_length()
        sums = self.sums if not self.changed else _sums(chars, tokens, base)
        return _packed(chars), _packed(tokens), sums.astype("<u4").tobytes()

    @classmethod
    def unpacked(cls, text: str, count: Counter, chars: bytes, tokens: bytes, sums: bytes) -> CountTree:
        return cls(text, count, _unpacked(chars), _unpacked(tokens), np.frombuffer(sums, "<u4").astype(np.int64).reshape(-1, 2))


def _sums(chars: np.ndarray, tokens: np.ndarray, base: int) -> np.ndarray:
    """(characters, tokens) of the nodes of a tree: the root at 1, leaves of LEAF pre-tokens from ``base`` on."""
    sums = np.zeros((2 * base, 2), dtype=np.int64)
    for k, x in enumerate((chars, tokens)):
        if len(x):
            own = np.add.reduceat(x, np.arange(0, len(x), LEAF))
            sums[base : base + len(own), k] = own
    while base > 1:
        sums[base // 2 : base] = sums[base : 2 * base : 2] + sums[base + 1 : 2 * base : 2]
        base //= 2
    return sums


def redactions(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace addresses and long numbers, last first, so that places stay valid."""
    return [(m.start(), m.end(), REPLACEMENT) for m in _REDACT.finditer(text)][::-1]


_REDACT = regex.compile(REDACT)


COLUMNS = ("n_chars", "n_tokens", "n_edits", "n_reencoded", "n_chars_after", "n_tokens_after")
EDITS = "array<struct<start:long,stop:long,new:string>>"
TREE = f"text string, edits {EDITS}, chars binary, tokens binary, sums binary"


def _build(path: str, given: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        edit = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("new", pa.string())]))
        for batch in slices(batches, "text", SLICE_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            trees = [CountTree(t, count) for t in texts]
            edits = batch.column("edits") if given else pa.array([[dict(zip(("start", "stop", "new"), e, strict=True)) for e in redactions(t)] for t in texts], edit)
            numbers = [pa.array([f(t) for t in trees], pa.int64()) for f in (lambda t: t.size, lambda t: t.tokens)]
            packed = [pa.array(x, pa.binary()) for x in zip(*[t.packed() for t in trees], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), edits, *packed, *numbers], names=["row", "text", "edits", "chars", "tokens", "sums", "n_chars", "n_tokens"])

    return run


def build_trees(docs: DataFrame, path: str = TOKENIZER, edits: str | None = None) -> DataFrame:
    """The stored trees of ``docs``: row (a struct of the other columns), text, edits, chars, tokens, sums, n_chars, n_tokens.

    ``edits`` names a column of edits that goes along; without it the edits are redactions of addresses and long numbers.
    """
    need(docs, "doc_id", "text", *([edits] if edits else []))
    given = [quoted(edits).cast(EDITS).alias("edits")] if edits else []
    own = docs.select(carried(docs, "text", *([edits] if edits else [])), "text", *given)
    return settle(own.mapInArrow(_build(path, bool(edits)), row_schema(own, f"{TREE}, n_chars long, n_tokens long")), "trees")


def _edit(path: str, counts_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in slices(batches, "text", SLICE_BYTES):
            out: list[list[int]] = [[] for _ in range(4)]
            texts, packed = [], []
            for text, edits, *stored in zip(*[batch.column(c).to_pylist() for c in ("text", "edits", "chars", "tokens", "sums")], strict=True):
                tree = CountTree.unpacked(text, count, *stored)
                edits = sorted(((e["start"], e["stop"], e["new"] or "") for e in edits), reverse=True)
                for edit in edits:  # last first, so that places stay valid
                    tree.edit(*edit)
                if not counts_only:
                    texts.append(tree.text)
                    packed.append(tree.packed())
                for column, x in zip(out, (len(edits), tree.encoded, tree.size, tree.tokens), strict=True):
                    column.append(x)
            after = [] if counts_only else [pa.array(texts, pa.string()), *[pa.array(x, pa.binary()) for x in zip(*packed, strict=True)]]
            names = [] if counts_only else ["text", "chars", "tokens", "sums"]
            numbers = [batch.column(c) for c in COLUMNS[:2]] + [pa.array(c, pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays([batch.column("row"), *numbers, *after], names=["row", *COLUMNS, *names])

    return run


def edit_trees(trees: DataFrame, path: str = TOKENIZER, edits: DataFrame | None = None, counts_only: bool = False) -> DataFrame:
    """Applies edits to stored trees: row, the counts before and after, and (unless ``counts_only``) the trees after.

    edits: a table (doc_id, start, stop, new) of code points of the stored text, not overlapping, in any order; every
    document of that id has them. Without it, those stored with the trees. Documents without edits keep their counts
    and are not read. The result (with no edits of its own) can be stored and edited again.
    """
    if edits is not None:
        per = edits.groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "new")).cast(EDITS).alias("edits"))
        keyed = trees.drop("edits").withColumn("doc_id", F.col("row").getField("doc_id"))
        trees = keyed.join(per, "doc_id", "left").drop("doc_id")
    some = F.coalesce(F.size("edits"), F.lit(0)) > 0
    more = [] if counts_only else ["text", "chars", "tokens", "sums"]
    none = F.lit(0).cast("long")
    same = trees.filter(~some).select("row", "n_chars", "n_tokens", none.alias("n_edits"), none.alias("n_reencoded"), F.col("n_chars").alias("n_chars_after"), F.col("n_tokens").alias("n_tokens_after"), *more)
    schema = row_schema(trees, ", ".join(f"{c} long" for c in COLUMNS) + ("" if counts_only else ", text string, chars binary, tokens binary, sums binary"))
    return same.unionByName(trees.filter(some).mapInArrow(_edit(path, counts_only), schema))


def count_tokens(docs: DataFrame, path: str = TOKENIZER, edits: str | None = None) -> DataFrame:
    """Token counts of whole texts before and after their edits, by stored trees.

    ``edits`` names a column array<struct<start, stop, new>>: code points of the original text, not overlapping,
    in any order; without it the edits are redactions of addresses and long numbers. Returns ``row`` (a struct of
    the other columns), n_chars, n_tokens, n_edits, n_reencoded (pre-tokens that the edits encoded anew),
    n_chars_after, n_tokens_after.

    Null and empty texts have no tokens; null edits are none, a null ``new`` deletes. Rows are counted one by one, so
    repeated rows repeat their result; very long texts are taken whole; an empty table gives an empty one.
    """
    return edit_trees(build_trees(docs, path, edits), path, counts_only=True)


def apply_edits(text: str, edits: Iterable[tuple[int, int, str]]) -> str:
    for start, end, new in sorted(edits, reverse=True):
        text = text[:start] + new + text[end:]
    return text


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).select("row.doc_id", *COLUMNS)
