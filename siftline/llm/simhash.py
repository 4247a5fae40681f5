"""SimHash near-dedup with BK-trees.

Fingerprints are linked at ``radius`` or fewer differing bits. Distinct fingerprints are dealt to shards by bit
blocks: of ``radius + 2`` blocks two linked fingerprints agree on two at least, so every link lies inside one of
the shards keyed by a pair of blocks. Each shard is a BK-tree (children keyed by Hamming distance to the parent);
a search follows only edges within the radius. Trees of all fingerprints grow with the data, so a tree isn't
broadcast to every task: it goes, once, to the task that has the shard's queries. A shard gives at most one link
for each of its fingerprints, to the least one it is linked with inside the shard. A shard of over ``SHARD``
fingerprints is parted again, as often as it takes: of ``radius + 1`` blocks of the bits that its key leaves open, linked
ones agree on one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.bktree import BITS, BKForest, Links
from siftline.llm.common import IDENTITY, as_bytes, carried, forget, identity, need, release, row_schema, settle, slices, table
from siftline.llm.components import components

SEED = 42
WORDS = 3
RADIUS = 2
SLICE_BYTES = 16_000_000
#: Fingerprints of whole shards that are built into one forest.
FOREST = 50_000
#: Fingerprints of a shard beyond which it is parted again (260 bytes of tree each): what a task holds is at most this and a
#: forest, whatever the data.
SHARD = 200_000


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words of the lower-cased text, repeats included."""
    parts = text.lower().split() if text else []  # of bytes: A-Z and ASCII white space only
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    spaces = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 0x20)
    begins = np.concatenate([[0], spaces + 1])
    ends = np.concatenate([spaces, [len(joined)]])[width - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[b:e], SEED) for b, e in zip(begins.tolist(), ends.tolist(), strict=False)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _prints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            prints = np.array([fingerprint(shingle_hashes(t, width)) for t in as_bytes(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(prints.view(np.int64))], names=["row", "fp"])

    return run


def fingerprints(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(row, fp): row is the struct of all columns but text."""
    need(docs, "doc_id", "text")
    own = docs.select(carried(docs, "text"), "text")
    return own.mapInArrow(_prints(width), row_schema(own, "fp long"))


def _cut(open_: int, parts: int) -> list[int]:
    """Masks that part the bits of ``open_`` into even blocks."""
    bits = [1 << b for b in range(BITS) if open_ >> b & 1]
    edges = np.linspace(0, len(bits), parts + 1).astype(int).tolist()
    return [sum(bits[b:e]) for b, e in zip(edges, edges[1:], strict=False)]


def blocks(radius: int) -> list[int]:
    """Masks of the pairs of ``radius + 2`` bit blocks."""
    return [a | b for a, b in combinations(_cut((1 << BITS) - 1, radius + 2), 2)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _stars(radius: int):
    """Links (a, b): a star in each group of linked fingerprints of a shard."""

    def links(prints: np.ndarray, shards: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((prints.view(np.int64), shards))
        prints, shards = prints[order], shards[order]
        trees, union = BKForest(prints, shards), Links(len(prints))
        for a, b in trees.within(radius):
            union.add(a, b)
        top = union.roots()
        far = np.flatnonzero(top != np.arange(len(top)))
        signed = prints.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[far]), pa.array(signed[top[far]])], names=["a", "b"])

    return links


def _search(links, forest: int):
    """Rows (mask, key, fp) sorted by shard in, links (a, b) of whole shards out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, enough = 0, forest
        for batch in batches:
            held.append(np.stack([np.asarray(c) for c in batch.columns], axis=1).astype(np.int64))
            size += batch.num_rows
            if size < enough:
                continue
            rows = np.concatenate(held)
            new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
            cut = np.flatnonzero(new)[-1]  # the last shard may go on in the next batch
            if cut:
                yield from links(*_shared(rows[:cut]))
            held, size = [rows[cut:]], len(rows) - cut
            enough = max(forest, 2 * size)  # a large shard is not looked through again for every batch
        if size:
            yield from links(*_shared(np.concatenate(held)))

    return run


def _shared(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and shard numbers of the shards with two fingerprints at least."""
    new = np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
    shard = np.cumsum(new) - 1
    many = np.bincount(shard)[shard] > 1
    return np.ascontiguousarray(rows[many, 2]).view(np.uint64), shard[many]


def _finer(mask: int, radius: int) -> list[int]:
    """Masks that fix one more of ``radius + 1`` blocks of the open bits: linked fingerprints of a shard agree on one of them."""
    return [mask | part for part in _cut(~mask & ((1 << BITS) - 1), radius + 1) if part]


def _dealt(prints: DataFrame, masks: Column) -> DataFrame:
    """(mask, key, fp) for every mask of an array: the key is the fixed bits."""
    return prints.withColumn("mask", F.explode(masks)).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _sharded(prints: DataFrame, radius: int, most: int) -> DataFrame:
    """(mask, key, fp) for every shard of each fingerprint, sorted by shard. Shards of over ``most`` rows are parted again, and
    their parts too, until none is larger: each step leaves radius / (radius + 1) of the open bits, and two to their number bounds a part."""
    masks = blocks(radius)
    dealt, done = _dealt(prints, F.array(*[F.lit(_signed(m)) for m in masks])), None
    while True:
        counts = dealt.groupBy("mask", "key").agg(F.count("*").alias("n"))
        large = settle(counts.filter(F.col("n") > most).drop("n"), "large-shards")
        if large.isEmpty():
            break
        small = dealt.join(large, ["mask", "key"], "left_anti")
        done = small if done is None else done.unionByName(small)
        children = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in _finer(m, radius)]))])
        again = settle(dealt.join(large, ["mask", "key"], "left_semi"), "large-rows")
        dealt = _dealt(again.withColumnRenamed("mask", "parent"), children[F.col("parent")])
        masks = list({c for m in masks for c in _finer(m, radius)})
    every = dealt if done is None else done.unionByName(dealt)
    return every.repartition("mask", "key").sortWithinPartitions("mask", "key")


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, forest: int = FOREST, shard: int = SHARD) -> DataFrame:
    """prints: distinct fp. Links (a, b) that connect all fingerprints at most ``radius`` bits apart."""
    return _sharded(prints.select("fp"), radius, shard).mapInArrow(_search(_stars(radius), forest), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, width: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(row, fp, component_id): row is the struct of all columns but text; component_id the least doc_id reachable.

    Words are parted by ASCII white space, A-Z in lower case. A text of fewer words than ``width`` is one shingle,
    a null text or one without words has fingerprint zero and is linked like any other. Rows that repeat a doc_id are
    documents of their own; a null doc_id is never the least one unless a component has no other (then null). Very
    long texts are taken whole. An empty table gives an empty result.
    """
    prints = settle(fingerprints(docs, width), "prints")
    least = settle(prints.groupBy("fp").agg(F.min("row.doc_id").alias("least")), "distinct-prints")
    labels = components(link_fingerprints(least.select("fp"), radius))
    labelled = least.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    named = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = labelled.select("fp", "label").join(named, "label").select("fp", "component_id")
    return prints.join(ids, "fp").select("row", "fp", "component_id")


#: Classes of shingles that a document is keyed by, and shingles of a class at least (below twice as many).
SLOTS = 64
CLASS = 3
#: Documents sampled to learn which shingles are common, those that a shingle must be in, and shingles kept at most.
#: The sample only decides the order in which shingles make a prefix, never the result.
SAMPLE_DOCS = 4096
SAMPLE_OFTEN = 3
COMMON = 200_000


def _classes(hashes: np.ndarray) -> np.ndarray:
    """Keys of up to ``SLOTS`` classes of the distinct shingles.

    Shingles are dealt to 2**level classes by their hash, so that a class holds ``CLASS`` to 2 x ``CLASS`` of them; a key
    stands for the shingles of one class. Two documents that share four shingles in five agree on a class with a chance
    of about a quarter, and on none of 64 with one under 1e-6. A document just below a level's border is keyed
    on the next level too, where a partner up to a quarter larger is.
    """
    keys = [np.zeros(0, dtype=np.uint64)]
    n = len(hashes)
    levels = {max(4, int(np.log2(max(x, 1) / CLASS))) for x in (n, 1.25 * n)} if n else set()
    mixed = _spread(_spread(hashes) ^ (hashes >> np.uint64(29)))
    for level in sorted(levels):
        slot = (_spread(hashes) >> np.uint64(32)) & np.uint64((1 << level) - 1)
        order = np.argsort(slot, kind="stable")
        order = order[: np.searchsorted(slot[order], SLOTS)]
        if len(order):
            own, begin, many = np.unique(slot[order], return_index=True, return_counts=True)
            sums = np.add.reduceat(mixed[order], begin)
            head = own * np.uint64(1 << 40) + many.astype(np.uint64) * np.uint64(64) + np.uint64(level)
            keys.append(_spread(sums ^ _spread(head)))
    return np.concatenate(keys)


def _spread(hashes: np.ndarray) -> np.ndarray:
    return hashes * np.uint64(0x9E3779B97F4A7C15)


def _some_shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES // 4):
            own = [np.unique(shingle_hashes(t, width)) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).view(np.int64))], names=["token"])

    return run


def common_shingles(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles, and in how many sampled texts each is."""
    n = texts.count()
    some = texts.select("text") if n <= SAMPLE_DOCS else texts.select("text").sample(SAMPLE_DOCS / n, 7)
    often = some.mapInArrow(_some_shingles(width), "token long").groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= SAMPLE_OFTEN)
    found = often.orderBy(F.desc("n"), "token").limit(COMMON).toArrow()
    token, many = (np.asarray(c.combine_chunks()).astype(np.int64) for c in found.columns)
    token = token.view(np.uint64)
    order = np.argsort(token)
    return token[order], many[order]


def prefix(distinct: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """The shingles of a set that come first in one order of all, the rare ones first, of which two sets that reach the
    similarity share one."""
    token, many = common
    often = np.zeros(len(distinct), dtype=np.int64)
    if len(token):
        at = np.minimum(np.searchsorted(token, distinct), len(token) - 1)
        often = np.where(token[at] == distinct, many[at], 0)
    n = len(distinct)
    return distinct[np.lexsort((_spread(distinct), often))][: n - int(np.ceil(similarity * n - 1e-6)) + 1]


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            sets, prints, counts, keys = [], [], [], []
            for text in as_bytes(batch.column("text")):
                hashes = shingle_hashes(text, width)
                prints.append(fingerprint(hashes))
                distinct = np.unique(hashes)
                counts.append(len(distinct))
                sets.append(xxhash.xxh3_128_digest(distinct.tobytes()))
                keys.append(_classes(distinct).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in ("row", *IDENTITY)],
                    pa.array(sets, pa.binary()),
                    pa.array(counts, pa.int64()),
                    pa.array(np.array(prints, dtype=np.uint64).view(np.int64)),
                    pa.array([k.tolist() for k in keys], pa.list_(pa.int64())),
                ],
                names=["row", *IDENTITY, "node", "n", "fp", "keys"],
            )

    return run


def _pairs(similarity: float):
    """Rows (key, n, short, hub_n, hub) sorted by key and size in, candidate pairs out: each row with the one before it, with
    the first row whose size lets it reach the similarity, and with the group's hub. What these leave is for ``_prefix_pairs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, centre, before = None, None, None
        for batch in batches:
            out = []
            for k, n, node, *hub in zip(*[batch.column(c).to_pylist() for c in ("key", "n", "short", "hub_n", "hub")], strict=True):
                now = (n, node)
                if k != key:
                    key, centre, before = k, now, now
                elif n * similarity > centre[0]:
                    centre = now
                for m, other in {centre, before, tuple(hub)}:
                    if other != node and max(n, m) * similarity <= min(n, m):
                        out.append((min(other, node), max(other, node)))
                before = now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    return run


#: Shingles of recent nodes that a task keeps.
RECENT = 4_000_000


def _confirm(width: int, similarity: float):
    """Pairs of nodes with their texts in, those whose sets reach the similarity out. Texts take less room on their way
    than the hashes of their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[bytes, np.ndarray] = {}
        held = 0

        def shingles(node: bytes, text: bytes | None) -> np.ndarray:
            nonlocal held
            if node not in recent:
                own = np.unique(shingle_hashes(text, width))
                if held + len(own) > RECENT:
                    recent.clear()
                    held = 0
                recent[node] = own
                held += len(own)
            return recent[node]

        for batch in batches:
            keep = []
            columns = [batch.column("u").to_pylist(), as_bytes(batch.column("x")), batch.column("v").to_pylist(), as_bytes(batch.column("y"))]
            for i, (u, x, v, y) in enumerate(zip(*columns, strict=True)):
                x, y = shingles(u, x), shingles(v, y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("u", "v")], names=["a", "b"])

    return run


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (a, b) of nodes, for the pairs (a, b) of short names whose texts (short, node, text) reach the similarity. Nodes
    that share a short name are all compared."""
    one = texts.select(F.col("short").alias("a"), F.col("node").alias("u"), F.col("text").alias("x"))
    two = texts.select(F.col("short").alias("b"), F.col("node").alias("v"), F.col("text").alias("y"))
    met = pairs.join(one, "a").join(two, "b").filter("u <> v").select("u", "v", "x", "y")
    return met.mapInArrow(_confirm(width, similarity), "a binary, b binary")


#: Longs of a parity bitmap: 256 bits.
BITMAP = 4
HEAD_NAMES = ["token", "short", "label", "size", *[f"bits{i}" for i in range(BITMAP)]]
HEAD = ", ".join(f"{c} long" for c in HEAD_NAMES)


def parity_bitmap(distinct: np.ndarray) -> np.ndarray:
    """Which bits an odd number of the set's hashes fall on. What two sets share cancels out, so their bitmaps differ in no
    more bits than the sets in elements."""
    bits = BITMAP * 64
    odd = np.bincount((_spread(distinct) >> np.uint64(32)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _heads(width: int, similarity: float, common: tuple[np.ndarray, np.ndarray]):
    """Rows (short, label, text) in, (token, short, label, size, bitmap) of their prefixes out: size is that of the set and
    the token's place from 1, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES // 4):
            sets = [np.unique(shingle_hashes(t, width)) for t in as_bytes(batch.column("text"))]
            heads = [prefix(x, common, similarity).view(np.int64) for x in sets]
            many = np.array([len(x) for x in heads], dtype=np.int64)
            of = pa.array(np.repeat(np.arange(len(heads)), many))
            place = np.arange(1, many.sum() + 1) - np.repeat(np.cumsum(many) - many, many)
            size = np.repeat(np.array([len(x) for x in sets], dtype=np.int64), many) << 32 | place
            bits = np.repeat(np.stack([parity_bitmap(x) for x in sets]), many, axis=0)
            columns = [pa.array(np.concatenate(heads)), *[batch.column(c).take(of) for c in ("short", "label")], pa.array(size), *[pa.array(bits[:, i]) for i in range(BITMAP)]]
            yield pa.RecordBatch.from_arrays(columns, names=HEAD_NAMES)

    return run


def _meet(similarity: float):
    """Rows of cells (token, lo, hi) sorted by cell in, pairs (a, b) of unlike labels out for which the token can be the first
    that both share, in the order of prefixes, of sets that reach the similarity."""

    def pairs(rows: np.ndarray) -> np.ndarray:
        lo, hi = rows[0, 1:3]
        x, y = (rows, rows) if lo == hi else (rows[rows[:, 3] == lo], rows[rows[:, 3] == hi])
        n, p = x[:, None, 4] >> 32, x[:, None, 4] & 0xFFFFFFFF
        m, q = y[None, :, 4] >> 32, y[None, :, 4] & 0xFFFFFFFF
        # Nothing is common before the first shared token, and no more than the shorter tail behind it.
        can = (x[:, None, 5] != y[None, :, 5]) & (1 + np.minimum(n - p, m - q) + 1e-6 >= similarity / (1 + similarity) * (n + m))
        i, j = np.nonzero(np.triu(can, 1) if lo == hi else can)
        # Nor more than the bits in which the bitmaps differ allow.
        both = (n[i, 0] + m[0, j]).astype(np.float64)
        near = (both - np.bitwise_count((x[i, 7:] ^ y[j, 7:]).view(np.uint64)).sum(axis=1, dtype=np.int64)) / 2 + 1e-6 >= similarity / (1 + similarity) * both
        one, two = x[i[near], 6], y[j[near], 6]
        return np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            held, size = [], 0
            for cell in np.split(rows, cuts):
                held.append(pairs(cell))
                size += len(held[-1])
                if size > 1 << 17:
                    yield batch_of(held)
                    held, size = [], 0
            if size:
                yield batch_of(held)

        def batch_of(held: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.unique(np.concatenate(held), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["a", "b"])

        rest = np.zeros((0, 7 + BITMAP), dtype=np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1)])
            if len(rows):
                cut = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))  # the last cell may go on in the next batch
                cut = cut[-1] + 1 if len(cut) else 0
                if cut:
                    yield from out(rows[:cut])
                rest = rows[cut:]
        if len(rest):
            yield from out(rest)

    return run


#: Rows of a token's block in the prefix join; two blocks meet in one cell.
BLOCK = 256
#: Ratio of the sizes of sets that a band holds.
BAND = 1.05


def _band(n):
    return F.floor(F.ln(n.cast("double")) / math.log(BAND)).cast("long")


def _cells(heads: DataFrame, similarity: float) -> DataFrame:
    """Rows of ``_heads`` in the cells (token, lo, hi) where they can meet others; ``block`` says which side of the cell a row is.

    A token of up to ``BLOCK`` rows is one cell. The rows of a larger one are parted by size: where a token stands in a set, and that
    it be the first shared one, bound the sizes of partners from both sides, so a row goes only to the bands it can
    meet, and of those only to where it is met in turn. Two bands meet block by block: a family of sets that share a
    token but cannot be similar by size and place is not copied at all.
    """
    held = heads.groupBy("token").agg(F.count("*").alias("rows"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high")
    dealt = heads.join(held.select("token", "rows"), "token")
    columns = ["token", "lo", "hi", "block", "size", "label", "short", *HEAD_NAMES[4:]]
    zero = F.lit(0).cast("long")
    small = dealt.filter(F.col("rows") <= BLOCK).withColumns({"lo": zero, "hi": zero, "block": zero})
    n, p = F.shiftright("size", 32), F.col("size").bitwiseAND(F.lit(0xFFFFFFFF))
    least = F.ceil(similarity * n - 1e-6)
    most = F.floor((1 + n - p) * ((1 + similarity) / similarity) - n + 1e-6)
    banded = dealt.filter(F.col("rows") > BLOCK).filter(most >= least).withColumn("own", _band(n)).withColumn("other", F.explode(F.sequence(_band(least), _band(most))))
    counts = banded.groupBy("token", "own", "other").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    both = counts.join(counts.select("token", F.col("own").alias("other"), F.col("other").alias("own"), F.col("k").alias("there")), ["token", "own", "other"])
    spread = banded.join(both, ["token", "own", "other"]).withColumn("at", F.pmod(F.xxhash64("short"), "k")).withColumn("meets", F.explode(F.sequence(zero, F.col("there") - 1)))
    code = lambda band, block: F.shiftleft(F.col(band), 32) + F.col(block)
    large = spread.withColumns({"block": code("own", "at"), "with": code("other", "meets")}).withColumns({"lo": F.least("block", "with"), "hi": F.greatest("block", "with")})
    return small.select(*columns).unionByName(large.select(*columns))


def _prefix_pairs(heads: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of short names of unlike labels, among them all that reach the similarity: an exact prefix join.

    heads: from ``_heads``. Two sets that reach it share a token of both prefixes, and the first of these, in the one order
    of all tokens, passes the test of ``_meet``. No task holds a whole token. Tokens of one label only are left out.
    """
    cells = _cells(heads, similarity)
    met = cells.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(_meet(similarity), "a long, b long")
    return met.distinct()


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """(row, doc, m1, m2, first_doc, first_m1, first_m2): the least document of each one's group of near duplicates.

    Documents are near duplicates where their sets of ``width``-word shingles have a Jaccard similarity of at least
    ``similarity``; groups are connected components. Equal sets are one node. Candidates come in two steps, and every link is
    confirmed on the whole sets:

    1. Nodes whose SimHash fingerprints BK-trees link within ``radius`` bits, and nodes that share the key of a class of
       shingles (see ``_classes``): each with its neighbour and with the group's hub, the node whose keys most
       others share. This joins large groups without looking at all their pairs.
    2. Nodes of the groups that step 1 left in several parts meet in an exact prefix join, whatever their number; only
       pairs of different parts are compared.

    A document is its ``IDENTITY``: rows that repeat id and text are one document; different texts of one id, or of none,
    are separate ones. A text of fewer words is one shingle; null and empty texts have none and are equal to each
    other. Very long texts are taken whole. An empty table gives an empty result; columns but text are carried unread in ``row``.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    keyed = docs.select(carried(docs, "text"), *identity(), "text")
    found = settle(keyed.mapInArrow(_sketches(width), row_schema(keyed, "doc long, m1 long, m2 long, node binary, n long, fp long, keys array<long>")), "sketches")
    least = F.min(F.struct(*IDENTITY))
    nodes = settle(found.groupBy("node").agg(least.alias("r"), F.first("n").alias("n"), F.first("fp").alias("fp")).select("node", "r.*", "n", "fp", F.xxhash64("node").alias("short")), "nodes")

    def texts_of(shorts: DataFrame) -> DataFrame:
        """(short, node, text) of nodes by short name, one text for each node."""
        asked = nodes.join(shorts.distinct(), "short", "left_semi").select(*IDENTITY, "node", "short")
        texts = keyed.select(*IDENTITY, "text").join(asked.hint("shuffle_hash"), list(IDENTITY)).dropDuplicates(list(IDENTITY))
        texts = settle(texts.select("short", "node", "text"), "texts")
        release(spark)
        return texts

    # Step 1.
    first = found.select(*IDENTITY, "node", "keys").join(nodes.drop("short"), [*IDENTITY, "node"]).dropDuplicates([*IDENTITY, "node"])
    own = first.select(F.xxhash64("node").alias("short"), "n", F.explode(F.array_append("keys", F.xxhash64("fp"))).alias("key")).repartition("key")
    sizes = own.groupBy("key").agg(F.count("*").alias("size"), F.max("short"), F.max("n")).filter("size > 1").select("key", "size")
    shared = settle(own.join(sizes, "key"), "keys")  # both sides read one exchange, as they need the same columns
    release(spark)
    votes = shared.groupBy("short").agg(F.sum("size").alias("votes"))
    hubs = shared.join(votes, "short").groupBy("key").agg(F.max(F.struct("votes", "n", "short")).alias("hub"))
    ranked = shared.join(hubs, "key").select("key", "n", "short", F.col("hub.n").alias("hub_n"), F.col("hub.short").alias("hub")).sortWithinPartitions("key", "n", "short")
    met = ranked.mapInArrow(_pairs(similarity), "a long, b long")
    trees = link_fingerprints(nodes.select("fp").distinct(), radius)
    of_print = nodes.groupBy("fp").agg(F.min("short").alias("short"))
    linked = trees.join(of_print.select(F.col("fp").alias("a"), F.col("short").alias("u")), "a").join(of_print.select(F.col("fp").alias("b"), F.col("short").alias("v")), "b")
    pairs = settle(met.unionByName(linked.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))).distinct(), "pairs")
    first_texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("short")))
    first_links = settle(_confirmed(pairs, first_texts, width, similarity), "links")
    labels = settle(components(first_links), "labels")
    for done in (pairs, first_texts, first_links):
        forget(spark, done)
    release(spark)

    # Step 2.
    def labelled(labels: DataFrame) -> DataFrame:
        return nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    # Of groups up to three rows all pairs were compared.
    part = shared.filter("size > 3").join(labelled(labels).select("short", F.xxhash64("label").alias("label")), "short")
    unlike = part.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    rest = settle(part.join(unlike, "key", "left_semi").select("short", "label").distinct(), "rest")
    forget(spark, shared)
    rest_texts = texts_of(rest.select("short"))
    heads = rest_texts.join(rest, "short").select("short", "label", "text")
    heads = heads.mapInArrow(_heads(width, similarity, common_shingles(rest_texts, width)), HEAD)
    pairs = settle(_prefix_pairs(heads.repartition("token"), similarity), "rest-pairs")
    release(spark)
    more = settle(_confirmed(pairs, rest_texts, width, similarity), "more")
    for done in (pairs, rest, rest_texts):
        forget(spark, done)
    release(spark)
    if not more.isEmpty():
        labels = components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    groups = labelled(labels).select("node", "label", F.struct(*IDENTITY).alias("r"))
    named = groups.join(groups.groupBy("label").agg(F.min("r").alias("f")), "label").select("node", *[F.col(f"f.{c}").alias(f"first_{c}") for c in IDENTITY])
    return found.select("row", *IDENTITY, "node").join(named, "node").drop("node")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
