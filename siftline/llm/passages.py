"""Repeated windows of a fixed number of units (words or bytes): what the two substring operators share.

Every window is owned by its minimiser, the gram of ``gram`` units with the least hash in it (the leftmost of equals).
Equal windows have equal minimisers at equal places, so all copies of a window meet under one gram, while only
about 2 / (window - gram + 2) of the positions become rows (anchors). An anchor stands for the run of windows it
owns; the bytes of that run are its context.

1. ``anchors``: one row for each anchor of each document: gram hash, context hash, place. Of the copies of a
   context in one slice of documents only the first goes on under the gram; the others are settled there.
2. ``classify``: sorted by gram and context. Grams that occur once are gone for good. Copies of a whole
   context are settled at once; what is left are distinct contexts of one gram, which may share some windows.
3. ``contexts``: the texts are read again and give the bytes of those contexts, for the operator's own comparison.
4. ``collect``: removed windows meet their document again, which is cut in one pass.

A document is its ``IDENTITY``. Nothing is held by gram or by document beyond one document's own rows. Grams with more
than ``HOT`` distinct contexts are split into single windows that are dealt and sorted by their bytes. Those of
them that would weigh on one task of step 2 are known beforehand from a sample of documents and dealt by
gram and context there; the sample decides the way of their rows, never the result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import IDENTITY, as_bytes, carried, identity, need, settle, slices

SLICE_BYTES = 16_000_000
CONTEXT_BYTES = 4_000_000
#: Windows of a long text that are looked at together.
PIECE = 1 << 20
#: Distinct contexts of a gram beyond which it is split.
HOT = 4096
#: Documents sampled to foresee hot grams, contexts that a gram must have among them, and grams foreseen at most.
SAMPLE_DOCS = 4096
SAMPLE_CONTEXTS = 20
FORESEEN = 65_536
LOW = np.uint64(0xFFFFFFFF)
HIGH = np.uint64(0xFFFFFFFF00000000)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: One random-looking number for each byte value.
BYTE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


class _Powers:
    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            for name, factor in (("up", BASE), ("down", INVERSE)):
                steps = np.full(size, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))
        return cls.up, cls.down


@dataclass
class Units:
    """A text as units: unit i is data[begins[i]:ends[i]], or byte i where there are no begins."""

    data: bytes
    begins: np.ndarray | None = None
    ends: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.data) if self.begins is None else len(self.begins)

    def bytes_of(self, first: int, stop: int) -> bytes:
        """Units first to stop - 1."""
        if self.begins is None:
            return self.data[first:stop]
        return self.data[self.begins[first] : self.ends[stop - 1]]

    def grams(self, k: int, lo: int, hi: int) -> np.ndarray:
        """Hashes of the k-unit grams that start at units lo to hi - 1."""
        if self.begins is None:
            data = self.data[lo : hi + k - 1]
            s, e = np.arange(hi - lo), np.arange(k, hi - lo + k)
        else:
            base = self.begins[lo]
            data = self.data[base : self.ends[hi + k - 2]]
            s, e = self.begins[lo:hi] - base, self.ends[lo + k - 1 : hi + k - 1] - base
        up, down = _Powers.to(len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(BYTE[np.frombuffer(data, dtype=np.uint8)] * up[: len(data)], out=sums[1:])
        return _mixed((sums[e] - sums[s]) * down[s])


def as_byte_units(text: bytes | None) -> Units:
    return Units(text or b"")


def as_word_units(text: bytes | None) -> Units:
    """Words parted by ASCII white space, joined by one space."""
    data = b" ".join(text.split()) if text else b""
    if not data:
        return Units(b"", np.zeros(0, np.int64), np.zeros(0, np.int64))
    spaces = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 0x20)
    return Units(data, np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(data)]]))


@dataclass(frozen=True)
class Shape:
    """What a window is: units of the text, units of a window and of a gram."""

    units: Callable[[bytes | None], Units]
    window: int
    gram: int


def owners(units: Units, shape: Shape) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first window, windows, minimiser, gram hash) of each anchor, piece by piece."""
    span = shape.window - shape.gram + 1
    total = len(units) - shape.window + 1
    for begin in range(0, total, PIECE):
        n = min(PIECE, total - begin)
        hashes = units.grams(shape.gram, begin, begin + n + span - 1)
        least = (hashes & HIGH) | np.arange(len(hashes), dtype=np.uint64)
        width = 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: width - span], least[span - width :])
        at = (least & LOW).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        many = np.diff(np.concatenate([first, [n]]))
        yield begin + first, many, begin + at[first], hashes[at[first]]


def _contexts_of(units: Units, first: np.ndarray, many: np.ndarray, window: int) -> np.ndarray:
    """Hash of the bytes of each anchor's context."""
    stops = (first + many + window - 1).tolist()
    return np.array([xxhash.xxh3_64_intdigest(units.bytes_of(f, s)) for f, s in zip(first.tolist(), stops, strict=True)], dtype=np.uint64).view(np.int64)


def _sampled(shape: Shape):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            grams, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for text in as_bytes(batch.column("text")):
                units = shape.units(text)
                for first, many, _, gram in owners(units, shape):
                    grams.append(gram.view(np.int64))
                    found.append(_contexts_of(units, first, many, shape.window))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (grams, found)], names=["gram", "context"])

    return run


def foreseen(docs: DataFrame, shape: Shape) -> np.ndarray:
    """Sorted grams that a sample expects to have over ``HOT`` contexts; at most ``FORESEEN``, the commonest."""
    n = docs.count()
    if n <= SAMPLE_DOCS:
        return np.zeros(0, np.int64)
    share = SAMPLE_DOCS / n
    pairs = docs.select("text").sample(share, 7).mapInArrow(_sampled(shape), "gram long, context long").distinct()
    often = pairs.groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= max(SAMPLE_CONTEXTS, HOT * share))
    return np.sort(np.array([r[0] for r in often.orderBy(F.desc("n"), "gram").limit(FORESEEN).collect()], dtype=np.int64))


def _anchors(shape: Shape, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            parts: list[list[np.ndarray]] = [[] for _ in range(7)]
            for *who, text in zip(*[batch.column(c).to_pylist() for c in IDENTITY], as_bytes(batch.column("text")), strict=True):
                units = shape.units(text)
                for first, many, at, gram in owners(units, shape):
                    context = _contexts_of(units, first, many, shape.window)
                    own = [np.full(len(first), x) for x in who]
                    for part, x in zip(parts, (gram.view(np.int64), context, *own, first, (many << 8 | (at - first)).astype(np.int32)), strict=True):
                        part.append(x)
            if parts[0]:
                rows = [np.concatenate(p) for p in parts]
                state = _copies(*rows[:6])
                # A repeat is settled: it goes along under a key of its own place, not under the gram.
                lone = state == REPEAT
                state[np.isin(rows[0], hot) & ~lone] |= FLAG
                rows[0] = np.where(lone, _mixed((rows[3] ^ (rows[5] << 20)).view(np.uint64)).view(np.int64), rows[0])
                keep = state != AGAIN
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (*rows, state)], names=["gram", "context", *IDENTITY, "first", "meta", "state"])

    return run


#: What a slice knows of an anchor: the first of copies, nothing, a later copy, the same place of a repeated row.
KNOWN, PLAIN, REPEAT, AGAIN = 0, 1, 2, 3
#: Added to the state of anchors of foreseen hot grams.
FLAG = 4


def _copies(gram: np.ndarray, context: np.ndarray, *place: np.ndarray) -> np.ndarray:
    """State of each anchor among those of its slice: copies of a context are aggregated before they move."""
    state = np.full(len(gram), PLAIN, dtype=np.int32)
    order = np.argsort(context, kind="stable")
    same = context[order[1:]] == context[order[:-1]]
    twice = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    if len(twice):
        twice = twice[np.lexsort((*[x[twice] for x in place[::-1]], gram[twice], context[twice]))]
        now, before = twice[1:], twice[:-1]
        copy = (context[now] == context[before]) & (gram[now] == gram[before])
        again = copy.copy()
        for x in place:
            again &= x[now] == x[before]
        state[now[copy]] = REPEAT
        state[now[again]] = AGAIN
        lead = np.concatenate([[True], ~copy])
        group = np.cumsum(lead) - 1
        others = np.bincount(group, weights=np.concatenate([[False], copy & ~again])) > 0
        state[twice[lead]] = np.where(others, KNOWN, PLAIN)
    return state


def _classify(first_stays: bool):
    """Rows of (gram, context, identity, first, meta, state), sorted, to (kind, gram, ordinal, known, identity, first, meta).

    Kind 0: all windows of the anchor are repeats. Kind 1: the first of a context of a gram that has others;
    ``known`` says that a copy of it exists, ``ordinal`` counts the contexts of the gram. Kind 2: the same
    of a foreseen hot gram, whose other contexts are elsewhere.
    """

    def rows(kind, at: np.ndarray, ordinal: np.ndarray, known: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.broadcast_to(kind, len(at)).astype(np.int32)),
                pa.array(r[at, 0]),
                pa.array(ordinal.astype(np.int64)),
                pa.array(known),
                *[pa.array(r[at, i]) for i in (2, 3, 4, 5)],
                pa.array(r[at, 6].astype(np.int32)),
            ],
            names=["kind", "gram", "ordinal", "known", *IDENTITY, "first", "meta"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 8), dtype=np.int64)
        held_n, held_ordinal = 0, 0

        def work(r: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, held_n, held_ordinal
            new_gram = np.concatenate([[True], r[1:, 0] != r[:-1, 0]])
            new = new_gram | np.concatenate([[True], r[1:, 1] != r[:-1, 1]])
            begin = np.flatnonzero(new)
            count = np.diff(np.concatenate([begin, [len(r)]]))
            same_before = ~new_gram[begin]
            ordinal = np.arange(len(begin)) - np.maximum.accumulate(np.where(same_before, 0, np.arange(len(begin))))
            if held_n:
                count[0] += held_n - 1
                of_first = np.cumsum(~same_before) == 1
                ordinal[of_first] += held_ordinal
                same_before[0] = held_ordinal > 0
            repeat = np.flatnonzero(~new)
            if len(repeat):
                yield rows(0, repeat, np.zeros(len(repeat)), np.ones(len(repeat), bool), r)
            same_after = np.concatenate([same_before[1:], [False]])
            done = len(begin) if last else len(begin) - 1
            count += np.maximum.reduceat(r[:, 7] & ~FLAG == KNOWN, begin)
            known = count > 1
            if not first_stays and known[:done].any():
                also = np.flatnonzero(known[:done])
                yield rows(0, begin[also], np.zeros(len(also)), np.ones(len(also), bool), r)
            hot = r[begin, 7] & FLAG > 0
            open_ = np.flatnonzero((same_before | same_after | hot)[:done])
            if len(open_):
                yield rows(np.where(hot[open_], 2, 1), begin[open_], ordinal[open_], known[open_], r)
            if not last:
                held, held_n, held_ordinal = r[begin[-1] : begin[-1] + 1], int(count[-1]), int(ordinal[-1])

        before = np.zeros((0, 8), dtype=np.int64)
        for batch in batches:
            r = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(8)], axis=1)
            settled = np.flatnonzero(r[:, 7] == REPEAT)
            if len(settled):
                yield rows(0, settled, np.zeros(len(settled)), np.ones(len(settled), bool), r)
                r = r[r[:, 7] != REPEAT]
            both = np.concatenate([before, r])
            fresh = np.concatenate([[True] * bool(len(both)), (both[1:, :7] != both[:-1, :7]).any(axis=1)])[len(before) :]
            before = r[-1:] if len(r) else before
            if fresh.any():  # rows that repeat a document repeat its places
                yield from work(np.concatenate([held, r[fresh]]), False)
        if held_n:
            yield from work(held, True)

    return run


WHO = "doc long, m1 long, m2 long"
ANCHOR = f"gram long, context long, {WHO}, first long, meta int, state int"
PLACED = f"kind int, gram long, ordinal long, known boolean, {WHO}, first long, meta int"
CONTEXT = f"shard long, known boolean, {WHO}, first long, meta int, lead binary, bytes binary"


def keyed(docs: DataFrame) -> DataFrame:
    """(row, identity, text): rows that repeat id and text are one document."""
    need(docs, "doc_id", "text")
    return docs.select(carried(docs, "text"), *identity(), "text")


def placed(docs: DataFrame, shape: Shape, first_stays: bool) -> DataFrame:
    """Steps 1 and 2, settled. docs: from ``keyed``."""
    found = docs.select(*IDENTITY, "text").mapInArrow(_anchors(shape, foreseen(docs, shape)), ANCHOR)
    route = F.when(F.col("state") >= FLAG, F.xxhash64("gram", "context")).otherwise(F.col("gram"))
    met = found.repartition(route).sortWithinPartitions("gram", "context", *IDENTITY, "first", "state")
    return settle(met.mapInArrow(_classify(first_stays), PLACED), "anchors")


def with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs with ``found``: the array of a document's rows, of which there are fewer than units in its text."""
    fields = [c for c in rows.columns if c not in IDENTITY]
    per = rows.groupBy(*IDENTITY).agg(F.collect_list(F.struct(*fields)).alias("found"))
    return docs.join(per.hint("shuffle_hash"), list(IDENTITY), "left")


def _contexts(shape: Shape):
    types = (pa.int64(), pa.bool_(), *[pa.int64()] * 4, pa.int32(), pa.binary(), pa.binary())
    names = [c.split()[0] for c in CONTEXT.split(", ")]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        for batch in slices(batches, "text", CONTEXT_BYTES):
            for *who, text, found in zip(*[batch.column(c).to_pylist() for c in IDENTITY], as_bytes(batch.column("text")), batch.column("found").to_pylist(), strict=True):
                units = shape.units(text)
                for a in found:
                    first, many, at = a["first"], a["meta"] >> 8, a["meta"] & 0xFF
                    if a["hot"]:
                        for i in range(many):
                            window = units.bytes_of(first + i, first + i + shape.window)
                            out.append((None, a["known"], *who, first + i, 1 << 8, None, window))
                            size += len(window)
                    else:
                        lead = units.bytes_of(first + at, first + at + shape.gram)
                        context = units.bytes_of(first, first + many + shape.window - 1)
                        out.append((a["gram"], a["known"], *who, first, a["meta"], lead, context))
                        size += len(context)
                    if size >= CONTEXT_BYTES:  # windows of hot grams overlap: they leave in small batches
                        yield packed(out)
                        out, size = [], 0
        if out:
            yield packed(out)

    return run


def contexts(docs: DataFrame, found: DataFrame, shape: Shape) -> DataFrame:
    """Step 3: the bytes of the contexts that are to be compared (single windows, without shard, for hot grams)."""
    asked = found.filter("kind > 0")
    many = asked.filter((F.col("kind") == 1) & (F.col("ordinal") == HOT)).select("gram", F.lit(True).alias("many"))
    hot = F.coalesce("many", F.col("kind") == 2).alias("hot")
    asked = asked.join(many, "gram", "left").select(*IDENTITY, "gram", "known", "first", "meta", hot)
    # All columns go along, unused: the exchange of the texts is then the one that ``collect`` needs too.
    return with_text(docs, asked).filter("found is not null").mapInArrow(_contexts(shape), CONTEXT)


def _adjacent(first_stays: bool):
    """Single windows sorted by bytes and place: equal neighbours are repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, told, place = None, True, None
        for batch in batches:
            out = []
            for known, *now, window in zip(*[batch.column(c).to_pylist() for c in ("known", *IDENTITY, "first", "bytes")], strict=True):
                if place == now:  # a row that repeats a document
                    continue
                place = now
                if before is not None and window == before[1]:
                    out.append(now)
                    if not told and not first_stays:
                        out.append(before[0])
                    told = True
                else:
                    before, told = (now, window), known
            if out:
                *who, first = (np.array(x) for x in zip(*out, strict=True))
                yield removed(who, first, np.ones(len(out), np.int64))

    return run


def removed(who: list[np.ndarray], first: np.ndarray, many: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (*who, first)], pa.array(many.astype(np.int32))], names=[*IDENTITY, "first", "many"])


REMOVED = f"{WHO}, first long, many int"


def hot_repeats(parts: DataFrame, first_stays: bool) -> DataFrame:
    """Repeats among the single windows of hot grams: sampled splitters deal them by bytes, a sort brings equals together."""
    single = parts.filter("shard is null").select("known", *IDENTITY, "first", "bytes")
    return single.repartitionByRange("bytes").sortWithinPartitions("bytes", *IDENTITY, "first").mapInArrow(_adjacent(first_stays), REMOVED)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int) -> Iterator[pa.Table]:
    """Tables of up to ``most`` rows (more only for one key) that never part rows of one key; rows come sorted by it."""
    held: list[pa.RecordBatch] = []
    size = 0

    def pieces(rows: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
        keys = rows.column(key).combine_chunks()
        new = np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1
        borders = [*new.tolist(), *([len(keys)] if last else [])]
        out, begin, end = [], 0, 0
        for b in borders:
            if b - begin > most and end > begin:
                out.append(rows.slice(begin, end - begin))
                begin = end
            end = b
        if end > begin:
            out.append(rows.slice(begin, end - begin))
        return out, rows.slice(end)

    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            done, rest = pieces(pa.Table.from_batches(held).combine_chunks(), False)
            yield from done
            held, size = rest.combine_chunks().to_batches(), rest.num_rows
    if size:
        yield from pieces(pa.Table.from_batches(held).combine_chunks(), True)[0]


def once(rows: pa.Table) -> pa.Table:
    """Rows that repeat a document give the same contexts twice: keep one of each place."""
    place = np.stack([np.asarray(rows.column(c)).astype(np.int64) for c in (*IDENTITY, "first")], axis=1)
    order = np.lexsort(place.T[::-1])
    new = np.concatenate([[True], (place[order][1:] != place[order][:-1]).any(axis=1)])
    return rows if new.all() else rows.take(pa.array(np.sort(order[new])))


def runs_of(rows: pa.Table, item: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    """Removed windows (item, offset), sorted, as rows of consecutive windows."""
    *who, first = (np.asarray(rows.column(c)) for c in (*IDENTITY, "first"))
    begin = np.flatnonzero(np.concatenate([[True], (item[1:] != item[:-1]) | (offset[1:] != offset[:-1] + 1)])) if len(item) else np.zeros(0, np.int64)
    many = np.diff(np.concatenate([begin, [len(item)]]))
    return removed([x[item[begin]] for x in who], first[item[begin]] + offset[begin], many)


def covered(n: int, found: list[dict] | None, window: int) -> np.ndarray:
    """Which of n units the removed windows cover."""
    delta = np.zeros(n + 1, dtype=np.int64)
    if found:
        first = np.array([f["first"] for f in found])
        np.add.at(delta, first, 1)
        np.add.at(delta, first + np.array([f["many"] for f in found]) + window - 1, -1)
    return np.cumsum(delta[:-1]) > 0


def collect(docs: DataFrame, found: DataFrame, rest: DataFrame) -> DataFrame:
    """Step 4: docs with the removed windows of both ways."""
    whole = found.filter("kind = 0").select(*IDENTITY, "first", F.shiftright("meta", 8).alias("many"))
    return with_text(docs, whole.unionByName(rest)).select("row", "text", "found")
