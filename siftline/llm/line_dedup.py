"""Line dedup on levelled sorted runs of line hashes.

``LineRuns`` is a log-structured index. A run is a table bucketed and sorted by line hash in the shared folder. Each new
batch merge-anti-joins the runs: a line that none holds enters the batch's run with its documents and largest document id,
so every line lies in one run only; a line that a run holds is no line of the new run but a change of that one's counts.
``fanout`` runs of a level are compacted into one of the next: lines are merged as they are, changes are summed. Counts are
put together at the end, where only changed lines are summed again. A batch moves once, into its buckets, where the joins
with the runs read bucket by bucket and move nothing; a compaction moves a line once for each level. Neither a lost
executor nor the driver holds any of the index.

Keys are 128-bit XXH3 hashes of the normalised line.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siftline.llm.common import IDENTITY, NULL_ID, as_bytes, carried, forget, fresh_path, identity, need, row_schema, settle, shuffle_partitions, slices, table

MIN_CHARS = 40
MIN_DOCS = 5
#: Batches the documents of one call are ingested in, and runs of a level that are merged into one.
BATCHES = 4
FANOUT = 4
SLICE_BYTES = 16_000_000


def line_keys(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """The lines of a text, and each one's key hash (None where the key is shorter than ``min_chars``)."""
    lines = (text or b"").split(b"\n")
    keys: list[bytes | None] = []
    for line in lines:
        key = None
        if len(line) >= min_chars:
            line = line.strip().lower()  # of bytes: ASCII white space and A-Z only
            if len(line) >= min_chars and (line.isascii() or len(line.decode()) >= min_chars):
                key = xxhash.xxh3_128_digest(line)
        keys.append(key)
    return lines, keys


def _split(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            hashes: list[bytes] = []
            rows: list[int] = []
            for i, text in enumerate(as_bytes(batch.column("text"))):
                own = {k for k in line_keys(text, min_chars)[1] if k}
                hashes += own
                rows += [i] * len(own)
            halves = np.frombuffer(b"".join(hashes), dtype=">i8").astype(np.int64).reshape(-1, 2)
            of = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), *[batch.column(c).take(of) for c in ("doc_id", "m1", "m2")]],
                names=["h1", "h2", "doc_id", "m1", "m2"],
            )

    return run


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, doc_id, m1, m2): the distinct keys of each document row, with its id and the rest of its identity."""
    need(docs, "doc_id", "text")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *identity()[1:], "text")
    return own.mapInArrow(_split(min_chars), "h1 long, h2 long, doc_id long, m1 long, m2 long")


RUN = "h1 long, h2 long, n_docs long, max_doc long, known boolean"
KEY = ["h1", "h2"]


class LineRuns:
    """Levels of sorted runs: h1, h2, n_docs, max_doc, known. Rows that were not ``known`` are the run's lines, each in no other
    run; ``known`` ones are changes of lines of earlier runs. The tables live in a database of their own until ``close``."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        # As many as the session's partitions: where a task holds rows of other buckets, each task writes a file for each of them.
        self.buckets = shuffle_partitions(spark)
        self.levels: list[list[DataFrame]] = []
        self.changes: list[DataFrame] = []
        self._names: dict[int, str] = {}
        path = fresh_path(spark, "runs")
        self.database = "siftline_" + path.rpartition("-")[2]
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{path}'")

    def close(self) -> None:
        """Drop the runs, tables and files."""
        for run in self.runs():
            self._forget(run)
        for change in self.changes:
            forget(self.spark, change)
        self.levels, self.changes = [], []
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def unseen(self, hashes: DataFrame) -> DataFrame:
        """Rows of ``hashes`` whose line is in no run."""
        for run in self.runs():
            hashes = hashes.join(run.filter("not known"), KEY, "left_anti")
        return hashes

    def _write(self, rows: DataFrame, level: int) -> None:
        path = fresh_path(self.spark, f"run-l{level}")
        name = f"{self.database}.run_" + path.rpartition("-")[2]
        writer = rows.select(*StructType.fromDDL(RUN).names).write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
        writer.option("compression", "zstd").option("path", path).saveAsTable(name)
        run = self.spark.table(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        self._names[id(run)] = name

    def _files(self, runs: list[DataFrame]) -> DataFrame:
        """Runs as one table. Their files are read plainly: a union of bucketed scans is taken for one that is partitioned by bucket."""
        return self.spark.read.schema(RUN).parquet(*sorted({f.rpartition("/")[0] for run in runs for f in run.inputFiles()}))

    def _forget(self, run: DataFrame) -> None:
        forget(self.spark, run)
        self.spark.sql(f"DROP TABLE IF EXISTS {self._names.pop(id(run))}")

    def ingest(self, hashes: DataFrame) -> None:
        """Merge-anti-join a batch with the runs, add it as a run, then compact the levels that are full."""
        # Summed up before it moves; the groups then lie as the buckets do.
        batch = hashes.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))
        known = F.lit(False)
        for i, run in enumerate(self.runs()):
            held = run.filter("not known").select(*KEY, F.lit(True).alias(f"in_{i}"))
            batch = batch.join(held.hint("merge"), KEY, "left")
            known = known | F.coalesce(F.col(f"in_{i}"), F.lit(False))
        self._write(batch.withColumn("known", known), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            merged = self._files(full)
            changed, before = self._summed([merged.filter("known").drop("known"), *self.changes]), self.changes
            self.changes = [settle(changed, "changes")]
            self._write(merged.filter("not known").repartition(self.buckets, *KEY), level + 1)
            for run in full:
                self._forget(run)
            for change in before:
                forget(self.spark, change)
            level += 1

    def _summed(self, changes: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionByName, changes).groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"))

    def frequent(self, min_docs: int) -> DataFrame:
        """(h1, h2, max_doc) of the lines that at least ``min_docs`` ingested documents hold."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long, max_doc long")
        changes = self._summed([*[r.filter("known").drop("known") for r in runs], *self.changes]).select(*KEY, F.col("n_docs").alias("more"), F.col("max_doc").alias("later"))
        changes = settle(changes, "changes")
        each = [r.filter("not known").join(changes, KEY, "left").filter(F.col("n_docs") + F.coalesce("more", F.lit(0)) >= min_docs) for r in runs]
        return reduce(DataFrame.unionByName, [f.select(*KEY, F.greatest("max_doc", "later").alias("max_doc")) for f in each])


def _drop(min_chars: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            n_lines, n_dropped, kept = [], [], []
            for text, gone in zip(as_bytes(batch.column("text")), batch.column("gone").to_pylist(), strict=True):
                if gone:
                    lines, keys = line_keys(text, min_chars)
                    gone = set(gone)
                    stay = [line for line, key in zip(lines, keys, strict=True) if key not in gone]
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                    text = b"\n".join(stay)
                else:
                    text = text or b""
                    n_lines.append(text.count(b"\n") + 1)
                    n_dropped.append(0)
                kept.append(hashlib.sha256(text).hexdigest() if digest else text.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                names=["row", "n_lines", "n_dropped", "kept"],
            )

    return run


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    digest: bool = False,
) -> DataFrame:
    """Drop lines whose key at least ``min_docs`` documents hold, but for those of the largest doc_id holding it.

    Returns ``row`` (a struct of all input columns but text), n_lines, n_dropped and kept: the lines that stay,
    joined by newline, or with ``digest`` their SHA-256.

    A key is the line without ASCII white space at both ends, A-Z in lower case. Null and empty texts are one
    empty line. Each row counts as a document: rows that repeat a doc_id are separate ones, and where it is the
    largest of a key, all of them keep their lines. A null doc_id ranks below all others; if only rows
    with a null doc_id hold a key, all of them keep it. Very long texts are taken whole. Other columns are carried
    unread, whatever they are called; an empty table gives an empty result.
    """
    need(docs, "doc_id", "text")
    spark = docs.sparkSession
    path = fresh_path(spark, "lines")
    part = F.pmod(F.xxhash64("doc_id", "m1"), F.lit(batches)).cast("int").alias("part")
    # Sorted by batch, so that a batch skips the row groups of the others.
    line_hashes(docs, min_chars).select("*", part).sortWithinPartitions("part").write.option("compression", "zstd").parquet(path)
    hashes = spark.read.schema("h1 long, h2 long, doc_id long, m1 long, m2 long, part int").parquet(path)
    index = LineRuns(spark)
    try:
        for b in range(batches):
            index.ingest(hashes.filter(F.col("part") == b))
        # Settled, its size is known: a small table is broadcast, and beside a larger one the rows of a very common line can be split.
        frequent = settle(index.frequent(min_docs), "frequent")
    finally:
        index.close()
    gone = (
        hashes.join(frequent, ["h1", "h2"])
        .filter(F.col("doc_id").isNull() & F.col("max_doc").isNotNull() | (F.col("doc_id") < F.col("max_doc")))
        .withColumn("h", F.concat(F.unhex(F.lpad(F.hex("h1"), 16, "0")), F.unhex(F.lpad(F.hex("h2"), 16, "0"))))
        .groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "m1", "m2")
        .agg(F.collect_set("h").alias("gone"))  # no more than the document has lines
    )
    own = docs.select(carried(docs, "text"), *identity(), "text")
    joined = own.join(gone.hint("shuffle_hash"), list(IDENTITY), "left").select("row", "text", "gone")
    return joined.mapInArrow(_drop(min_chars, digest), row_schema(joined, "n_lines long, n_dropped long, kept string"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, digest=True).select("row.doc_id", "n_lines", "n_dropped", F.col("kept").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS own FROM documents
), lines AS (
  SELECT r, doc_id, pos, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT r, doc_id, unnest(own) AS line, unnest(generate_series(1, len(own))) AS pos FROM docs)
), frequent AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5
), judged AS (
  SELECT l.r, l.doc_id, l.pos, l.line, coalesce(f.keeper > coalesce(l.doc_id, f.keeper - 1), false) AS gone
  FROM lines l LEFT JOIN frequent f ON l.key = f.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN gone THEN NULL ELSE line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM judged GROUP BY r
"""
