import json
import logging
import os
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import external_audit, sequence_intake
from jobs.common import config
from siftline.operators import ranking

ROOT = Path(__file__).resolve().parents[1]


def rows(frame):
    return sorted((str(r) for r in frame.collect()))


def documents(spark, first, last):
    return spark.createDataFrame([(i, f"acDEKr-f{i}" * 20 if i % 5 else [None, "", "--|"][i % 3], "en" if i % 2 else [None, "", "d/e", "7"][i // 2 % 4]) for i in range(first, last)], "doc_id long, text string, lang string")


def test_intake_takes_only_new_files(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    settings = config(sequence_intake.SETTINGS) | {"files_per_batch": 2}
    source, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    documents(spark, 0, 60).repartition(5).write.parquet(source)
    assert sequence_intake.run(spark, source, out, mark, settings) == {"accepted": 48, "rejected": 12}
    first = rows(sequence_intake.output(spark, source, out, settings))
    assert sequence_intake.run(spark, source, out, mark, settings) == {"accepted": 0, "rejected": 0}
    assert rows(sequence_intake.output(spark, source, out, settings)) == first
    documents(spark, 60, 100).union(spark.createDataFrame([(None, "ACDK", "en"), (1, "ACDK", "en")], "doc_id long, text string, lang string")).write.mode("append").parquet(source)
    assert sequence_intake.run(spark, source, out, mark, settings) == {"accepted": 33, "rejected": 9}
    after = sequence_intake.output(spark, source, out, settings)
    assert set(first) < set(rows(after))
    # Both runs together are what one run over everything gives.
    other = f"file://{tmp_path}/other"
    sequence_intake.run(spark, source, other, f"{other}-mark", settings)
    assert rows(sequence_intake.output(spark, source, other, settings)) == rows(after)
    assert {(r.status, r.part) for r in after.select("status", "part").distinct().collect()} >= {("accepted", "en"), ("accepted", "unknown"), ("accepted", "d/e"), ("accepted", "7"), ("rejected", "en")}
    assert {r.reason for r in after.filter("status = 'rejected'").collect()} == {"no id", "no sequence"}
    assert "read 42 new rows" in caplog.text and "wrote 33 accepted and 9 rejected" in caplog.text
    assert (tmp_path / "out/status=accepted/part=en").is_dir()


def test_intake_of_one_file(spark, tmp_path):
    documents(spark, 0, 20).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    (next((tmp_path / "in").glob("part-*"))).rename(tmp_path / "one.parquet")
    where = [f"file://{tmp_path}/{n}" for n in ("one.parquet", "out", "mark")]
    settings = config(sequence_intake.SETTINGS)
    assert [sequence_intake.run(spark, *where, settings)["accepted"] for _ in range(2)] == [16, 0]


def test_intake_goes_on_where_a_run_broke_off(spark, tmp_path):
    """A file that cannot be read fails a run after some batches; the next run takes what is left, each row once."""
    settings = config(sequence_intake.SETTINGS) | {"files_per_batch": 1}
    source, out, mark = (f"file://{tmp_path}/{n}" for n in ("in", "out", "mark"))
    documents(spark, 0, 20).coalesce(1).write.parquet(source)
    documents(spark, 20, 40).coalesce(1).write.mode("append").parquet(source)
    good = sorted((tmp_path / "in").glob("part-*"))[0].read_bytes()
    broken = tmp_path / "in/part-zzz-broken.parquet"
    os.utime(sorted((tmp_path / "in").glob("part-*"))[0], (1, 1))
    broken.write_bytes(good[:200])
    with pytest.raises(Exception):  # noqa: B017
        sequence_intake.run(spark, source, out, mark, settings)
    # The file is mended under its name: the batch that failed is planned already and reads it now.
    documents(spark, 40, 60).coalesce(1).write.parquet(f"file://{tmp_path}/mended")
    broken.write_bytes(next((tmp_path / "mended").glob("part-*")).read_bytes())
    for crc in (tmp_path / "in").glob(".*.crc"):
        crc.unlink()
    sequence_intake.run(spark, source, out, mark, settings)
    held = sequence_intake.output(spark, source, out, settings)
    assert held.count() == 60 and held.select("id").distinct().count() == 60


def test_intake_wants_its_columns(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/in")
    with pytest.raises(ValueError, match="missing columns"):
        sequence_intake.run(spark, *[f"file://{tmp_path}/{n}" for n in ("in", "out", "mark")], config(sequence_intake.SETTINGS))


def orders(spark, folder, n=200, flip=False):
    data = [(i, 100.0 * i, "ABC"[i % 3] if i % 7 else None) for i in range(n)]
    lines = [(i, (-i if flip else i) + (i * 37 % 11) * 10.0, float(i * 17 % 50)) for i in range(n) if i % 13] * 2
    spark.createDataFrame(data, "o_orderkey long, o_totalprice double, o_orderpriority string").write.mode("overwrite").parquet(f"{folder}/orders")
    spark.createDataFrame(lines, "l_orderkey long, l_extendedprice double, l_quantity double").write.mode("overwrite").parquet(f"{folder}/lines")


def test_audit_reruns_alike_and_is_held_to_its_choice(spark, tmp_path):
    folder, settings = f"file://{tmp_path}", config(external_audit.SETTINGS)
    orders(spark, folder)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    job = lambda: external_audit.run(spark, f"{folder}/orders", f"{folder}/lines", f"{folder}/out", settings)
    held = job()
    first = {n: rows(external_audit.output(spark, f"{folder}/out", n)) for n in held}
    spec = sorted(json.loads(x)["model"] for f in (tmp_path / "out/spec").glob("part-*") for x in f.read_text().splitlines())
    assert spec == ["by_price"] * 4 and held["audit"] == 4
    assert job() == held and {n: rows(external_audit.output(spark, f"{folder}/out", n)) for n in held} == first
    found = {r.assay: r for r in external_audit.output(spark, f"{folder}/out", "audit").collect()}
    assert found["A"].external_spearman > 0.75 and found["A"].verdict == "EXTERNAL TRIAGE HOLDS" and found["A"].use == "useful" and found["A"].null_p < 0.05 and "unknown" in found
    work = external_audit.output(spark, f"{folder}/out", "worklist").collect()
    assert {r.tail for r in work} == {"both", "truth", "prediction"} and all(r.id % 5 == 0 and r.id % 13 for r in work)
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before
    orders(spark, folder, flip=True)
    with pytest.raises(ValueError, match="frozen"):
        job()
    assert {n: rows(external_audit.output(spark, f"{folder}/out", n)) for n in held} == first


def test_audit_ranks_external_rows_once(spark, tmp_path, monkeypatch):
    """Scores, shuffles and worklist share one ranking of the external rows: each side of them and of the internal ones is ranked once."""
    folder, settings, ranked = f"file://{tmp_path}", config(external_audit.SETTINGS), []
    orders(spark, folder)
    monkeypatch.setattr(ranking, "value_positions", lambda rows, by, c, *more, own=ranking.value_positions: ranked.append(c) or own(rows, by, c, *more))
    external_audit.run(spark, f"{folder}/orders", f"{folder}/lines", f"{folder}/out", settings)
    assert sorted(ranked) == ["x", "x", "y", "y"]


def test_command_line(tmp_path, spark):
    documents(spark, 0, 20).write.parquet(f"file://{tmp_path}/in")
    settings = tmp_path / "own.json"
    settings.write_text(json.dumps(config(sequence_intake.SETTINGS)))
    command = [sys.executable, "-m", "jobs.sequence_intake", "--source", f"{tmp_path}/in", "--out", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", str(settings)]
    done = subprocess.run(command, cwd=ROOT, capture_output=True, text=True, timeout=180, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert done.returncode == 0 and "wrote 16 accepted and 4 rejected rows" in done.stderr, done.stderr[-2000:]
