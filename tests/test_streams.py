"""State of streams over several micro-batches, a restart, ends of state, failing batches and late rows."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from curatrix.streaming import flags

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
KIND = "element long, place long, seen string, at timestamp"


def put(spark, folder, number, rows):
    """One file, its rows shuffled; modification times ascend with the number."""
    random.Random(number).shuffle(rows)
    df = spark.createDataFrame([(e, p, s, START + dt.timedelta(minutes=p)) for e, p, s in rows], KIND).coalesce(1)
    df.write.mode("append").parquet(folder)
    new = max((f"{folder}/{n}" for n in os.listdir(folder) if n.endswith(".parquet")), key=os.path.getctime)
    os.utime(new, (1_700_000_000 + number, 1_700_000_000 + number))


def stream(spark, folder):
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(folder)


def walked(rows, first=True):
    last, out = {}, []
    for e, p, s in sorted(rows, key=lambda r: r[1]):
        if (s != last[e]) if e in last else first:
            out.append((e, p, s))
        last[e] = s
    return sorted(out)


@pytest.mark.parametrize("first", [True, False])
def test_changes_over_batches_and_a_restart(spark, tmp_path, first):
    rng = random.Random(1)
    rows = [(k % 7, k, rng.choice([None, "a", "b"])) for k in range(600)]
    folder, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    for n in range(2):
        put(spark, folder, n, rows[n * 200 : n * 200 + 200])
    flags.run_to_table(flags.changes(stream(spark, folder), "element", "place", "seen", first), "x", out)
    put(spark, folder, 2, rows[400:])
    got = flags.run_to_table(flags.changes(stream(spark, folder), "element", "place", "seen", first), "x", out)
    assert sorted(map(tuple, got.collect())) == walked(rows, first)


def test_state_ends_and_a_key_begins_anew(spark, tmp_path):
    folder, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    put(spark, folder, 0, [(1, 0, "a"), (2, 0, "a"), (1, 1, "a")])
    put(spark, folder, 1, [(2, 50, "a")])  # 50 minutes after the one before: kept for 30
    put(spark, folder, 2, [(1, 60, "a"), (2, 61, "a")])
    put(spark, folder, 3, [(2, 62, "a"), (3, 2, "late")])
    put(spark, folder, 4, [(2, 500, "b")])
    got = flags.run_to_table(flags.changes(stream(spark, folder), "element", "place", "seen", at="at", keep="30 minutes"), "x", out)
    assert sorted(map(tuple, got.collect())) == [(1, 0, "a"), (1, 60, "a"), (2, 0, "a"), (2, 50, "a"), (2, 500, "b")]
    held = spark.read.format("statestore").option("path", f"{out}-log").option("stateVarName", "last").load().select("key.element").collect()
    assert [r.element for r in held] == [2]  # the others' state is gone


def test_rows_of_a_hot_key_are_sorted_on_disk():
    rng = random.Random(4)
    rows = [Row(place=rng.randrange(50), own=k) for k in range(1000)]
    for most in (1, 7, 100, 1000, 1001):
        assert list(flags.in_order(iter(rows), "place", most)) == sorted(rows, key=lambda r: r.place)
    assert list(flags.in_order(iter([]), "place", 5)) == []


def test_a_broken_file_goes_to_quarantine(spark, tmp_path):
    folder, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    for n in range(3):
        put(spark, folder, n, [(1, n, "a")])
    names = sorted((n for n in os.listdir(folder) if n.endswith(".parquet")), key=lambda n: os.path.getmtime(f"{folder}/{n}"))
    bad = f"{folder}/{names[1]}"
    with open(bad, "wb") as file:
        file.write(b"no table")
    os.utime(bad, (1_700_000_001, 1_700_000_001))
    got = flags.run_by_batches(stream(spark, folder), "x", out=out)
    assert sorted(r.place for r in got.collect()) == [0, 2]
    (failed,) = flags.quarantined(spark, out).collect()
    assert failed.batch == 1 and [f.rsplit("/", 1)[1] for f in failed.files] == [names[1]] and failed.message
    # the run goes on from there, and the quarantine stays
    put(spark, folder, 9, [(1, 9, "a")])
    assert sorted(r.place for r in flags.run_by_batches(stream(spark, folder), "x", out=out).collect()) == [0, 2, 9]
    assert flags.quarantined(spark, out).count() == 1
    assert flags.quarantined(spark, f"file://{tmp_path}/none").count() == 0


def test_drift_is_told_of_closed_windows_only(spark, tmp_path):
    folder, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    put(spark, folder, 0, [(1, p, "a" if p < 50 else "b") for p in range(0, 70)])
    put(spark, folder, 1, [(1, p, "b") for p in range(70, 100)])
    put(spark, folder, 2, [(1, 200, "a"), (1, 30, "b")])  # at 30: late, that window is closed
    baseline = spark.createDataFrame([("a", 0.8), ("b", 0.2)], "seen string, rate double")
    counts = flags.rate_drift(stream(spark, folder), "at", "seen", "1 hour", "5 minutes", baseline, 0.1)
    got = flags.run_by_batches(counts, "x", out=out).withColumn("hour", F.hour("start")).select("hour", "seen", "n", "total", "drifted")
    assert sorted(map(tuple, got.collect())) == [(0, "a", 50, 60, False), (0, "b", 10, 60, False), (1, "a", 0, 40, True), (1, "b", 40, 40, True)]
