"""Commits of the cache under several builders, ranks of nearly dependent columns, and streams that come out of order."""

import datetime
import os
import shutil
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.operators import pairs, transitions
from pathloom.sources.cache import cached, fingerprint
from pathloom.streaming.transitions import STORE, stream_events


def test_cache_is_built_once(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    key = fingerprint(version=1, layer="last")
    assert key == fingerprint(layer="last", version=1) != fingerprint(layer="last", version=2)
    for _ in range(2):
        assert cached(spark, str(tmp_path), key, build).count() == 3
    assert built == [1]


def test_two_builders_leave_one_result(spark, tmp_path):
    """Both wait for each other before they write, so that both have built; a broken-off attempt is never read."""
    barrier, got = threading.Barrier(2), []

    def build(n):
        barrier.wait(30)
        return spark.range(1000 * n).withColumn("who", F.lit(n))

    threads = [threading.Thread(target=lambda n=n: got.append(cached(spark, str(tmp_path), "k", lambda: build(n)).agg(F.count("id"), F.max("who")).first())) for n in (1, 2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert len(got) == 2 and got[0] == got[1] and got[0][0] == 1000 * got[0][1]
    names = [x for x in os.listdir(tmp_path) if not x.startswith(".")]
    assert len(names) == 2 and "k.json" in names
    os.makedirs(tmp_path / "other.deadbeef")  # what a builder that broke off leaves

    def failing():
        raise RuntimeError("broke off")

    with pytest.raises(RuntimeError):
        cached(spark, str(tmp_path), "other", failing)
    assert cached(spark, str(tmp_path), "other", lambda: spark.range(4)).count() == 4


def test_rank_of_nearly_dependent_columns(spark):
    """Columns that differ by a billionth are told apart, as the dense decomposition does; equal ones are not."""
    rng = np.random.default_rng(0)
    n = 400
    base, noise, third = rng.normal(size=n), rng.normal(size=n), rng.normal(size=n)
    source = np.repeat(np.arange(20), 20)
    columns = {"a": base, "b": base + 1e-9 * noise, "c": third, "d": base + third, "e": source.astype(float), "f": base}
    df = spark.createDataFrame([("t", int(source[i]), i, *(float(c[i]) for c in columns.values())) for i in range(n)], "text_id string, src_word long, dst_word long, " + ", ".join(f"{c} double" for c in columns))
    for names in (("a", "b"), ("a", "f"), ("a", "c", "d"), ("a", "b", "c", "d", "e", "f"), ("e",), ("c",)):
        x = np.column_stack([columns[c] for c in names])
        means = np.stack([x[source == s].mean(0) for s in range(20)])[source]
        assert pairs.design_rank(df.repartition(5), names) == np.linalg.matrix_rank(x - means), names
    assert pairs.design_rank(df, ()) == 0 and pairs.design_rank(df.where("false"), ("a",)) == 0


START = datetime.datetime(2026, 1, 1)
SCHEMA = "subject_id string, text_id string, word_index long, line_id long, fixation_order long, ts timestamp"


@pytest.fixture()
def run_stream(spark, tmp_path):
    """Events of batches of (subject, word, line, order, seconds), read one file a batch."""
    for k, v in STORE.items():
        spark.conf.set(k, v)

    def run(batches, delay="100 seconds", idle=3600):
        folder = tmp_path / "in"
        os.makedirs(folder)
        for i, rows in enumerate(batches):
            timed = [(s, "t:1", w, line, o, START + datetime.timedelta(seconds=x)) for s, w, line, o, x in rows]
            spark.createDataFrame(timed, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
            (part,) = [f for f in os.listdir(tmp_path / f"b{i}") if f.endswith(".parquet")]
            shutil.copy(tmp_path / f"b{i}" / part, folder / f"{i}.parquet")
            os.utime(folder / f"{i}.parquet", (1e9 + 10 * i, 1e9 + 10 * i))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
        query = stream_events(stream, delay, idle).writeStream.format("memory").queryName("visits_out").outputMode("append")
        query.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(180)
        return spark.table("visits_out").collect()

    yield run
    for k in STORE:
        spark.conf.unset(k)


def test_any_order_within_the_delay_gives_the_batch_result(spark, run_stream):
    rng = np.random.default_rng(6)
    visits = [(f"s{s}", int(rng.integers(0, 9)), int(rng.integers(0, 2)), o, 30 * o + 7 * s) for s in range(3) for o in range(14)]
    shuffled = sorted(visits, key=lambda v: v[4] + rng.uniform(-90, 90) / 2)
    batches = [shuffled[i : i + 11] for i in range(0, len(shuffled), 11)] + [[("end", 0, 0, 0, 5000)]]
    got = run_stream(batches)
    assert not any(r.late for r in got)
    table = spark.createDataFrame([(s, "t:1", w, o, 1.0, line) for s, w, line, o, _ in visits], "subject_id string, text_id string, word_index long, fixation_order long, duration_ms double, line_id long")
    want = transitions.extract_events(table).select("subject_id", "src_word", "dst_word", "event_type").collect()
    assert sorted((r.subject_id, r.src_word, r.dst_word, r.event_type) for r in got) == sorted(map(tuple, want))


def test_late_visits_are_counted_and_idle_state_goes(run_stream):
    got = run_stream(
        [
            [("s", 0, 0, 0, 0), ("s", 2, 0, 2, 20)],
            [("s", 1, 0, 1, 10), ("s", 5, 1, 4, 200)],
            [("s", 9, 0, 9, 2000), ("s", 3, 1, 3, 30)],
            [("x", 1, 0, 1, 9000)],
            [("x", 1, 0, 2, 9001), ("x", 1, 0, 3, 20_000)],
            [("end", 0, 0, 0, 40_000)],
            [("end", 0, 0, 1, 40_001)],
        ]
    )
    events = sorted((r.subject_id, r.src_word, r.dst_word, r.event_type) for r in got if r.late is None)
    assert events == [("s", 0, 1, "forward"), ("s", 1, 2, "forward"), ("s", 2, 5, "line_return"), ("s", 5, 9, "forward"), ("x", 1, 1, "refixation")]
    assert [(r.subject_id, r.late) for r in got if r.late is not None] == [("s", 1)]
