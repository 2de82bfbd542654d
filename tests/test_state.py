"""State that waits, expires and is put into stores: against batch twins, in any order, with crashes between steps."""

import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from axisframe.streaming import ordered, store
from axisframe.streaming.streams import run_once

LOG = "key long, version long, kind string, payload string"


def twin(rows):
    """The end of each key's log, in order of versions."""
    out = {}
    for key in sorted({r[0] for r in rows}):
        own = {v: (kind, p) for k, v, kind, p in rows if k == key}
        at, text, ok = ordered.caught_up(-1, None, False, own)
        out[key] = (at, text, ok and not own)
    return out


def replay(spark, path, batches, **options):
    """What a stream over the batches leaves for each key: the row of the last batch that told one. With a time limit the query
    runs on after each batch, long enough for timers; without one it ends."""
    told = []
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(f"{path}/log")
        out = ordered.change_log_in_any_order(spark.readStream.schema(LOG).parquet(f"{path}/log"), "key", **options)
        writer = out.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").foreachBatch(lambda b, e, i=i: told.extend((i, e, *r) for r in b.collect()))
        if not options:
            run_once(writer, spark)
            continue
        query, until = writer.trigger(processingTime="500 milliseconds").start(), time.time() + 60
        while not any(t[0] == i for t in told) and time.time() < until:
            time.sleep(0.3)
        time.sleep(4)
        query.stop()
    return {k: (v, t, s) for _, _, k, v, t, s, _ in sorted(told, key=lambda r: r[:2])}, told


def log(seed):
    rng, rows = random.Random(seed), []
    for key in range(6):
        for v in range(rng.choice([0, 1]), 12):
            if rng.random() < 0.93:
                rows.append((key, v, "full" if v == 0 or rng.random() < 0.15 else "edit", f"{v},"))
    return rows


def test_a_log_in_any_order_ends_like_its_twin(spark, tmp_path):
    rows = log(1)
    random.Random(1).shuffle(rows)
    got, told = replay(spark, str(tmp_path), [rows[:25], rows[25:45], rows[45:]])
    assert got == twin(rows)
    assert any(r[-1] > 0 for r in told)  # some changes waited


def test_waiting_changes_are_given_up_and_state_falls_after_its_time(spark, tmp_path):
    first = [(1, 0, "full", "a"), (1, 2, "edit", "c"), (2, 0, "full", "x")]
    later = [(2, 1, "edit", "y"), (3, 0, "full", "z")]
    last = [(1, 1, "edit", "b"), (2, 2, "edit", "w")]
    got, told = replay(spark, str(tmp_path / "wait"), [first, later, last], wait=1000)
    assert ("c" not in (got[1][1] or "")) and got[1] == (0, "a", False)  # the gap closed after the timer
    assert got[2] == (2, "xyw", True)
    got, _ = replay(spark, str(tmp_path / "keep"), [first, [(2, 1, "edit", "y")]], keep=1000)
    assert got[2] == (-1, None, False)  # its full text was forgotten
    waits, _ = replay(spark, str(tmp_path / "none"), [first, last])
    assert waits[1] == (2, "abc", True)


def rows_of(n, step, seed):
    return [(i, (i * step) % 97 + step, f"{i}:{step}") for i in random.Random(seed).sample(range(1000), n)]


def current(rows):
    out = {}
    for i, order, p in rows:
        if i not in out or order >= out[i][1]:
            out[i] = (i, order, p)
    return sorted(out.values())


def as_rows(df):
    return sorted(map(tuple, df.select("k", "at", "p").collect()))


@pytest.fixture
def few_buckets(monkeypatch):
    monkeypatch.setattr(store, "BUCKETS", 8)


def test_store(spark, tmp_path, few_buckets):
    path, everything = str(tmp_path / "rows"), []
    for epoch in range(6):
        rows = rows_of(300, epoch + 1, epoch)
        everything += rows
        store.put(spark.createDataFrame(rows, "k long, at long, p string"), epoch, path, ["k"], "at")
        assert as_rows(store.stored(spark, path, ["k"], "at")) == current(everything)
    assert [(a, b) for a, b, _ in store.complete_runs(spark, path)] == [(0, 3), (4, 4), (5, 5)]
    store.put(spark.createDataFrame(rows, "k long, at long, p string"), 5, path, ["k"], "at")  # a batch runs again
    store.put(spark.createDataFrame(rows_of(9, 5, 5), "k long, at long, p string"), 2, path, ["k"], "at")  # merged already
    assert as_rows(store.stored(spark, path, ["k"], "at")) == current(everything)
    wanted = spark.createDataFrame([(i * 37,) for i in range(20)] + [(5000,), (None,)], "k long")
    found = store.stored(spark, path, ["k"], "at", wanted)
    assert as_rows(found) == [r for r in current(everything) if r[0] in {i * 37 for i in range(20)}]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_look_up_reads_few_files(spark, tmp_path):
    path = str(tmp_path / "rows")
    store.put(spark.range(20_000).select(F.col("id").alias("k"), F.lit(1).alias("at"), F.col("id").cast("string").alias("p")), 0, path, ["k"], "at")
    files = {f for f in store.stored(spark, path, ["k"], "at").inputFiles()}
    wanted = spark.createDataFrame([(i,) for i in range(7, 27)], "k long")
    buckets = {r["b"] for r in wanted.select(store.bucket(["k"]).alias("b")).collect()}
    touched = [f for f in files if int(f.split("bucket=")[1].split("/")[0]) in buckets]
    assert len(touched) < 0.05 * len(files)
    assert store.stored(spark, path, ["k"], "at", wanted).count() == 20


def test_crashes_between_write_and_commit(spark, tmp_path, few_buckets):
    path, everything = str(tmp_path / "rows"), []
    for epoch in range(3):
        rows = rows_of(200, epoch + 1, epoch)
        everything += rows
        store.put(spark.createDataFrame(rows, "k long, at long, p string"), epoch, path, ["k"], "at")
    shutil.copytree(f"{path}/run=2-2", f"{path}/run=3-3")
    (tmp_path / "rows" / "run=3-3" / "_SUCCESS").unlink()  # a batch whose files are there, but not its end
    assert as_rows(store.stored(spark, path, ["k"], "at")) == current(everything)
    shutil.copytree(f"{path}/run=0-0", f"{path}/run=0-2")
    (tmp_path / "rows" / "run=0-2" / "_SUCCESS").unlink()  # a merge that did not end
    assert as_rows(store.stored(spark, path, ["k"], "at")) == current(everything)
    rows = rows_of(200, 4, 4)
    everything += rows
    store.put(spark.createDataFrame(rows, "k long, at long, p string"), 3, path, ["k"], "at")
    assert as_rows(store.stored(spark, path, ["k"], "at")) == current(everything)
    shutil.copytree(f"{path}/run=0-3", f"{path}/run=2-2")  # a replaced run that was not deleted yet
    assert as_rows(store.stored(spark, path, ["k"], "at")) == current(everything)


def test_change_logs_fold_batch_by_batch_without_python_for_a_key(spark, tmp_path, monkeypatch):
    """Random logs with gaps, early and late changes, null texts and repeats, cut into batches: as a loop over them gives."""
    from axisframe.plans import jobs
    from axisframe.streaming import streams as T

    rng, now = random.Random(4), {}
    path, log = str(tmp_path / "out"), str(tmp_path / "in")
    for epoch in range(7):
        batch = [(key, rng.randrange(1, 12) + 3 * epoch, rng.choice(["full", "edit", "edit", "edit"]), rng.choice(["a", "b", "c", None])) for key in range(40) for _ in range(rng.randrange(4))]
        spark.createDataFrame(batch, "key long, version long, kind string, payload string").coalesce(1).write.mode("append").parquet(log)
        for key, v, kind, payload in sorted(batch, key=lambda r: (r[0], r[1], r[2], r[3] is not None, r[3] or "")):
            at, text, in_sync = now.get(key, (-1, None, False))
            if v > at:
                if kind == "full":
                    at, text, in_sync = v, payload, True
                elif in_sync and v == at + 1:
                    at, text = v, (text or "") + (payload or "")
                else:
                    in_sync = False
            now[key] = at, text, in_sync
    read = T.read_events(spark, log, ts="version", files_per_trigger=1).withColumn("version", F.col("version").cast("long"))
    step = lambda batch, before: T.change_log_step(batch, before, "key")
    T.run_once(T.upserts(read, path, ["key"], "version", str(tmp_path / "check"), every=3, step=step, schema="key long, version long, text string, in_sync boolean"), spark)
    assert {r["key"]: tuple(r)[1:] for r in T.current(spark, path, ["key"], "version").select("key", "version", "text", "in_sync").collect()} == now
    assert len(now) == 40 and any(x[2] for x in now.values()) and not all(x[2] for x in now.values())
    monkeypatch.setattr(T, "apply_change_log", None)
    streamed, batched = ({tuple(r) for r in q(spark, "/root/testdata/sf0.001").collect()} for q in (jobs.t4_change_log_stream, jobs.t4_change_log_keys))
    assert streamed == batched and len(streamed) > 100
