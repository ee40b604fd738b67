"""Streams that keep state: changes of files, held scans, the queue, fulfilment on arrival; each with a restart."""

import datetime
import os
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerloom.operators import actions
from ledgerloom.streaming import jobs, watch
from ledgerloom.streaming.work_queue import WorkQueue

UTC = datetime.timezone.utc


def wait(condition, seconds=60):
    end = time.time() + seconds
    while not condition():
        assert time.time() < end, "nothing came in time"
        time.sleep(0.3)


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(name)


def test_changes_between_listings(spark):
    frame = lambda rows: spark.createDataFrame(rows, "root string, path string, mtime string, size long").withColumn("mtime", F.col("mtime").cast("timestamp"))
    t = "2024-01-01 00:00:0"
    before = frame([("r", "/same", t + "1", 1), ("r", "/touched", t + "1", 2), ("r", "/grown", t + "1", 3), ("r", "/old1", t + "2", 9), ("r", "/old2", t + "2", 9), ("r", "/gone", t + "3", 9), ("r", "/o", t + "4", 7)])
    now = frame([("r", "/same", t + "1", 1), ("r", "/touched", t + "9", 2), ("r", "/grown", t + "1", 4), ("r", "/new1", t + "2", 9), ("r", "/new2", t + "2", 9), ("r", "/fresh", t + "8", 1), ("q", "/o", t + "4", 7)])
    got = {(r["kind"], r["root"], r["path"], r["old_path"]) for r in watch.changes(before, now).collect()}
    assert got == {
        ("modified", "r", "/touched", None), ("modified", "r", "/grown", None), ("moved", "r", "/new1", "/old1"), ("moved", "r", "/new2", "/old2"),
        ("deleted", "r", "/gone", None), ("created", "r", "/fresh", None), ("deleted", "r", "/o", None), ("created", "q", "/o", None),
    }
    assert watch.changes(before, before).collect() == [] == watch.changes(before.limit(0), before.limit(0)).collect()


def test_watch_tells_four_kinds_and_survives_a_restart(spark, tmp_path):
    root, folder = tmp_path / "root", str(tmp_path / "state")
    root.mkdir()
    roots = {"main": str(root), "offline": str(tmp_path / "nowhere")}
    for name in ("a.txt", "b.txt", "c.md", "skip.tmp"):
        (root / name).write_text(name)
        os.utime(root / name, (1_700_000_000 + ord(name[0]), 1_700_000_000 + ord(name[0])))
    told = lambda: {(r["kind"], r["path"].rpartition("/")[2], r["old_path"] and r["old_path"].rpartition("/")[2]) for r in spark.read.schema(watch.CHANGES).parquet(f"{folder}/changes").collect()}
    first = {("created", n, None) for n in ("a.txt", "b.txt", "c.md")}
    query = watch.watch(spark, roots, folder, "1 second")
    wait(lambda: told() == first)
    query.stop()
    query.awaitTermination()
    (root / "a.txt").write_text("longer than before")
    (root / "b.txt").rename(root / "renamed.txt")
    (root / "c.md").unlink()
    (root / "d.txt").write_text("new")
    query = watch.watch(spark, roots, folder, "1 second")
    wait(lambda: told() == first | {("modified", "a.txt", None), ("moved", "renamed.txt", "b.txt"), ("deleted", "c.md", None), ("created", "d.txt", None)})
    time.sleep(3)
    query.stop()
    query.awaitTermination()
    assert spark.read.parquet(f"{folder}/changes").count() == 7 and len(os.listdir(f"{folder}/listing")) <= 3
    seen = watch.watched(spark, folder).writeStream.format("memory").queryName("watched").trigger(availableNow=True).start()
    seen.awaitTermination()
    assert spark.table("watched").count() == 7


def change(kind, path, old=None, mtime="2024-01-01 00:00:00", at="2024-01-01 00:00:00"):
    stamp = lambda s: datetime.datetime.fromisoformat(s).replace(tzinfo=UTC)
    return Row(kind=kind, root="r", path=path, old_path=old, mtime=stamp(mtime), size=1, at=stamp(at))


def test_held_scans_by_a_moved_clock(rocks, tmp_path):
    """The clock is the watermark of `at`: scans are let go 96 hours after their time, unless they are renamed or removed."""
    spark, source = rocks, tmp_path / "in"
    schema = watch.CHANGES + ", at timestamp"
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema(schema).parquet(str(source)).withWatermark("at", "0 seconds")
        out = watch.hold(stream, 96, event_time="at")
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
        return {(r["path"], r["late"]) for r in spark.read.schema(watch.RELEASED).parquet(str(tmp_path / "out")).collect()}

    put(change("created", "/letter.txt"), change("created", "/scan_0001.txt"), change("created", "/scan_0002.txt"), change("created", "/scan_0003.txt"), change("created", "/scan_0005.txt"))
    assert run() == {("/letter.txt", False)}
    put(change("moved", "/bill.txt", "/scan_0002.txt", at="2024-01-02 00:00:00"), change("deleted", "/scan_0003.txt", at="2024-01-02 00:00:00"))
    put(change("modified", "/scan_0005.txt", mtime="2024-01-03 00:00:00", at="2024-01-03 00:00:00"))
    assert run() == {("/letter.txt", False), ("/bill.txt", False)}  # a restart keeps what is held
    put(change("created", "/tick.txt", at="2024-01-05 01:00:00"))
    run()
    put(change("created", "/tock.txt", at="2024-01-05 02:00:00"))
    got = run()
    assert ("/scan_0001.txt", True) in got and not any("0002" in p or "0003" in p or "0005" in p for p, _ in got)
    put(change("created", "/end.txt", at="2024-01-09 00:00:00"))
    run()
    put(change("created", "/end2.txt", at="2024-01-09 01:00:00"), change("created", "/scan_0004.txt", at="2024-01-09 01:00:00"))
    got = run()
    assert ("/scan_0005.txt", True) in got and ("/scan_0004.txt", True) in got
    assert sum("scan" in p for p, _ in got) == 3


def test_held_scans_by_processing_time(rocks, tmp_path):
    spark = rocks
    now = time.time()
    at = lambda seconds: datetime.datetime.fromtimestamp(now + seconds, UTC)
    rows = [("created", "r", "/scan_0001.txt", None, at(-7200), 1), ("created", "r", "/scan_0002.txt", None, at(3600), 1), ("created", "r", "/scan_0003.txt", None, at(-3592), 1), ("created", "r", "/x.txt", None, at(0), 1)]
    spark.createDataFrame(rows, watch.CHANGES).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(watch.CHANGES).parquet(str(tmp_path / "in"))
    query = watch.hold(stream, 1).writeStream.format("memory").queryName("held").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    wait(lambda: {r["path"] for r in spark.table("held").collect()} == {"/scan_0001.txt", "/scan_0003.txt", "/x.txt"}, 90)  # the third one by its timer
    query.stop()
    assert spark.table("held").where("not late").count() == 1


class Clock:
    def __init__(self):
        self.at = datetime.datetime(2024, 1, 1, tzinfo=UTC)

    def __call__(self):
        return self.at

    def on(self, seconds):
        self.at += datetime.timedelta(seconds=seconds)


def test_queue_of_stages(spark, tmp_path):
    clock, bad, calls = Clock(), {3, 4}, []

    def chunk(rows):
        calls.append("chunk")
        return rows.withColumn("words", F.size(F.split("text", " "))).withColumn("error", F.when(F.col("doc_id").isin(*(bad or {-1})), F.lit("no chunk")))

    def embed(rows):
        return rows.withColumn("vector", F.col("words") * 2).withColumn("error", F.when(F.col("text") == "poison", F.lit("no vector")))

    payload = StructType.fromDDL("doc_id long, text string")
    queue = WorkQueue(spark, str(tmp_path / "q"), "doc_id", payload, [("chunk", chunk), ("embed", embed)], now=clock)
    rows = lambda *r: spark.createDataFrame(list(r), payload)
    state = lambda: {r["doc_id"]: (r["status"], r["stage"], r["failures"]) for r in queue.entries().collect()}
    assert queue.entries() is None and queue.results() is None
    first = rows((1, "a b"), (1, "a b"), (2, "poison"), (3, "c"))
    queue.step(first, 0)
    want = {1: ("done", None, 0), 2: ("failed", "embed", 1), 3: ("failed", "chunk", 1)}
    assert state() == want and {(r["doc_id"], r["vector"]) for r in queue.results().collect()} == {(1, 4)}
    queue.step(first, 0)  # the same batch again
    assert state() == want and queue.results().count() == 1
    clock.on(30)
    queue.step(rows(), 1)  # not due yet
    assert state() == want
    bad.clear()
    clock.on(31)
    queue.step(rows((5, "e")), 2)  # both letters are due
    want = {1: ("done", None, 0), 2: ("failed", "embed", 2), 3: ("done", None, 1), 5: ("done", None, 0)}
    assert state() == want
    queue.step(rows((5, "e")), 2)
    assert state() == want
    clock.on(121)
    queue.step(rows(), 3)
    assert state()[2] == ("failed", "embed", 3) and queue.entries().where("doc_id = 2").first()["due"] is None
    clock.on(10_000)
    queue.step(rows(), 4)
    assert state()[2] == ("failed", "embed", 3)  # spent
    assert {r["doc_id"] for r in queue.results().collect()} == {1, 3, 5}


def test_stranded_work_returns(spark, tmp_path):
    clock, broken = Clock(), [True]

    def stage(rows):
        if broken[0]:
            raise RuntimeError("the process died")
        return rows.withColumn("error", F.lit(None).cast("string"))

    payload = StructType.fromDDL("doc_id long, text string")
    queue = WorkQueue(spark, str(tmp_path / "q"), "doc_id", payload, [("only", stage)], now=clock)
    with pytest.raises(RuntimeError):
        queue.step(spark.createDataFrame([(1, "a"), (2, "b")], payload), 0, "dead")
    broken[0] = False
    clock.on(59)
    queue.step(spark.createDataFrame([(3, "c")], payload), 0, "other")
    assert {r["doc_id"] for r in queue.entries().collect()} == {3}
    clock.on(60)
    queue.step(spark.createDataFrame([], payload), 1, "other")
    assert {r["doc_id"]: r["status"] for r in queue.entries().collect()} == {1: "done", 2: "done", 3: "done"}


def test_queue_on_a_stream_restarts(spark, tmp_path):
    payload = StructType.fromDDL("doc_id long, text string")
    fail = [True]

    def stage(rows):
        if fail[0]:
            raise RuntimeError("down")
        return rows.withColumn("error", F.lit(None).cast("string"))

    queue = WorkQueue(spark, str(tmp_path / "q"), "doc_id", payload, [("only", stage)])
    put = lambda *r: spark.createDataFrame(list(r), payload).write.mode("append").parquet(str(tmp_path / "in"))
    start = lambda: queue.start(spark.readStream.schema(payload).parquet(str(tmp_path / "in")), str(tmp_path / "cp"))
    put((1, "a"))
    with pytest.raises(Exception, match="down"):
        start().awaitTermination()
    fail[0] = False
    start().awaitTermination()
    put((2, "b"))
    start().awaitTermination()
    start().awaitTermination()
    assert sorted(r["doc_id"] for r in queue.results().collect()) == [1, 2]
    assert spark.read.parquet(str(tmp_path / "q" / "results")).count() == 2


def test_an_action_is_fulfilled_once_over_all_batches(spark, tmp_path):
    asked = spark.createDataFrame([(1, 90, "payment", None, 250.0, None, None), (2, 91, "payment", None, 99.0, None, None)], "action_id long, source_doc long, action_type string, party string, amount double, source_key string, description string")
    schema, out = "doc_id long, text string", str(tmp_path / "out")
    put = lambda *r: spark.createDataFrame(list(r), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.match_on_arrival(stream, lambda: asked, actions.first_matches, out, str(tmp_path / "cp")).awaitTermination()
        return sorted((r["action_id"], r["doc_id"]) for r in spark.read.parquet(out).collect())

    put((10, "receipt 250.00"), (11, "paid 250.00"))
    assert run() == [(1, 10)]
    put((5, "receipt 250.00"), (12, "paid 99"))
    assert run() == [(1, 10), (2, 12)]
    put((1, "receipt 250.00"))
    assert run() == [(1, 10), (2, 12)] == run()
