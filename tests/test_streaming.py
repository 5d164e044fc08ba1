"""Streaming ingest (G3-G5, A3): at least once, replay-safe, counted."""

import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from alertflow.plans import fixtures as fx
from alertflow.sources.store import list_batches, read_counters, read_store, read_store_log
from alertflow.streaming import ingest
from alertflow.streaming.monitor import IngestProgress, milestone, stored_totals
from alertflow.streaming.ingest import read_dead_letters, read_event_stream, replay, run_ingest
from conftest import SF001


def _files(spark, work):
    fx.sec_payload(spark, SF001).select("value").repartition(3).write.text(f"{work}/in")


def _run(spark, work):
    stream = read_event_stream(spark, "text", f"{work}/in", maxFilesPerTrigger=1)
    q = run_ingest(spark, stream, f"{work}/store", f"{work}/ckpt",
                   trigger={"availableNow": True})
    q.awaitTermination()
    return q


def test_second_run_adds_nothing_and_counts(spark, tmpdir_work):
    _files(spark, tmpdir_work)
    q = _run(spark, tmpdir_work)
    progress = [p for p in q.recentProgress if p["numInputRows"] > 0]
    assert len(progress) == 3
    counted = [p["observedMetrics"]["ingest"] for p in progress]
    processed = sum(c["processed"] for c in counted)
    stored = read_store_log(spark, f"{tmpdir_work}/store").count()
    assert processed == stored
    assert sum(c["errors"] + c["malformed"] + c["processed"] for c in counted) == 1000
    batches = list_batches(spark, f"{tmpdir_work}/store")
    q2 = _run(spark, tmpdir_work)
    assert all(p["numInputRows"] == 0 for p in q2.recentProgress)
    assert list_batches(spark, f"{tmpdir_work}/store") == batches
    assert read_store_log(spark, f"{tmpdir_work}/store").count() == stored


def test_dead_letters_and_replay(spark, tmpdir_work):
    _files(spark, tmpdir_work)
    _run(spark, tmpdir_work)
    root = f"{tmpdir_work}/store"
    dl = read_dead_letters(spark, root)
    assert dl.where("disposition = 'malformed'").count() > 0
    assert dl.where(F.array_contains("error_codes", "criticality_out_of_range")).count() > 0
    assert dl.where("raw is null").count() == 0
    before = read_store(spark, root).count()
    b = replay(spark, root, order="sanitize_first")
    after = read_store(spark, root).count()
    assert after > before
    replay(spark, root, order="sanitize_first", batch_id=b)  # same replay batch again
    assert read_store(spark, root).count() == after
    assert read_store(spark, root).where("criticality < 1 or criticality > 10").count() == 0
    letters = dl.count()
    for _ in range(2):
        replay(spark, root)
        assert read_dead_letters(spark, root).count() == letters


def test_a_new_checkpoint_adds_to_the_store(spark, tmpdir_work):
    """Batch numbers start again at 0; the rows of the first ingest stay."""
    rows = fx.sec_payload(spark, SF001).select("value").collect()
    half = len(rows) // 2
    counts = []
    for part in (rows[:half], rows[half:]):
        work = f"{tmpdir_work}/{len(counts)}"
        spark.createDataFrame(part).write.text(f"{work}/in")
        stream = read_event_stream(spark, "text", f"{work}/in")
        run_ingest(spark, stream, f"{tmpdir_work}/store", f"{work}/ckpt",
                   trigger={"availableNow": True}).awaitTermination()
        counts.append(read_store_log(spark, f"{tmpdir_work}/store").count())
    batches = list_batches(spark, f"{tmpdir_work}/store")
    assert len(batches) == 2 and all(ids == [0] for ids in batches.values())
    _files(spark, tmpdir_work)
    whole = f"{tmpdir_work}/whole"
    spark.read.text(f"{tmpdir_work}/in").write.text(f"{whole}/in")
    _run(spark, whole)
    assert counts[1] > counts[0]
    assert counts[1] == read_store_log(spark, f"{whole}/store").count()


def test_replay_numbers_go_on(spark, tmpdir_work):
    _files(spark, tmpdir_work)
    _run(spark, tmpdir_work)
    root = f"{tmpdir_work}/store"
    assert [replay(spark, root), replay(spark, root)] == [0, 1]


def test_a_replay_takes_new_letters_only(spark, tmpdir_work):
    _files(spark, tmpdir_work)
    _run(spark, tmpdir_work)
    root = f"{tmpdir_work}/store"
    first, second = replay(spark, root), replay(spark, root)
    assert second == first + 1 and list_batches(spark, root)["replay"] == [first]
    # another rule takes the same letters; new letters are taken once
    third = replay(spark, root, order="validate_first")
    assert list_batches(spark, root)["replay"] == [first, third]
    spark.createDataFrame([('{"criticality":0,"timestamp":"2031-01-01T00:00:00Z","eventMessage":"late"}',)],
                          "value string").write.mode("append").text(f"{tmpdir_work}/in")
    _run(spark, tmpdir_work)
    fourth = replay(spark, root)
    log = read_store_log(spark, root).where(f"source = 'replay' and batch_id = {fourth}").collect()
    assert [r["event_message"] for r in log] == ["late"]


def test_a_batch_that_never_writes_goes_to_the_dead_letters(spark, tmpdir_work, monkeypatch):
    """Five failures, each stopping the query; the sixth start gives the batch up."""
    _files(spark, tmpdir_work)
    root = f"{tmpdir_work}/store"

    def broken(*args, **kwargs):
        raise OSError("the store is away")

    monkeypatch.setattr(ingest, "write_store", broken)

    def start():
        stream = read_event_stream(spark, "text", f"{tmpdir_work}/in")
        return run_ingest(spark, stream, root, f"{tmpdir_work}/ckpt", trigger={"availableNow": True})

    for _ in range(5):
        with pytest.raises(StreamingQueryException):
            start().awaitTermination()
    start().awaitTermination()
    letters = read_dead_letters(spark, root)
    assert letters.count() == 1000 and {r[0] for r in letters.select("attempts").distinct().collect()} == {5}
    lost = letters.where("disposition = 'undelivered'")
    assert lost.count() > 500 and lost.where("error_codes[0] <> 'max_deliver' or raw is null").count() == 0
    monkeypatch.undo()
    replay(spark, root, order="validate_first")  # the store is back
    assert read_store_log(spark, root).count() == lost.count()


def test_counters_survive_a_restart(spark, tmpdir_work):
    _files(spark, tmpdir_work)
    _run(spark, tmpdir_work)
    root = f"{tmpdir_work}/store"
    once = stored_totals(spark, root)
    assert sum(once.values()) == 1000
    spark.read.text(f"{tmpdir_work}/in").write.mode("append").text(f"{tmpdir_work}/in")
    progress = IngestProgress(start=stored_totals(spark, root))   # as after a restart
    spark.streams.addListener(progress)
    try:
        q = _run(spark, tmpdir_work)
        for _ in range(100):
            if progress.totals.get(str(q.id), {}).get("processed", 0) >= 2 * once["processed"]:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    twice = {k: 2 * v for k, v in once.items()}
    assert stored_totals(spark, root) == twice == progress.totals[str(q.id)]
    row = milestone(read_counters(spark, root), 100).first()
    assert row["milestone"] == twice["processed"] // 100 * 100 == progress.milestones[str(q.id)]


def test_masked_letters_are_not_replayed(spark, tmpdir_work):
    _files(spark, tmpdir_work)
    stream = read_event_stream(spark, "text", f"{tmpdir_work}/in")
    root = f"{tmpdir_work}/store"
    run_ingest(spark, stream, root, f"{tmpdir_work}/ckpt", trigger={"availableNow": True},
               redact_raw=True).awaitTermination()
    before = read_store_log(spark, root).count()
    assert read_dead_letters(spark, root).where("redacted").count() > 0
    replay(spark, root)
    assert read_store_log(spark, root).count() == before


def test_dedup_stream_keeps_first_copies_and_drops_late_rows(spark, tmpdir_work):
    import datetime as dt

    from alertflow.streaming.ingest import dedup_stream
    t = dt.datetime(2024, 3, 1, 12, 0)
    schema = "severity string, time timestamp, time_ns_rem smallint, n int"
    batches = [[("high", t, 0, 1), ("high", t, 0, 2), ("high", t, 1, 3)],
               [("high", t, 0, 4), ("low", t + dt.timedelta(hours=3), 0, 5)],
               [("low", t + dt.timedelta(hours=3), 0, 6)],
               # late rows are told by the watermark of the batch before the last one
               [("high", t - dt.timedelta(minutes=5), 0, 7)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmpdir_work}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmpdir_work}/in")
    q = (dedup_stream(stream, "1 hour").writeStream.format("parquet")
         .option("checkpointLocation", f"{tmpdir_work}/ckpt").trigger(availableNow=True)
         .start(f"{tmpdir_work}/out"))
    q.awaitTermination()
    got = sorted(r["n"] for r in spark.read.schema(schema).parquet(f"{tmpdir_work}/out").collect())
    # one of rows 1 and 2 (same file), rows 3 and 5; copies 4 and 6 dropped, row 7 came too late
    assert len(got) == 3 and got[0] in (1, 2) and got[1:] == [3, 5]


def test_registered_dedup_has_copies_to_drop(spark):
    import __spark_entry__ as entry
    copies = fx.store_rows(fx.sec_redelivered(spark, SF001)).count()
    assert entry.queries()["dedup_stream"](spark, SF001).count() < copies


def test_progress_milestones(spark, tmpdir_work):
    import time

    from alertflow.streaming.monitor import IngestProgress
    listener = IngestProgress(every=100)
    spark.streams.addListener(listener)
    try:
        _files(spark, tmpdir_work)
        q = _run(spark, tmpdir_work)
        stored = read_store_log(spark, f"{tmpdir_work}/store").count()
        deadline = time.time() + 30
        while time.time() < deadline and sum(
                t["processed"] for t in listener.totals.values()) < stored:
            time.sleep(0.5)  # listener events arrive asynchronously
    finally:
        spark.streams.removeListener(listener)
    tot = listener.totals[str(q.id)]
    assert tot["processed"] == stored
    assert listener.milestones == {str(q.id): stored // 100 * 100}


def test_write_event_stream_text_sink(spark, tmpdir_work):
    from alertflow.sources.codec import decode_events
    from alertflow.streaming.ingest import write_event_stream
    rows = fx.store_rows(fx.sec(spark, SF001))
    rows.write.parquet(f"{tmpdir_work}/rows")
    src = spark.readStream.schema(rows.schema).parquet(f"{tmpdir_work}/rows")
    w = write_event_stream(src, "text", f"{tmpdir_work}/out", f"{tmpdir_work}/ckpt")
    w.processAllAvailable()
    w.stop()
    back = decode_events(spark.read.text(f"{tmpdir_work}/out"))
    assert back.where("malformed").count() == 0
    assert back.count() == rows.count()


def test_crash_inside_a_batch_then_restart(spark, tmpdir_work, monkeypatch):
    """A batch that dies between its two writes is run again from the
    checkpoint: its store directory is overwritten, nothing is doubled or lost."""
    import pytest

    import alertflow.streaming.ingest as ingest

    _files(spark, tmpdir_work)
    real = ingest.write_dead_letters
    calls = {"n": 0}

    def flaky(rows, root, source, batch_id):
        calls["n"] += 1
        if batch_id == 1 and calls["n"] == 2:
            raise RuntimeError("simulated executor loss")
        return real(rows, root, source, batch_id)

    monkeypatch.setattr(ingest, "write_dead_letters", flaky)
    with pytest.raises(Exception):
        _run(spark, tmpdir_work)
    _run(spark, tmpdir_work)  # restart from the same checkpoint
    monkeypatch.setattr(ingest, "write_dead_letters", real)

    clean = f"{tmpdir_work}/clean"
    spark.read.text(f"{tmpdir_work}/in").write.text(f"{clean}/in")
    _run(spark, clean)
    cols = ["severity", "time", "time_ns_rem", "criticality", "event_message"]
    got = sorted(map(tuple, read_store(spark, f"{tmpdir_work}/store").select(*cols).collect()))
    want = sorted(map(tuple, read_store(spark, f"{clean}/store").select(*cols).collect()))
    assert got == want
    assert read_store_log(spark, f"{tmpdir_work}/store").count() == len(want)
    assert read_dead_letters(spark, f"{tmpdir_work}/store").count() == \
        read_dead_letters(spark, f"{clean}/store").count()


def test_dead_letters_can_mask_raw_text(spark):
    import datetime as dt

    from alertflow.operators.process import process, route
    from alertflow.sources.codec import decode_events
    from alertflow.streaming.ingest import dead_letter_rows
    df = spark.createDataFrame([('{"criticality":0,"eventMessage":"password=hunter2"}',)],
                               "value string")
    _, rejected = route(process(decode_events(df)))
    now = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
    plain = dead_letter_rows(rejected, "stream", 0, now).collect()[0]
    masked = dead_letter_rows(rejected, "stream", 0, now, redact_raw=True).collect()[0]
    assert "hunter2" in plain["raw"] and "hunter2" in plain["event_message"]
    assert not any("hunter2" in str(masked[c]) for c in masked.asDict())
    assert masked["redacted"] and not plain["redacted"]
    assert masked["error_codes"] == ["criticality_out_of_range", "invalid_timestamp"]


def test_no_dead_letters_yet_reads_empty(spark, tmpdir_work):
    assert read_dead_letters(spark, f"{tmpdir_work}/none").count() == 0
