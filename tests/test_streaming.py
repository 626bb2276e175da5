"""Streams give what batches give, on events that are on time."""

import json

from lakeloom.streaming import clickstream


def _lines(folder, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{len(list(folder.iterdir()))}.json").write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def _event(i, minute, customer=1, hour=10):
    return {"event_id": i, "event_time": f"2025-01-01T{hour:02d}:{minute:02d}:00Z", "customer_id": customer, "session_id": "s",
            "event_type": "view", "product_id": 1, "channel": "app"}


def test_parse_reads_bad_lines_as_nulls(spark):
    raw = spark.createDataFrame([(json.dumps(_event(1, 0)),), ("not json",), (None,)], "json string")
    assert [r.event_id for r in clickstream.parse(raw).collect()] == [1, None, None]


def test_duplicates_go_once_and_late_ones_are_dropped(spark, tmp_path):
    source = tmp_path / "in"
    run = lambda: clickstream.write(
        clickstream.deduplicated(clickstream.parse(spark.readStream.text(str(source)).withColumnRenamed("value", "json"))),
        str(tmp_path / "out"), str(tmp_path / "check"), once=True,
    ).awaitTermination()
    _lines(source, [_event(1, 0), _event(1, 0), _event(2, 1)])
    run()
    _lines(source, [_event(3, 50), _event(2, 1)])
    run()
    _lines(source, [_event(4, 5), _event(5, 51)])  # 4 is later than the watermark allows
    run()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 3, 5]


def test_sessions_in_a_stream_match_a_batch(spark, tmp_path):
    source = tmp_path / "in"
    rows = [_event(1, 0), _event(2, 20), _event(3, 55), _event(4, 10, customer=2), _event(5, 59, hour=23)]
    _lines(source, rows)
    events = clickstream.parse(spark.readStream.text(str(source)).withColumnRenamed("value", "json"))
    q = clickstream.sessions(events).writeStream.format("memory").queryName("sess").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = clickstream.sessions(clickstream.parse(spark.read.text(str(source)).withColumnRenamed("value", "json")))
    assert sorted(map(str, spark.table("sess").collect())) == sorted(map(str, batch.collect()))
    assert batch.count() == 4
