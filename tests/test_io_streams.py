"""Readers, writers and streams on temporary folders."""

from __future__ import annotations

import datetime as dt

import pytest

from parchemin.sources import io
from parchemin.streaming import logs as streams


def test_bad_lines_are_set_aside(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"question": "a", "n_cited": 1}\npas du json\n\n{"question": "b"}\n')
    rows, bad = io.read_jsonl(spark, str(tmp_path), "question string, n_cited int")
    assert sorted((r.question, r.n_cited) for r in rows.collect()) == [("a", 1), ("b", None)]
    assert [r.value for r in bad.collect()] == ["pas du json"]


def test_json_documents_and_texts(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"url": "u", "page_dates": ["2024-01-02"],\n "file_size_bytes": 5}')
    row = io.read_json(spark, str(tmp_path / "m.json"), io.METADATA).first()
    assert row.url == "u" and row.page_dates == [dt.date(2024, 1, 2)] and row.title if hasattr(row, "title") else True
    (tmp_path / "t.txt").write_text("a\nb")
    assert io.read_texts(spark, str(tmp_path / "t.txt")).first().text == "a\nb"
    files = io.list_files(spark, str(tmp_path), "*.txt", content=True).collect()
    assert [(f.extension, f.size, len(f.content_hash)) for f in files] == [("txt", 3, 64)]


def test_index_modes(spark, tmp_path):
    path = str(tmp_path / "index")
    df = lambda data: spark.createDataFrame(data, "k string, v int")
    held = lambda: sorted((r.k, r.v) for r in spark.read.parquet(path).collect())
    io.write_index(df([("a", 1), ("b", 2)]), path, "k", "reset")
    io.write_index(df([("c", 3)]), path, "k")
    io.write_index(df([("b", 9), ("d", 4)]), path, "k", "update")
    assert held() == [("a", 1), ("b", 9), ("c", 3), ("d", 4)]
    io.delete_rows(spark, path, "v > 3")
    assert held() == [("a", 1), ("c", 3)]
    io.write_index(df([("z", 0)]), path, "k", "reset")
    assert held() == [("z", 0)]
    with pytest.raises(ValueError):
        io.write_index(df([]), path, "k", "other")


def test_append_and_route(spark, tmp_path):
    df = spark.createDataFrame([("a", "keep"), ("b", "archive"), ("c", None)], "k string, disposition string")
    io.append_jsonl(df, str(tmp_path / "log"))
    io.append_jsonl(df, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 6
    io.route(df, str(tmp_path / "routed"))
    assert (tmp_path / "routed" / "disposition=keep").is_dir()


def test_stream_equals_batch(spark, tables, tmp_path):
    source = spark.read.parquet(f"{tables}/events.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = streams.read_stream(spark, str(tmp_path / "in"), source.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
    streams.run_available(streams.windowed(stream, "ts", "1 day", "1 hour", ["event_type"]), "windows", str(tmp_path / "cp"), "complete")
    batch = streams.windowed(source, "ts", "1 day", "1 hour", ["event_type"])
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch.withColumn("window_start", batch.window_start.cast("timestamp")).collect()))


def test_stream_deduplicates_and_appends(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", at), ("a", at), ("b", at)], "id string, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = streams.first_seen(streams.read_stream(spark, str(tmp_path / "in"), "id string, ts timestamp"), ["id"], "ts", "1 hour")
    streams.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    streams.append_to(streams.first_seen(streams.read_stream(spark, str(tmp_path / "in"), "id string, ts timestamp"), ["id"], "ts", "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]
