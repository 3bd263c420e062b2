"""Sources, sinks and streams."""

import zipfile

import pytest
from pyspark.sql import functions as F

from leafgauge.sources import archive, documents, sse
from leafgauge.streaming import operations

PNG = b"\x89PNG\r\n\x1a\n"


def zipped(path, entries, **kw):
    with zipfile.ZipFile(path, "w", **kw) as z:
        for n, b in entries:
            z.writestr(n, b)
    return str(path)


def test_archive_round_trip(spark, tmp_path):
    spark.dataSource.register(archive.PageArchive)
    path = zipped(tmp_path / "a.zip", [("10.png", PNG + b"x"), ("2.png", PNG), ("note.txt", b"no")], compression=zipfile.ZIP_DEFLATED)
    df = spark.read.format("page_archive").load(path)
    assert [(r.name, r.position, r.size) for r in df.orderBy("position").collect()] == [("2.png", 0, 8), ("10.png", 1, 9)]
    assert df.where(F.crc32("content") != F.col("crc32")).count() == 0
    out = str(tmp_path / "out")
    df.select("name", "content").coalesce(1).write.format("page_archive").mode("append").save(out)
    again = spark.read.format("page_archive").load(out)
    assert sorted((r.name, bytes(r.content)) for r in again.collect()) == sorted((r.name, bytes(r.content)) for r in df.collect())


@pytest.mark.parametrize("name", ["../a.png", "/a.png", "a/../b.png", "c:x.png", "a./b.png", "a/ /b.png"])
def test_unsafe_paths(tmp_path, name):
    with pytest.raises(archive.ArchiveError):
        list(archive.read_archive(zipped(tmp_path / "a.zip", [(name, PNG)])))


def test_corruption(tmp_path):
    path = zipped(tmp_path / "a.zip", [("a.png", PNG + b"0123456789")])
    raw = bytearray(open(path, "rb").read())
    raw[raw.index(b"0123")] ^= 1
    (tmp_path / "b.zip").write_bytes(raw)
    with pytest.raises(archive.ArchiveError):
        list(archive.read_archive(str(tmp_path / "b.zip")))
    (tmp_path / "c.zip").write_bytes(b"nothing")
    with pytest.raises(archive.ArchiveError):
        list(archive.read_archive(str(tmp_path / "c.zip")))


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b10.png").write_bytes(PNG)
    (tmp_path / "in" / "b2.jpg").write_bytes(b"\xff\xd8\xff")
    (tmp_path / "in" / "c.txt").write_bytes(b"")
    df = documents.images(spark, str(tmp_path / "in"))
    assert [(r.name, r.media_type) for r in df.orderBy("sort_key").collect()] == [("b2.jpg", "image/jpeg"), ("b10.png", "image/png")]
    pins = documents.pins(df)
    assert documents.pin_mismatches(pins, pins).count() == 0
    assert documents.pin_mismatches(pins, pins.withColumn("byte_length", F.lit(0).cast("long"))).count() == 2
    out = str(tmp_path / "log")
    documents.write_once(spark.range(2), out)
    with pytest.raises(Exception, match="(?i)exist"):
        documents.write_once(spark.range(2), out)
    documents.append_log(spark.range(2, 3), out)
    assert spark.read.json(out).count() == 3
    html = spark.createDataFrame([('<title>T</title><script type="application/json" id="dataset">{"a":1}</script>',), ('<script id="dataset" type="application/json">{bad</script>',), (None,)], "h string")
    assert [tuple(r) for r in html.select(documents.embedded_dataset(F.col("h")), documents.title(F.col("h"))).collect()] == [('{"a":1}', "T"), (None, None), (None, None)]


TEXT = "id: 1\nevent: start\ndata: a\ndata: b\n\n: comment\ndata: {}\n\nevent: none\n\nid: 2\ndata: c"


def test_events(spark, tmp_path):
    assert list(sse.parse_events(TEXT)) == [("1", "start", "a\nb"), ("1", None, "{}"), ("2", "none", "c")]
    path = tmp_path / "e.txt"
    path.write_text(TEXT)
    assert sse.read_events(spark, str(path)).count() == 3
    spark.dataSource.register(sse.ServerSentEvents)
    query = spark.readStream.format("sse").load(str(path)).writeStream.format("memory").queryName("sse_out").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        query.processAllAvailable()
        assert spark.table("sse_out").count() == 2  # the last message has no end yet
        path.write_text(TEXT + "\n\ndata: d\n\n")
        query.processAllAvailable()
        assert [r.data for r in spark.table("sse_out").orderBy("position").collect()] == ["a\nb", "{}", "c", "d"]
    finally:
        query.stop()


class Handle:
    """Stands for the state of one key."""

    def __init__(self):
        self.value, self.timers = None, []

    def getValueState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_deadline():
    import pandas as pd

    h, p = Handle(), operations.FinalState(50)
    p.init(h)
    assert list(p.handleInputRows(("a",), iter([pd.DataFrame({"kind": ["warning"]})]), h)) == [] and h.timers == [1050]
    out = list(p.handleExpiredTimer(("a",), h, None))
    assert out[0].iloc[0].tolist() == ["a", "timed-out", 1]
    assert list(p.handleInputRows(("b",), iter([pd.DataFrame({"kind": ["failed", "finished"]})]), h))[0].iloc[0].tolist() == ["b", "failed", 0]
    assert list(p.handleInputRows(("b",), iter([pd.DataFrame({"kind": ["finished"]})]), h)) == []
    assert list(p.handleExpiredTimer(("b",), h, None)) == []


def test_streams(spark, data, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([("op1", "warning"), ("op1", "finished"), ("op2", "failed"), ("op2", "finished"), ("op3", "warning")], "operation string, kind string").coalesce(1).write.parquet(str(src))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("operation string, kind string").parquet(str(src))
    q = operations.final_states(stream).writeStream.format("memory").queryName("ends").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
        assert sorted(tuple(r) for r in spark.table("ends").collect()) == [("op1", "finished", 1), ("op2", "failed", 0)]
    finally:
        q.stop()
    (tmp_path / "ev").mkdir()
    spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "ev"))
    static = spark.read.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(static.schema).parquet(str(tmp_path / "ev"))
    q = operations.windowed_counts(stream, "ts", "event_type").writeStream.format("memory").queryName("win").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    try:
        q.processAllAvailable()
        got = {tuple(r) for r in spark.table("win").select("start", "event_type", "events").collect()}
        assert got == {tuple(r) for r in static.groupBy(F.date_trunc("hour", "ts").alias("start"), "event_type").count().collect()}
    finally:
        q.stop()
    assert operations.stage_totals(spark.createDataFrame([("a", "failed", 3), ("a", "ok", 4)], "stage string, status string, duration_ms long")).first().asDict() == {"stage": "a", "runs": 2, "failed": 1, "duration_ms": 7}
    assert operations.sessions(static, "ts", "user_id").agg(F.sum("events")).first()[0] == static.count()
