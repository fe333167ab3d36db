"""Streams that are started: they give what a batch gives, whatever the files they come in."""

import pytest

from dermotrace.streaming import live
from pyspark.sql import functions as F

CHUNKS = "device string, seq long, data binary"


def packet(ms, gsr=5.0):
    return live.pack(ms=ms, lat=51.5, lon=-0.1, gsr=gsr, hdop=1.0, pdop=1.0, speed=0.0, course=0.0, sats=9, fix=3, valid=1, hacc=2.0)


def run(spark, stream, tmp_path, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return spark.table(name)


@pytest.fixture
def chunks(spark, tmp_path):
    """Packets of two devices, split over chunks and files; each file is a batch of its own."""
    rows = []
    for device, step in (("a", 500), ("b", 700)):
        data = b"noise" + b"".join(packet(k * step, float(k)) for k in range(40)) + b"B"
        rows += [(device, i, data[at : at + 70]) for i, at in enumerate(range(0, len(data), 70))]
    rows.sort(key=lambda r: r[1])
    for i in range(0, len(rows), 9):
        spark.createDataFrame(rows[i : i + 9], CHUNKS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)


def test_packets_over_batches(spark, chunks, tmp_path):
    got = run(spark, live.decode(source(spark, chunks, CHUNKS)), tmp_path, "decoded")
    batch = live.decode(spark.read.schema(CHUNKS).parquet(chunks))
    want = sorted(map(str, batch.collect()))
    assert sorted(map(str, got.collect())) == want and len(want) == 80


@pytest.fixture
def readings(spark, tmp_path):
    rows = [("a", i, ms, float(i)) for i, ms in enumerate([0, 500, 1000, 2000, 2400, 2400, 3000, 9000, 9500, 60000])] + [("b", i, i * 100, 1.0) for i in range(6)]
    schema = "device string, seq long, ms long, gsr double"
    for i in range(0, len(rows), 4):
        spark.createDataFrame(rows[i : i + 4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    return str(tmp_path / "r"), schema


def test_gaps(spark, readings, tmp_path):
    path, schema = readings
    batch = live.gaps(spark.read.schema(schema).parquet(path)).select("device", "seq", "ms", "gap", "gaps").collect()
    assert [r.gap for r in sorted(batch, key=lambda r: (r.device, r.seq)) if r.device == "a"] == [False, False, False, True, False, True, False, True, False, True]
    got = run(spark, live.gaps(source(spark, path, schema)), tmp_path, "gaps")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch))


def test_windows_and_sessions(spark, readings, tmp_path):
    path, schema = readings
    timed = lambda df: df.withColumn("time", F.timestamp_millis("ms"))
    got = run(spark, live.windowed(timed(source(spark, path, schema)), "2 seconds", "5 seconds"), tmp_path, "windows")
    batch = {(r.device, r.start): (r.n, r.mean) for r in live.windowed(timed(spark.read.schema(schema).parquet(path)), "2 seconds", "5 seconds").collect()}
    told = {(r.device, r.start): (r.n, r.mean) for r in got.collect()}
    assert told and all(batch[k] == v for k, v in told.items()) and set(batch) - set(told) == {max(k for k in batch if k[0] == "a")}  # only what the watermark hasn't passed is left
    spans = live.sessions(timed(spark.read.schema(schema).parquet(path)), "1 second").collect()
    assert sorted(r.n for r in spans if r.device == "a") == [1, 2, 7]
    streamed = run(spark, live.sessions(timed(source(spark, path, schema)), "1 second", "5 seconds"), tmp_path, "spans").collect()
    assert {(r.device, r.start, r.n) for r in streamed} <= {(r.device, r.start, r.n) for r in spans} and len(streamed) == len(spans) - 1
    once = run(spark, live.settled(timed(source(spark, path, schema)).where("device = 'a'")), tmp_path, "settled").collect()
    assert sum(r.n for r in once) == 9 and len({r.start for r in once}) == len(once)


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, 10, -50.0), ("a", 1, 12, -60.0), ("a", 2, 11, -70.0)], "device string, band int, time long, level double")
    assert {(r.band, r.level) for r in live.latest_of_bands(df).collect()} == {(1, -60.0), (2, -70.0)}


def plain_trailing(batches, seconds, every_s, warmup):
    held, told, seen, out = {}, {}, {}, []
    for batch in batches:
        for device in sorted({r[0] for r in batch}):
            mine = held.setdefault(device, {})
            new = [(ms, v) for d, ms, v in batch if d == device]
            seen[device] = seen.get(device, 0) + len(new)
            mine.update(new)
            last = max(mine)
            for ms in [k for k in mine if k < last - seconds * 1000]:
                del mine[ms]
            if device not in told or seen[device] <= warmup or last - told[device] >= every_s * 1000:
                told[device] = last
                out.append((device, last, len(mine), min(mine), sum(mine.values())))
    return sorted(out)


def test_trailing(spark, tmp_path):
    """Late and repeated readings, a device that stops, batch by batch; the state stays within the window."""

    def shape(window):
        import pandas as pd

        return pd.DataFrame({"n": [len(window)], "first": [int(window["ms"].min())], "total": [float(window["gsr"].sum())]})

    schema, batches = "device string, ms long, gsr double", []
    for k in range(12):
        batch = [("a", 1000 * k + 100 * i, float(k)) for i in range(10)]
        if k == 5:
            batch += [("a", 3300, 50.0), ("a", 4100, 7.0)]  # late: values of these times are replaced
        if k < 2:
            batch += [("b", 1000 * k, 1.0)]
        batches.append(batch)
    batches.append([("a", 11900, 9.0)])  # comes again with another value, no time has gone by
    provider = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for part in (batches[:6], batches[6:]):  # the second run goes on from the state of the first
            for batch in part:
                spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = live.trailing(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), shape, "n long, first long, total double", 4.0, 1.5, 40, "3 seconds")
            query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
            query.awaitTermination(180)
            assert query.exception() is None
        states = [p["stateOperators"][0] for p in query.recentProgress if p["stateOperators"]]
    finally:
        spark.conf.set(provider, old)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == plain_trailing(batches, 4.0, 1.5, 40) and {r[0] for r in got} == {"a", "b"}
    # five seconds of one device, its counts, its timer in two places: the other device is gone
    assert states and states[-1]["numRowsTotal"] <= 9
