"""Live input: binary packets to rows, with event time, watermark, windows and gaps."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A packet's layout (49 bytes, little-endian) and its mark.
MAGIC = b"BN"
PACKET = struct.Struct("<2sIdd5f3Bf")
FIELDS = ("ms", "lat", "lon", "gsr", "hdop", "pdop", "speed", "course", "sats", "fix", "valid", "hacc")
SCHEMA = "device string, ms long, lat double, lon double, gsr double, hdop double, pdop double, speed double, course double, sats int, fix int, valid boolean, hacc double"


def pack(**fields) -> bytes:
    return PACKET.pack(MAGIC, *(fields[f] for f in FIELDS))


def frames(buffer: bytes) -> tuple[list[tuple], bytes]:
    """(packets, what is left): noise before a mark is skipped, a packet that isn't whole yet stays."""
    out, at = [], 0
    while True:
        at = buffer.find(MAGIC, at)
        if at < 0:
            return out, buffer[-1:] if buffer.endswith(MAGIC[:1]) else b""
        if len(buffer) - at < PACKET.size:
            return out, buffer[at:]
        out.append(PACKET.unpack_from(buffer, at)[1:])
        at += PACKET.size


def decode(chunks: DataFrame) -> DataFrame:
    """Rows of (device, seq, data): packets may be split over chunks of a device, so its buffer is the state; batch or stream."""

    def rows(device: str, parts: list[bytes], rest: bytes) -> tuple[pd.DataFrame, bytes]:
        found, rest = frames(rest + b"".join(parts))
        df = pd.DataFrame(found, columns=list(FIELDS))
        df.insert(0, "device", device)
        df["valid"] = df["valid"].astype(bool)
        return df, rest

    if not chunks.isStreaming:
        batch = lambda key, df: rows(key[0], list(df.sort_values("seq")["data"]), b"")[0]
        return chunks.groupBy("device").applyInPandas(batch, SCHEMA)

    def update(key, frames_: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rest = state.get[0] if state.exists else b""
        parts = pd.concat(list(frames_)).sort_values("seq")
        df, rest = rows(key[0], list(parts["data"]), rest)
        state.update((rest,))
        yield df

    return chunks.groupBy("device").applyInPandasWithState(update, SCHEMA, "rest binary", "append", "NoTimeout")


def gaps(readings: DataFrame, most_s: float = 0.6) -> DataFrame:
    """``readings`` (device, ms) with ``gap``: more than ``most_s`` after the packet before, or not after it; and ``gaps``, how many so far. Batch or stream.

    On a stream a device's state is its last time and its count; packets count in the order in which they come.
    """
    if not readings.isStreaming:
        w = Window.partitionBy("device").orderBy("seq")
        dt = (F.col("ms") - F.lag("ms").over(w)) / 1000
        flag = F.coalesce((dt <= 0) | (dt > most_s), F.lit(False))
        return readings.withColumn("gap", flag).withColumn("gaps", F.sum(F.when(F.col("gap"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def update(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(parts)).sort_values("seq", kind="stable")
        flags, counts = [], []
        for ms in rows["ms"]:
            flag = last is not None and not 0 < (ms - last) / 1000 <= most_s
            last, n = int(ms), n + int(flag)
            flags.append(flag)
            counts.append(n)
        state.update((last, n))
        yield pd.DataFrame({"device": rows["device"], "seq": rows["seq"], "ms": rows["ms"], "gap": flags, "gaps": counts})

    return readings.select("device", "seq", "ms").groupBy("device").applyInPandasWithState(update, "device string, seq long, ms long, gap boolean, gaps long", "last long, n long", "append", "NoTimeout")


def latest_of_bands(samples: DataFrame) -> DataFrame:
    """(device, band, level): the last level of each band, by time. Batch or stream (complete mode)."""
    return samples.groupBy("device", "band").agg(F.max_by("level", "time").alias("level"))


def settled(readings: DataFrame, seconds: int = 8) -> DataFrame:
    """(device, start, n, mean) of one-second segments, each told once, when the stream has gone on by the settling time."""
    return windowed(readings, "1 second", f"{seconds} seconds").select("device", "start", "n", "mean")


#: A stream's first watermark is 1970: times since a device's start are set a day later, so that none counts as late.
ORIGIN_MS = 86_400_000


class Trailing(StatefulProcessor):
    """Holds a device's last readings by second and hands them to ``analyse`` as they grow; see ``trailing``."""

    def __init__(self, analyse: Callable[[pd.DataFrame], pd.DataFrame], seconds: float, every_s: float, warmup: int) -> None:
        self.analyse, self.window, self.every, self.warmup = analyse, int(seconds * 1000), int(every_s * 1000), warmup

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "second long", "ms array<long>, gsr array<double>")
        self.told = handle.getValueState("told", "last long, told long, seen long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows))
        new = new[new["ms"].notna()]
        last, told, seen = self.told.get() if self.told.exists() else (None, None, 0)
        if len(new):
            seen += len(new)
            before, last = last, max(int(new["ms"].max()), -(1 << 62) if last is None else last)
            # a second is one entry; a reading that comes again replaces the one of its time
            new = new[new["ms"] >= last - self.window]
            for second, part in new.groupby(new["ms"] // 1000):
                at = (int(second),)
                values = dict(zip(*self.held.getValue(at), strict=True)) if self.held.containsKey(at) else {}
                values |= zip(part["ms"].astype("int64").tolist(), part["gsr"].astype(float).tolist(), strict=True)
                self.held.updateValue(at, (list(values), list(values.values())))
            for (second,) in [k for k in self.held.keys() if k[0] < (last - self.window) // 1000]:
                self.held.removeKey((second,))
            if last != before:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(last + self.window + ORIGIN_MS)
            due = told is None or seen <= self.warmup or last - told >= self.every
            if due:
                told = last
            self.told.update((last, told, seen))
            if due:
                rows_ = sorted((ms, gsr) for ms_, gsr_ in self.held.values() for ms, gsr in zip(ms_, gsr_, strict=True) if ms >= last - self.window)
                out = self.analyse(pd.DataFrame(rows_, columns=["ms", "gsr"]))
                out.insert(0, "device", key[0])
                out.insert(1, "at", last)
                yield out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """The watermark is a whole window past the last reading: nothing that is held can count again."""
        self.held.clear()
        self.told.clear()
        yield from ()


def trailing(readings: DataFrame, analyse: Callable[[pd.DataFrame], pd.DataFrame], schema: str, seconds: float = 300.0, every_s: float = 1.5, warmup: int = 400, late: str = "60 seconds") -> DataFrame:
    """(device, at, *schema) of a stream (device, ms, gsr): ``analyse`` over each device's last ``seconds``, up to its reading ``at``.

    A batch's readings come first, then at most one analysis of a device: with every batch through its first ``warmup``
    readings, after that once its readings have gone on by ``every_s``. This is the readings' clock, so that a batch that
    is run again gives the same rows. Readings of one time replace each other, late ones included, up to the watermark
    ``late``; one without a time is left out, one without a value is NaN. The state is one window a device and goes once the
    watermark is a window past its last reading; nothing is read again. Needs the RocksDB state store.
    """
    timed = readings.select("device", "ms", "gsr", F.timestamp_millis(F.col("ms") + ORIGIN_MS).alias("time")).withWatermark("time", late)
    return timed.groupBy("device").transformWithStateInPandas(Trailing(analyse, seconds, every_s, warmup), f"device string, at long, {schema}", "append", "EventTime")


def windowed(readings: DataFrame, width: str = "10 seconds", late: str = "30 seconds") -> DataFrame:
    """(device, start, n, mean, low, high) of tumbling event-time windows; rows later than the watermark are dropped by it."""
    w = F.window("time", width)
    return readings.withWatermark("time", late).groupBy("device", w.alias("w")).agg(F.count("*").alias("n"), F.avg("gsr").alias("mean"), F.min("gsr").alias("low"), F.max("gsr").alias("high")).select("device", F.col("w.start").alias("start"), "n", "mean", "low", "high")


def sessions(readings: DataFrame, gap: str = "5 seconds", late: str = "30 seconds") -> DataFrame:
    """(device, start, end, n) of stretches without a longer gap."""
    w = F.session_window("time", gap)
    return readings.withWatermark("time", late).groupBy("device", w.alias("w")).agg(F.count("*").alias("n")).select("device", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
