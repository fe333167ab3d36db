"""Track files: CSV with a commented header, any column order and unit, and an end line with a checksum. Rows are read by Spark.

A file is read as lines in their place (block and line); its first line that is no comment is its header, whose names are
bound to columns once, a row for each file; each other line is then split by that binding. Files of different layouts come
in one scan, and a large file is not read by one task's Python. The end line needs a whole file and is a query of its own,
and so does the repair of a clock that fell behind, for files that record their ticks.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as text_functions

#: Parts of header names that tell the time and the reading.
TIME_NAMES = ("time", "sec", "timestamp", "millis", "ms")
READING_NAMES = ("gsr", "eda", "conductance", "resistance", "res", "us", "raw", "micro", "ohms", "val")
#: Other columns by their whole name, with their kind.
EXACT = (("hdop", "double"), ("pdop", "double"), ("hacc_m", "double"), ("fix_type", "int"), ("speed_kts", "double"), ("course_deg", "double"), ("rssi_815", "double"), ("rssi_868", "double"), ("rssi_915", "double"), ("em_fog", "double"), ("is_gps_fix", "int"), ("tick_dt_ms", "double"))
#: Mean readings over which an unlabelled unit is ohm, or nanosiemens.
OHM_MEAN, NANO_MEAN = 50_000.0, 100.0
#: Fixed values of clock repair: the window either side and the least of it, the start, and the offset that counts (seconds).
SETTLE_S, SETTLE_LEAST_S, START_S, OFF_S = 30.0, 5.0, 10.0, 0.5
#: Up to so many files their headers are broadcast (a row each); more are joined by shuffle.
BROADCAST_FILES = 50_000
#: Columns of a device file, in its order.
DEVICE = ("timestamp", "lat", "lon", "hdop", "pdop", "sats", "fix_type", "speed_kts", "course_deg", "gsr_raw", "hacc_m")
MARK = "# Integrity: crc32 v1"


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, line): every line with its place in the file, without a byte order mark or carriage return."""
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.regexp_replace("value", "^﻿|\r$", "").alias("line"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): every line that is no comment and not empty."""
    return _placed(spark, path).where(~F.col("line").startswith("#") & (F.trim("line") != "")).select("file", "line")


def cells(line: Column) -> Column:
    """A line's cells: quoted ones may hold commas, and doubled quotes are one."""
    split = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(split, lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, r'^"|"\s*$', ""), F.lit('""'), F.lit('"'))).otherwise(c))


def number(cell: Column) -> Column:
    """The number that a cell begins with."""
    found = F.regexp_extract(cell, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return F.when(found != "", found.cast("double"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of the header's ``# key: value`` lines."""
    found = _placed(spark, path).where(F.col("line").rlike(r"^# *\w[\w ()]*:") & ~F.col("line").startswith("# End"))
    return found.select("file", F.regexp_extract("line", r"^# *(\w[\w ()]*?) *:", 1).alias("key"), F.trim(F.regexp_extract("line", r"^# *\w[\w ()]*? *:(.*)$", 1)).alias("value")).groupBy("file", "key").agg(F.min("value").alias("value"))


def with_defaults(params: Column, defaults: dict[str, str]) -> Column:
    """A JSON object as map<string,string> over the defaults, its nulls left out; null for anything else."""
    parsed = F.from_json(F.when(params.rlike(r"^\s*\{"), params), "map<string,string>")
    base = F.create_map(*(F.lit(x) for kv in defaults.items() for x in kv)) if defaults else F.expr("map()").cast("map<string,string>")
    given = F.map_filter(parsed, lambda k, v: v.isNotNull())
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(given, k))
    return F.when(parsed.isNotNull(), F.map_concat(kept, given))


def band_floors(value: Column) -> Column:
    """map<string,double> of ``name: dBm, name: dBm``."""
    pairs = F.transform(F.split(value, ","), lambda p: F.struct(F.trim(F.element_at(F.split(p, ":"), 1)).alias("k"), number(F.try_element_at(F.split(p, ":"), F.lit(2))).alias("v")))
    good = F.filter(pairs, lambda p: (p["k"] != "") & p["v"].isNotNull())
    return F.map_from_entries(F.transform(good, lambda p: F.struct(p["k"], p["v"])))


def parameters(spark: SparkSession, path: str, filter_defaults: dict[str, str], gps_defaults: dict[str, str]) -> DataFrame:
    """(file, start, filter_params, gps_params, band_floors, marked): a row for each file with comments."""
    m = metadata(spark, path)
    of = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    g = m.groupBy("file").agg(of("RecordingStartTime").alias("start"), of("FilterParams").alias("f"), of("GpsFilterParams").alias("g"), F.max(F.when(F.col("key").startswith("Band Floors"), F.col("value"))).alias("b"), of("Integrity").isNotNull().alias("marked"))
    return g.select("file", number(F.col("start")).alias("start"), with_defaults(F.col("f"), filter_defaults).alias("filter_params"), with_defaults(F.col("g"), gps_defaults).alias("gps_params"), F.when(F.col("b").isNotNull(), band_floors(F.col("b"))).alias("band_floors"), "marked")


def _bound(names: Column) -> dict[str, Column]:
    """Place (from 1, else 0) of each column in the header's names; the reading and the time have a default place."""
    has = lambda n, parts: F.exists(F.array(*map(F.lit, parts)), lambda p: n.contains(p))
    place = lambda rule: F.coalesce(F.array_min(F.filter(F.transform(names, lambda n, i: F.when(rule(n), i + 1)), lambda i: i.isNotNull())), F.lit(0))
    is_time = lambda n: has(n, TIME_NAMES)
    is_reading = lambda n: has(n, READING_NAMES) & ~is_time(n)
    rest = lambda n: ~is_time(n) & ~is_reading(n)
    exact = {c: F.coalesce(F.array_position(names, c), F.lit(0)).cast("int") for c, _ in EXACT}
    before = lambda c: place(lambda n: n.startswith("pre-kalman") & n.contains(c))
    both = (before("lat") > 0) & (before("lon") > 0)
    known = F.array(*(F.lit(c) for c, _ in EXACT), F.lit("alt"), F.lit("vdop"), F.lit("wdop"), F.lit("fix"))
    plain = lambda n: rest(n) & ~n.startswith("pre-kalman") & ~F.array_contains(known, n)
    lat = place(lambda n: plain(n) & n.contains("lat"))
    lon = place(lambda n: plain(n) & ~n.contains("lat") & (n.contains("lon") | n.contains("lng")))
    t, r = place(is_time), place(is_reading)
    return exact | {
        "timestamp": F.when(t > 0, t).otherwise(1), "gsr_raw": F.when(r > 0, r).otherwise(F.least(F.size(names), F.lit(2))),
        "lat": F.when(both, before("lat")).otherwise(lat), "lon": F.when(both, before("lon")).otherwise(lon), "sats": place(lambda n: plain(n) & n.contains("sat")),
        "peak_label": place(lambda n: n.contains("peaklabel") | n.contains("peak_label")), "is_peak": place(lambda n: n.contains("ispeak") | n.contains("is_peak")), "peak_excluded": place(lambda n: n.contains("peakexcluded") | n.contains("peak_excluded")),
    }


def unit_of(name: Column) -> Column:
    """ohm, us, ns or null, by a reading's header."""
    h = F.lower(F.trim(name))
    return F.when(h.contains("resistance") | h.contains("ohm"), "ohm").when(h.rlike(r"\((us|µs|μs)\)|microsiemens"), "us").when((h == "gsr_raw") | h.rlike(r"\(ns\)|nanosiemens"), "ns")


def microsiemens(reading: Column, unit: Column, mean: Column) -> Column:
    """By the unit, or by the mean of all readings where the header gives none."""
    ohm = F.when(reading > 0, F.try_divide(F.lit(1e6), reading)).otherwise(F.lit(0.0))
    nano = unit.isNull() & (mean > NANO_MEAN) & (mean <= OHM_MEAN)
    return F.when(unit == "us", reading).when(unit == "ns", reading / 1000).when((unit == "ohm") | (unit.isNull() & (mean > OHM_MEAN)), ohm).when(nano, reading / 1000).otherwise(reading)


def seconds(timestamp: Column) -> Column:
    """Epoch seconds of a date text, or the number itself."""
    dated = F.when(timestamp.rlike("[-:T]"), F.unix_micros(F.try_to_timestamp(timestamp)) / 1e6)
    return F.coalesce(dated, number(timestamp))


def spread_times(df: DataFrame, key: str = "file") -> DataFrame:
    """Rows that share a time ``t`` are spread evenly up to the next time, a smallest step at most; all the same: 10 Hz."""
    w, order, tie = Window.partitionBy(key), Window.partitionBy(key).orderBy("t", "at"), Window.partitionBy(key, "t")
    gap = F.col("t") - F.lag("t").over(order)
    d = df.withColumns({"_gap": F.when(gap > 0, gap), "_k": F.row_number().over(tie.orderBy("at")) - 1, "_n": F.count("*").over(tie), "_r": F.row_number().over(order) - 1})
    d = d.withColumns({"_step": F.min("_gap").over(w), "_after": F.lead("t").over(order)})
    d = d.withColumn("_after", F.max(F.when(F.col("_k") == F.col("_n") - 1, F.col("_after"))).over(tie))
    span = F.coalesce(F.least(F.col("_after") - F.col("t"), F.col("_step")), F.col("_step"))
    spread = F.when(F.col("_step").isNull(), F.col("_r") * 0.1).otherwise(F.col("t") + F.col("_k") * span / F.col("_n"))
    alone = F.count("*").over(w) == 1
    return d.withColumn("t", F.when(alone, F.col("t")).otherwise(spread)).drop("_gap", "_k", "_n", "_r", "_step", "_after")


def clock_shifts(t: np.ndarray, tick_ms: np.ndarray) -> np.ndarray:
    """Seconds to add to each time: where the real time of the ticks has settled at a later offset than at the start."""
    steps = np.sort(np.diff(t)[np.diff(t) > 0])
    if t.size < 2 or not steps.size:
        return np.zeros(t.size)
    tick, gap = steps[steps.size // 2], np.diff(t)
    real = np.maximum(0, np.floor(gap / tick + 0.5) - 1) * tick + np.where(np.isfinite(tick_ms[1:]), tick_ms[1:] / 1000, np.minimum(gap, tick))
    off = np.append(0, np.cumsum(real)) - (t - t[0])
    start = np.sort(off[: max(1, round(START_S / tick)) + 1])
    usual, limit = start[start.size // 2], OFF_S + 1e-6
    out = np.zeros(t.size)
    if not (np.abs(off - usual) > limit).any():
        return out
    most, least, before = max(1, round(SETTLE_S / tick)), round(SETTLE_LEAST_S / tick), 0.0
    for i in range(t.size):
        half = min(most, i, t.size - 1 - i)
        settled = np.partition(off[i - half : i + half + 1], half)[half] - usual
        shift = settled if settled > limit else 0.0
        if half < least:
            shift = 0.0 if i < t.size / 2 else before
        before = out[i] = max(shift, before - 0.99 * tick)
    return out


def _clocked(rows: DataFrame) -> DataFrame:
    """Times of files with ticks repaired, a file at a time: each correction rests on the one before."""

    def run(table: pa.Table) -> pa.Table:
        t, tick = (table.column(c).to_numpy().astype(float) for c in ("t", "tick_dt_ms"))
        place = list(zip(*(table.column("at").combine_chunks().field(k).to_numpy().tolist() for k in ("block", "line")), strict=True))
        by = np.array(sorted(range(t.size), key=place.__getitem__), np.int64)
        t[by] += clock_shifts(t[by], tick[by])
        return table.set_column(table.column_names.index("t"), "t", pa.array(t))

    return rows.groupBy("file").applyInArrow(run, rows.schema)


def raw_rows(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, t, gsr_raw, unit, missing, every known column): a row for each line that has a time and something to tell.

    A row without a reading but with a position or a radio level stays, with a reading of 1 and ``missing``.
    """
    body = _placed(spark, path).where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    heads = body.groupBy("file").agg(F.min(F.struct("at", "line")).alias("h"))
    names = F.transform(cells(F.lower("h.line")), lambda n: F.trim(n))
    heads = heads.select("file", F.col("h.at").alias("head_at"), names.alias("names"))
    places = _bound(F.col("names"))
    heads = heads.select("file", "head_at", "names", F.struct(*(v.cast("int").alias(k) for k, v in places.items())).alias("p"))
    heads = heads.withColumn("unit", unit_of(F.try_element_at("names", F.col("p.gsr_raw"))))
    few = heads.select("file").limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    rows = body.join(F.broadcast(heads) if few else heads, "file").where(F.col("at") > F.col("head_at")).withColumn("c", cells(F.col("line")))
    cell = lambda k: F.when(F.col(f"p.{k}") > 0, F.trim(F.try_element_at("c", F.col(f"p.{k}"))))
    kinds = {**dict(EXACT), "lat": "double", "lon": "double", "gsr_raw": "double", "sats": "int"}
    out = rows.select("file", "at", seconds(cell("timestamp")).alias("t"), "unit", *(number(cell(k)).cast(v).alias(k) for k, v in kinds.items()), cell("peak_label").alias("peak_label"), (number(cell("is_peak")) == 1).alias("is_peak"), (cell("peak_excluded") == "1").alias("peak_excluded"))
    told = F.coalesce("lat", "lon", "rssi_815", "rssi_868", "rssi_915", "em_fog").isNotNull()
    fix = F.when(F.col("is_gps_fix").isNotNull(), F.col("is_gps_fix") == 1).otherwise(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    return out.where(F.col("t").isNotNull() & (F.col("gsr_raw").isNotNull() | told)).withColumns({"missing": F.col("gsr_raw").isNull(), "gsr_raw": F.coalesce("gsr_raw", F.lit(1.0)), "is_fix": fix})


def interpolated(df: DataFrame, key: str = "file") -> DataFrame:
    """Positions of the rows between two fixes, on the line by time; satellites of the next fix, all else of the one before. None beyond the fixes."""
    held = ("hdop", "pdop", "fix_type", "speed_kts", "course_deg")
    real = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ((F.abs("lat") > 1e-4) | (F.abs("lon") > 1e-4))
    fix = F.when(real, F.struct("t", "lat", "lon", "sats", *held))
    ahead = Window.partitionBy(key).orderBy("t", "at").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(key).orderBy(F.desc("t"), F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_fix", fix).withColumns({"_a": F.last("_fix", True).over(ahead), "_b": F.last("_fix", True).over(back)})
    between = F.col("_fix").isNull() & F.col("_a").isNotNull() & F.col("_b").isNotNull()
    share = F.try_divide(F.col("t") - F.col("_a.t"), F.col("_b.t") - F.col("_a.t"))
    line = lambda c: F.when(F.col("_fix").isNotNull(), F.col(c)).when(between, F.col(f"_a.{c}") + share * (F.col(f"_b.{c}") - F.col(f"_a.{c}")))
    made = {"lat": line("lat"), "lon": line("lon"), "sats": F.when(between, F.col("_b.sats")).otherwise(F.col("sats"))} | {c: F.when(between, F.col(f"_a.{c}")).otherwise(F.col(c)) for c in held}
    return d.withColumns(made).withColumn("has_gps", F.col("lat").isNotNull()).drop("_fix", "_a", "_b")


def _in_order(rows: DataFrame) -> DataFrame:
    """Times repaired and spread; a file without ticks isn't gathered."""
    ticks = F.max(F.col("tick_dt_ms").isNotNull()).over(Window.partitionBy("file"))
    marked = rows.withColumn("_ticks", ticks)
    clocked = _clocked(marked.where("_ticks").drop("_ticks"))
    return spread_times(marked.where("not _ticks").drop("_ticks").unionByName(clocked))


def tracks(spark: SparkSession, path: str) -> DataFrame:
    """(file, t, gsr, lat, lon, ...): times in seconds from the file's first row, conductance in microsiemens, positions between fixes filled in."""
    rows = _in_order(raw_rows(spark, path))
    whole = Window.partitionBy("file")
    rows = rows.withColumns({"gsr": microsiemens(F.col("gsr_raw"), F.col("unit"), F.avg("gsr_raw").over(whole)), "t": F.round(F.col("t") - F.min("t").over(whole), 6)})
    rows = rows.withColumns({c: F.when(F.col("is_fix"), F.col(c)) for c in ("lat", "lon")})
    return interpolated(rows).drop("unit", "is_gps_fix")


def warnings(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, warnings array<string>): what is doubtful in each file; an empty array where nothing is."""
    rows = raw_rows(spark, path)
    order, whole = Window.partitionBy("file").orderBy("at"), Window.partitionBy("file")
    d = rows.withColumns({"gsr": microsiemens(F.col("gsr_raw"), F.col("unit"), F.avg("gsr_raw").over(whole)), "_back": F.coalesce(F.col("t") < F.lag("t").over(order), F.lit(False))})
    g = d.groupBy("file").agg(F.count("*").alias("rows"), F.count_if("_back").alias("back"), F.min("gsr").alias("low"), F.max("gsr").alias("high"), F.avg("gsr").alias("mean"), F.stddev_pop("gsr").alias("sigma"), F.approx_count_distinct("gsr").alias("about"), F.count_if((F.col("lat") == 0) & (F.col("lon") == 0)).alias("origin"), F.count_if("missing").alias("missing"))
    flat = (F.col("rows") >= 50) & ((F.col("about") <= 3) | ((F.col("mean") > 0) & (F.col("sigma") < 5e-4 * F.col("mean"))))
    found = F.array_compact(F.array(
        F.when(F.col("back") > 0, F.format_string("times go back %d times", "back")), F.when(F.col("low") < 1e-4, F.format_string("readings near zero (%.1f nS)", F.col("low") * 1000)),
        F.when(F.col("high") > 50, F.format_string("readings at the rail (%.0f nS)", F.col("high") * 1000)), F.when(flat, F.format_string("the signal is flat (deviation %.2g)", "sigma")),
        F.when(F.col("origin") > 0, F.format_string("%d positions at 0, 0", "origin")), F.when(F.col("missing") * 2 > F.col("rows"), F.format_string("%d of %d rows without a reading", "missing", "rows")),
    ))
    return g.select("file", "rows", found.alias("warnings"))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """(file, t, label, excluded): labels and exclusions stored in the file, at their row's time from the start."""
    rows = _in_order(raw_rows(spark, path)).withColumn("t", F.round(F.col("t") - F.min("t").over(Window.partitionBy("file")), 6))
    label, excluded = text_functions.clean_label(F.col("peak_label")), F.coalesce("peak_excluded", F.lit(False))
    return rows.where((label != "") | excluded).select("file", "t", label.alias("label"), excluded.alias("excluded"))


_TOKEN = re.compile(rb"(?:^|\s)(\w+):([0-9a-fA-F]+)")


@F.pandas_udf(T.StructType([T.StructField("status", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("overflows", T.LongType()), T.StructField("flush_fails", T.LongType()), T.StructField("end_time", T.LongType())]))
def _verified(content: pd.Series) -> pd.DataFrame:
    out = []
    for raw in content:
        raw = raw.removeprefix(b"\xef\xbb\xbf").replace(b"\r\n", b"\n")
        at = raw.rfind(b"\n# End ")
        if at < 0:
            out.append(("incomplete" if re.search(rb"^# Integrity:", raw, re.M) else "none", None, None, None, None))
            continue
        region, tokens = raw[: at + 1], dict(_TOKEN.findall(raw[at + 1 :].split(b"\n", 1)[0]))
        data = region.split(b"\n")[:-1]
        head = next((i for i, x in enumerate(data) if not x.startswith(b"#")), len(data))
        rows = len(data) - head - 1
        wrong = (b"crc32" in tokens and int(tokens[b"crc32"], 16) != zlib.crc32(region)) or (b"bytes" in tokens and int(tokens[b"bytes"]) != len(region)) or (b"rows" in tokens and int(tokens[b"rows"]) != rows)
        some = lambda k, none: int(tokens[k]) if k in tokens else none  # noqa: E731, B023
        out.append(("corrupt" if wrong else "verified", rows, some(b"overflows", 0), some(b"flush_fails", 0), some(b"end_time", None)))
    return pd.DataFrame(out, columns=["status", "rows", "overflows", "flush_fails", "end_time"]).astype({c: "Int64" for c in ("rows", "overflows", "flush_fails", "end_time")})


def integrity(spark: SparkSession, path: str) -> DataFrame:
    """(file, status, rows, overflows, flush_fails, end_time): verified, corrupt, incomplete (marked, no end line), or none. A file is one row: recordings are some MB."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("file"), _verified("content").alias("c")).select("file", "c.*")


def sample_rate(df: DataFrame) -> DataFrame:
    """(file, fs): one over the upper median of the positive gaps among the first 100 rows; 10 if there are none."""
    w = Window.partitionBy("file").orderBy("t")
    gaps = df.withColumns({"gap": F.col("t") - F.lag("t").over(w), "n": F.row_number().over(w)}).where("n <= 100")
    positive = F.array_sort(F.collect_list(F.when(F.col("gap") > 0, F.col("gap"))))
    return gaps.groupBy("file").agg(positive.alias("g")).select("file", F.when(F.size("g") > 0, 1 / F.element_at("g", F.floor(F.size("g") / 2).cast("int") + 1)).otherwise(10.0).alias("fs"))


def with_trailer(text: str, end_time: int | None = None) -> str:
    """A file's text with its end line."""
    body = text if text.endswith("\n") else text + "\n"
    data = body.split("\n")[:-1]
    head = next((i for i, x in enumerate(data) if not x.startswith("#")), len(data))
    raw = body.encode()
    ended = f"end_time:{end_time} " if end_time else ""
    return f"{body}# End rows:{len(data) - head - 1} bytes:{len(raw)} crc32:{zlib.crc32(raw):08x} {ended}overflows:0 flush_fails:0\n"


def device_row(p: dict[str, Column], bands: list[Column] | None = None) -> Column:
    """A device's line: positions with a fix, else the time and the reading alone; radio levels at the end."""
    some = lambda c, f: F.when(c.isNotNull() & ~F.isnan(c), F.format_string(f, c)).otherwise("")
    fixed = F.concat(F.format_string("%.2f,%.7f,%.7f,%.1f,%.1f,%d,%d,", p["timestamp"], p["lat"], p["lon"], p["hdop"], p["pdop"], p["sats"], p["fix_type"]), some(p["speed_kts"], "%.2f"), F.lit(","), some(p["course_deg"], "%.1f"), F.format_string(",%.1f,%.1f", p["gsr_raw"], p["hacc_m"]))
    line = F.when(p["valid"], fixed).otherwise(F.format_string("%.2f,,,,,,,,,%.1f,", p["timestamp"], p["gsr_raw"]))
    return F.concat(line, *(F.format_string(",%.1f", b) for b in bands)) if bands else line


def live_files(packets: DataFrame) -> DataFrame:
    """(device, text): the packets of a session as a device file with its end line; ``now`` is the time of writing in epoch seconds.

    One text a session, as the file is: some MB for hours of recording.
    """
    t = F.col("ms") / 1000.0
    row = device_row({"timestamp": t, "lat": F.col("lat"), "lon": F.col("lon"), "hdop": F.col("hdop"), "pdop": F.col("pdop"), "sats": F.col("sats"), "fix_type": F.col("fix"), "speed_kts": F.col("speed"), "course_deg": F.col("course"), "gsr_raw": F.col("gsr"), "hacc_m": F.col("hacc"), "valid": F.col("valid")})
    g = packets.select("device", "ms", "now", row.alias("row")).groupBy("device").agg(F.array_sort(F.collect_list(F.struct("ms", "row"))).alias("r"), F.max("now").alias("now"), F.max("ms").alias("last"), F.count("*").alias("n"))
    head = F.concat(F.lit(f"{MARK}\n# RecordingStartTime:"), (F.col("now") - F.floor(F.col("last") / 1000)).cast("long").cast("string"), F.lit(f"\n# DeviceName:LiveStream\n{','.join(DEVICE)}\n"))
    body = F.concat(head, F.array_join(F.transform("r", lambda x: x["row"]), "\n"), F.lit("\n"))
    end = F.concat(F.lit("# End rows:"), F.col("n").cast("string"), F.lit(" bytes:"), F.octet_length("body").cast("string"), F.lit(" crc32:"), F.lower(F.lpad(F.hex(F.crc32(F.col("body").cast("binary"))), 8, "0")), F.lit(" end_time:"), F.col("now").cast("long").cast("string"), F.lit(" overflows:0 flush_fails:0\n"))
    return g.withColumn("body", body).select("device", F.concat("body", end).alias("text"))


#: Columns of an analysed file: name, decimals (None: as it is), whether they are left out where no row has a value.
ANALYSED = (("time", 3, False), ("gsr", 4, False), ("tonic", 4, False), ("phasic", 4, False), ("lat", 7, True), ("lon", 7, True), ("hdop", 1, True), ("sats", 0, True), ("speed_kts", 2, True), ("rssi_815", 1, True), ("rssi_868", 1, True), ("rssi_915", 1, True), ("em_fog", 2, True), ("road_class", None, True), ("ndvi", 3, True), ("is_peak", None, False), ("peak_label", None, False), ("peak_excluded", None, False))


def analysed_lines(df: DataFrame, params: dict[str, str] | None = None) -> DataFrame:
    """(track, place, line) of a CSV file for each track: comments, header, rows in time order; columns without any value are left out.

    ``df`` has track, t (as ``time``), idx and any of the columns above.
    """
    have = [(n, d, o) for n, d, o in ANALYSED if n in df.columns or n == "time"]
    src = {n: F.col("t") if n == "time" else F.col(n) for n, _, _ in have}
    used = df.groupBy("track").agg(*(F.max(src[n].isNotNull()).alias(f"_has_{n}") for n, _, o in have if o))
    d = df.join(used, "track")
    show = lambda n, o: F.col(f"_has_{n}") if o else F.lit(True)
    cell = lambda n, k: F.coalesce(text_functions.csv_cell(src[n]) if k is None and df.schema[n].dataType == T.StringType() else src[n].cast("int").cast("string") if k is None else F.format_string(f"%.{k}f", src[n].cast("double")), F.lit(""))
    line = F.concat_ws(",", F.array_compact(F.array(*(F.when(show(n, o), F.when(src[n].isNotNull(), cell(n, k)).otherwise("")) for n, k, o in have))))
    body = d.select("track", F.struct(F.lit(2).alias("part"), F.col("t"), F.col("idx")).alias("place"), line.alias("line"))
    none = lambda part, i: F.struct(F.lit(part).alias("part"), F.lit(float(i)).alias("t"), F.lit(0).cast("long").alias("idx"))
    head = used.select("track", none(1, 0).alias("place"), F.concat_ws(",", F.array_compact(F.array(*(F.when(show(n, o), n) for n, _, o in have)))).alias("line"))
    out = body.unionByName(head)
    for i, (k, v) in enumerate(sorted((params or {}).items())):
        out = out.unionByName(used.select("track", none(0, i).alias("place"), F.lit(f"# {k}:{v}").alias("line")))
    return out


def write_tracks(df: DataFrame, path: str, params: dict[str, str] | None = None) -> None:
    """A folder of text for each track, its lines in order: one file a track, by one task."""
    analysed_lines(df, params).repartition("track").sortWithinPartitions("track", "place").select("track", F.col("line").alias("value")).write.partitionBy("track").text(path)
