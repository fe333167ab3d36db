"""Track files: layouts, units, clocks, positions, warnings, labels, end lines, and writing them again."""

import numpy as np
import pytest

from dermotrace.sources import track_csv
from pyspark.sql import functions as F


def write(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def by_file(df, *columns):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r.t):
        out.setdefault(r.file.rsplit("/", 1)[1][:-4], []).append(tuple(r[c] for c in columns))
    return out


HEAD = "timestamp,lat,lon,hdop,pdop,sats,fix_type,speed_kts,course_deg,gsr_raw,hacc_m\n"


def test_layouts_and_units(spark, tmp_path):
    path = write(
        tmp_path,
        a="# RecordingStartTime: 5\n" + HEAD + "10.0,51.5,-0.1,1.0,,7,3,,,5000,\n10.1,,,,,,,,,6000,\n10.2,51.6,-0.1,1.5,,9,3,1.5,90,7000,2.0\n",
        b=b"\xef\xbb\xbftime,EDA (uS),lng,lat\r\n2024-01-01T00:00:00Z,3.5,,\r\n2024-01-01T00:00:02Z,4.5,1,2\r\n",
        c='"Time (s)","Resistance, ohms"\n0,"200000"\n1,0\n2,x\n',
        d="sec,val\n0,400\n1,600\n",
        e="t,x\n0,60000\n1,100000\n",
        f="sec,val\n1,2\n2,3\n3,not a number\n",
        g="ms,pre-kalman-lat,pre-kalman-lon,lat,lon,gsr_raw\n1,3,4,5,6,1000\n",
    )
    rows = by_file(track_csv.tracks(spark, path), "t", "gsr", "lat", "lon", "sats", "hdop", "has_gps")
    assert [r[:2] for r in rows["a"]] == [(0.0, 5.0), (0.1, 6.0), (0.2, 7.0)]
    assert rows["a"][1][2:6] == (pytest.approx(51.55), -0.1, 9, 1.0)
    assert [r[:2] for r in rows["b"]] == [(0.0, 3.5), (2.0, 4.5)] and rows["b"][1][2:4] == (2.0, 1.0) and rows["b"][0][6] is False
    assert [r[:2] for r in rows["c"]] == [(0.0, 5.0), (1.0, 0.0)]
    assert [r[1] for r in rows["d"]] == [0.4, 0.6]
    assert [r[1] for r in rows["e"]] == [pytest.approx(1e6 / 60000), 10.0]
    assert [r[1] for r in rows["f"]] == [2.0, 3.0]
    assert rows["g"] == [(0.0, 1.0, 3.0, 4.0, None, None, True)]


def test_rows_without_a_reading(spark, tmp_path):
    path = write(tmp_path, a="timestamp,gsr_raw,lat,lon,rssi_815\n0,5000,,,\n1,,1,2,\n2,,,,-70\n3,,,,\n,100,,,\n")
    rows = by_file(track_csv.tracks(spark, path), "t", "gsr_raw", "missing")
    assert rows["a"] == [(0.0, 5000.0, False), (1.0, 1.0, True), (2.0, 1.0, True)]


def test_quoted_cells(spark):
    r = spark.createDataFrame([(1, 'a,"b, ""c""",,"d"'), (2, ""), (3, 'x,y"z"')], "i int, l string").orderBy("i").select(track_csv.cells(F.col("l")).alias("c")).collect()
    assert [x.c for x in r] == [["a", 'b, "c"', "", "d"], [""], ["x", 'y"z"']]
    n = spark.createDataFrame([("1.5abc",), (" -2e3 ",), ("",), ("x1",), (None,), (".5",)], "s string").select(track_csv.number(F.col("s")).alias("n")).collect()
    assert [x.n for x in n] == [1.5, -2000.0, None, None, None, 0.5]


def test_shared_times(spark, tmp_path):
    path = write(tmp_path, a="sec,val\n" + "".join(f"{t},1\n" for t in (0, 0, 0, 2, 2, 3, 9, 9)), b="sec,val\n5,1\n5,2\n5,3\n", c="sec,val\n7,1\n")
    rows = by_file(track_csv.tracks(spark, path), "t")
    # steps of 2, 1 and 6: the smallest is 1
    assert [r[0] for r in rows["a"]] == pytest.approx([0, 1 / 3, 2 / 3, 2, 2.5, 3, 9, 9.5])
    assert [r[0] for r in rows["b"]] == [0.0, 0.1, 0.2] and rows["c"] == [(0.0,)]


def test_clock_that_fell_behind(spark, tmp_path):
    t = np.arange(2000) / 10
    tick = np.full(2000, 100.0)
    tick[0] = 900
    tick[1000] = 2600
    shift = track_csv.clock_shifts(t, tick)
    assert shift[:960].max() == 0 and np.allclose(shift[1040:], 2.5, atol=1e-6)
    assert (np.diff(t + shift) > 0).all()
    assert track_csv.clock_shifts(t, np.full(2000, 100.0)).max() == 0 and track_csv.clock_shifts(t[:1], tick[:1]).tolist() == [0]
    text = "timestamp,gsr_raw,tick_dt_ms\n" + "".join(f"{a:.1f},5000,{b:.0f}\n" for a, b in zip(t, tick))
    rows = by_file(track_csv.tracks(spark, write(tmp_path, a=text)), "t")["a"]
    assert rows[-1][0] == pytest.approx(199.9 + 2.5) and len(rows) == 2000


def test_warnings(spark, tmp_path):
    path = write(tmp_path, good="sec,val\n" + "".join(f"{i},{3 + i % 7}\n" for i in range(60)), back="sec,val\n0,1\n2,2\n1,3\n", rail="sec,gsr (us)\n0,0\n1,80\n", flat="sec,val\n" + "".join(f"{i},5\n" for i in range(60)), zero="sec,gsr_raw,lat,lon\n0,,0,0\n1,,0,0\n2,5,1,1\n")
    got = {r.file.rsplit("/", 1)[1][:-4]: r.warnings for r in track_csv.warnings(spark, path).collect()}
    assert got["good"] == [] and got["back"] == ["times go back 1 times"]
    assert [w.split(" (")[0] for w in got["rail"]] == ["readings near zero", "readings at the rail"]
    assert [w.split(" (")[0] for w in got["flat"]] == ["the signal is flat"]
    assert "2 positions at 0, 0" in got["zero"] and "2 of 3 rows without a reading" in got["zero"]


def test_labels(spark, tmp_path):
    path = write(tmp_path, a='time,gsr (us),IsPeak,PeakLabel,PeakExcluded\n0,1,0,,\n1,2,1,"dog, barking",\n2,3,1,,1\n3,4,1,,0\n')
    assert by_file(track_csv.labels(spark, path), "t", "label", "excluded")["a"] == [(1.0, "dog, barking", False), (2.0, "", True)]


def test_parameters(spark, tmp_path):
    path = write(tmp_path, a='# Integrity: crc32 v1\n# RecordingStartTime:17.5\n# FilterParams: {"a":2,"b":null,"c":"x"}\n# GpsFilterParams: [1]\n# Band Floors (dBm): 815: -99.5, 868:-101, x, :3\ntime,val\n0,1\n')
    r = track_csv.parameters(spark, path, {"a": "1", "b": "7"}, {"g": "0"}).first()
    assert (r.start, r.filter_params, r.gps_params, r.marked) == (17.5, {"a": "2", "b": "7", "c": "x"}, None, True)
    assert r.band_floors == {"815": -99.5, "868": -101.0}


def test_integrity(spark, tmp_path):
    body = "# Integrity: crc32 v1\n# Note: é\ntimestamp,gsr_raw\n1,5\n2,6\n3,7\n"
    good = track_csv.with_trailer(body, 1700000000)
    path = write(tmp_path, good=good, crlf=good.replace("\n", "\r\n"), bom=b"\xef\xbb\xbf" + good.encode(), flipped=good.replace("2,6", "2,8"), inserted=good.replace("2,6\n", "2,6\n2,6\n"), cut=body, none="time,val\n1,2\n", old=good.replace("# Integrity: crc32 v1\n", ""))
    got = {r.file.rsplit("/", 1)[1][:-4]: r for r in track_csv.integrity(spark, path).collect()}
    assert {k: r.status for k, r in got.items()} == {"good": "verified", "crlf": "verified", "bom": "verified", "flipped": "corrupt", "inserted": "corrupt", "cut": "incomplete", "none": "none", "old": "corrupt"}
    assert (got["good"].rows, got["good"].overflows, got["good"].end_time) == (3, 0, 1700000000)


def test_live_file_verifies(spark, tmp_path):
    rows = [("d", 100 * i, 51.5 + i * 1e-4, -0.1, 5000.0 + i, 1.0, 1.5, None if i % 2 else 2.5, None, 9, 3, i != 2, 2.0, 1700000000) for i in range(5)]
    df = spark.createDataFrame(rows, "device string, ms long, lat double, lon double, gsr double, hdop double, pdop double, speed double, course double, sats int, fix int, valid boolean, hacc double, now long")
    text = track_csv.live_files(df).first().text
    path = write(tmp_path, live=text)
    r = track_csv.integrity(spark, path).first()
    assert (r.status, r.rows, r.end_time) == ("verified", 5, 1700000000)
    assert text.split("\n")[6] == "0.20,,,,,,,,,5002.0," and text.split("\n")[5] == "0.10,51.5001000,-0.1000000,1.0,1.5,9,3,,,5001.0,2.0"
    got = by_file(track_csv.tracks(spark, path), "t", "gsr", "lat")["live"]
    assert [g[:2] for g in got] == [(0.0, 5.0), (0.1, 5.001), (0.2, 5.002), (0.3, 5.003), (0.4, 5.004)] and got[2][2] == pytest.approx(51.5002)


def test_written_and_read_again(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.0, 0, 5.0, 4.5, 0.5, 51.5, None, True, 'a "b"'), (1, 0.1, 1, 5.1, 4.5, 0.6, None, None, False, None), (2, 0.0, 0, 3.0, 2.5, 0.5, None, -70.0, False, None)], "track long, t double, idx long, gsr double, tonic double, phasic double, lat double, rssi_815 double, is_peak boolean, peak_label string")
    df = df.withColumn("lon", F.col("lat") * 2)
    track_csv.write_tracks(df, str(tmp_path / "out"), {"RecordingStartTime": "7"})
    one, two = ("".join(p.read_text() for p in (tmp_path / "out" / f"track={k}").glob("*.txt")).split("\n") for k in (1, 2))
    assert one[:3] == ["# RecordingStartTime:7", "time,gsr,tonic,phasic,lat,lon,is_peak,peak_label", '0.000,5.0000,4.5000,0.5000,51.5000000,103.0000000,1,"a ""b"""']
    assert one[3] == "0.100,5.1000,4.5000,0.6000,,,0," and two[1] == "time,gsr,tonic,phasic,rssi_815,is_peak,peak_label"
    for p in (tmp_path / "out" / "track=1").glob("*.txt"):
        rows = sorted((r.t, r.lat, r.peak_label) for r in track_csv.raw_rows(spark, str(p)).collect())
        assert rows == [(0.0, 51.5, 'a "b"'), (0.1, None, "")]


def test_sample_rate(spark):
    df = spark.createDataFrame([("a", i * 0.25) for i in range(5)] + [("b", 1.0)], "file string, t double")
    assert {r.file: r.fs for r in track_csv.sample_rate(df).collect()} == {"a": 4.0, "b": 10.0}
