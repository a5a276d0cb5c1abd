"""Files in, files out."""

import json
import struct
import zlib

import numpy as np
import pytest

from rainloom.functions.columns import ContractError
from rainloom.sources import besttrack, frames, tables


def test_best_track(spark, tmp_path):
    (tmp_path / "CH2020BST.txt").write_text("66666 0000 3 0001 2001 0 6 Vongfong 20200101\n2020051006 1 083 1305 1004 13\n2020051012 1 084 1300 1003 15\nbroken\n2020051018 2 x 1295 1000 18\n66666 2002 1 0002 2002 0 6 Nuri 2020\n2020061200 1 150 1795 998 18\n2020061206 1 150 -1795 998 18\n")
    points, rejects = besttrack.scan(spark, str(tmp_path))
    rows = sorted((r.typhoon_name, str(r.time), r.lat, r.lon, r.wind, r.event_uid) for r in points.collect())
    assert rows[:2] == [("Nuri", "2020-06-12 00:00:00", 15.0, 179.5, 18.0, "CH2020BST_0002"), ("Nuri", "2020-06-12 06:00:00", 15.0, -179.5, 18.0, "CH2020BST_0002")]
    assert len(rows) == 4
    assert sorted(r.reason for r in rejects.collect()) == ["bad lat10", "short row"]
    m = {(r.typhoon_name, str(r.time)): r for r in besttrack.with_motion(points).collect()}
    last = m["Nuri", "2020-06-12 06:00:00"]
    assert last.dt_h == 6 and last.move_distance_km == pytest.approx(6371 * np.radians(1) * np.cos(np.radians(15)), rel=1e-3) and last.move_dir_deg == pytest.approx(90, abs=0.2)
    assert m["Nuri", "2020-06-12 00:00:00"].dt_h is None


def tiff(a, lon, lat, cell, nodata=None, deflate=False):
    data = a.astype("<f4").tobytes()
    data = zlib.compress(data) if deflate else data
    extra, entries = b"", []

    def entry(tag, kind, values, fmt):
        nonlocal extra
        raw = struct.pack(f"<{len(values)}{fmt}", *values) if kind != 2 else values
        entries.append((tag, kind, len(values), raw))

    entry(256, 3, [a.shape[1]], "H"), entry(257, 3, [a.shape[0]], "H"), entry(258, 3, [32], "H"), entry(259, 3, [8 if deflate else 1], "H")
    entry(273, 4, [8], "I"), entry(278, 3, [a.shape[0]], "H"), entry(279, 4, [len(data)], "I"), entry(339, 3, [3], "H")
    entry(33550, 12, [cell, cell, 0.0], "d"), entry(33922, 12, [0.0, 0, 0, lon, lat, 0], "d")
    if nodata is not None:
        entry(42113, 2, f"{nodata}\0".encode(), "s")
    at = 8 + len(data) + len(data) % 2
    head = b"II" + struct.pack("<HI", 42, at) + data + b"\0" * (len(data) % 2)
    pool = at + 2 + 12 * len(entries) + 4
    ifd = struct.pack("<H", len(entries))
    for tag, kind, n, raw in entries:
        if len(raw) <= 4:
            ifd += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
        else:
            ifd += struct.pack("<HHII", tag, kind, n, pool + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
    return head + ifd + b"\0" * 4 + extra


@pytest.mark.parametrize("deflate", [False, True])
def test_rasters(spark, tmp_path, deflate):
    a = np.arange(12.0).reshape(3, 4)
    a[0, 1], a[1, 1], a[2, 2] = -9999, -0.5, 1500
    name = "KONGREY_20240101003000_20240101010000_c+120.50_+15.25_b+110.50_+130.50_+5.25_+25.25.tif"
    (tmp_path / "E1").mkdir()
    (tmp_path / "E1" / name).write_bytes(tiff(a, 110.0, 25.0, 0.5, -9999, deflate))
    (tmp_path / "bad.tif").write_bytes(b"II*\0nothing")
    x = {r.path.rsplit("/")[-1]: r for r in frames.rasters(spark, str(tmp_path), most=1000.0).collect()}
    r = x[name]
    assert r.status == "ok" and (r.n_rows, r.n_cols, r.lon0, r.lat0, r.cell_deg) == (3, 4, 110.25, 24.75, 0.5)
    assert r["values"] == [0.0, None, 2.0, 3.0, 4.0, 0.0, 6.0, 7.0, 8.0, 9.0, None, 11.0]
    assert (r.gpm_event_uid, str(r.time), r.center_lon, r.bbox_lat_max) == ("KONGREY", "2024-01-01 00:30:00", 120.5, 25.25)
    assert x["bad.tif"].status.startswith("read_error") and x["bad.tif"].time is None
    df = frames.rasters(spark, str(tmp_path)).where("status = 'ok'")
    cell = [c for c in frames.cells(df, "gpm_event_uid").collect() if (c.irow, c.icol) == (2, 3)][0]
    assert (cell.lon, cell.lat, cell.rain) == (111.75, 23.75, 11.0)
    rows = spark.createDataFrame([("E1", name, None), ("E9", "none.tif", None), (None, name, None)], "event string, name string, given string")
    got = {(r.event, r.name): r.exists for r in frames.resolved(rows, df.select("path"), "event", "name", "given").collect()}
    assert got == {("E1", name): True, ("E9", "none.tif"): False, (None, name): True}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,x,when,t\n007,1.5,2024-01-01 00:00:00,a\n008,NaN,nope,b\n", encoding="utf-8")
    df = tables.read_csv(spark, str(tmp_path / "a.csv"), ids=["id"], times=["when"])
    assert df.dtypes == [("id", "string"), ("x", "double"), ("when", "timestamp"), ("t", "string")]
    rows = df.orderBy("id").collect()
    assert rows[0].id == "007" and rows[0].x == 1.5 and rows[1].x is None and rows[1].when is None
    assert tables.read_header(spark, str(tmp_path / "a.csv")) == ["id", "x", "when", "t"]
    tables.write_csv(df.drop("when"), str(tmp_path / "out"))
    back = tables.read_csv(spark, str(tmp_path / "out"), ids=["id"])
    assert back.columns == ["id", "x", "t"] and back.count() == 2
    with pytest.raises(ContractError):
        tables.read_csv(spark, str(tmp_path / "a.csv"), columns=["id", "gone"])
    assert tables.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "a.csv")]).endswith("a.csv")


def test_npz_and_reports(spark, tmp_path):
    np.savez(tmp_path / "f.npz", rain=np.array([[1.0, np.nan], [3, 4]]), ids=np.array(["a", "b"]))
    row = tables.read_npz(spark, str(tmp_path), ["rain"]).first()
    assert (row.name, row.shape, row["values"]) == ("rain", [2, 2], [1.0, None, 3.0, 4.0])
    with pytest.raises(Exception, match="lacks wind"):
        tables.read_npz(spark, str(tmp_path), ["wind"]).collect()
    df = spark.createDataFrame([("a", 1.23456789, None)], "k string, v double, z string")
    text, data = tables.report(df, "T")
    assert "| a | 1.23457 |  |" in text and json.loads(data)[0]["v"] == 1.23456789
    tables.write_packed(df, str(tmp_path / "p"), ["k"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    assert [r.status for r in tables.run_log(spark, [("a", ""), ("b", "broke")]).collect()] == ["SUCCESS", "FAIL"]
