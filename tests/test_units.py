"""Operators outside the queries: files, settings, client, services, projections, and grid joins against all pairs."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.client import NotSupportedError, ProgrammingError, UserError, connect
from tessella.client.errors import Delays, retry
from tessella.functions import crs, geometry, text
from tessella.functions import signals as sig
from tessella.operators import cluster, dataset, raster, service, spatial, windows
from tessella.sources import config, datasource, geotiff, shapefile


@pytest.mark.parametrize("cell", [3.0, 10.0, 200.0])
def test_grid_join_equals_theta_join(spark, cell, monkeypatch):
    monkeypatch.setattr(spatial, "MOST_CELLS", 30)
    rng = np.random.default_rng(1)

    def boxes(n, size):
        a = rng.uniform(-50, 50, (n, 2)).round(1)
        b = (a + rng.uniform(0, size, (n, 2))).round(1)
        return [(i, *map(float, a[i]), *map(float, b[i])) for i in range(n)]

    left, right = boxes(120, 12), boxes(90, 40)
    ldf = spark.createDataFrame(left, "l long, a double, b double, c double, d double")
    rdf = spark.createDataFrame(right, "r long, e double, f double, g double, h double")
    lb, rb = ["a", "b", "c", "d"], ["e", "f", "g", "h"]
    want = sorted((x[0], y[0]) for x in left for y in right if x[1] <= y[3] and x[3] >= y[1] and x[2] <= y[4] and x[4] >= y[2])
    got = sorted((r["l"], r["r"]) for r in spatial.join_overlapping(ldf, rdf, lb, rb, cell).select("l", "r").collect())
    assert got == want
    within = sorted({x[0] for x in left for y in right if x[1] >= y[1] and x[3] <= y[3] and x[2] >= y[2] and x[4] <= y[4]})
    assert sorted(r["l"] for r in spatial.within_any(ldf, rdf, lb, rb, cell, "l").collect()) == within


def test_windows_of_small_extents(spark):
    assert windows.sliding_windows(spark, (0, 0, 50, 50), (100, 100), (90, 90)).count() == 1  # moved back to the far edge, as the last one always is
    assert windows.sliding_windows(spark, (0, 0, 10, 10), (200, 200), (90, 90)).count() == 0
    with pytest.raises(ValueError):
        windows.turned(spark.range(1), "id", angle=100)


def test_numbers_follow_the_order(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("v"))
    rows = dataset.number_rows(df, ["v"], "n").collect()
    assert [r["v"] for r in sorted(rows, key=lambda r: r["n"])] == sorted(r["v"] for r in rows)
    assert sorted(r["n"] for r in rows) == list(range(1, 1001))


def test_run_lengths_by_hand(spark):
    df = spark.createDataFrame([([1, 1, 0, 0, 0, 1],), ([0, 0, 1],), ([1],), ([0],)], "m array<int>")
    assert [r[0] for r in df.select(raster.run_length_array(F.col("m"))).collect()] == [[0, 2, 3, 1], [2, 1], [0, 1], [1]]


@pytest.mark.parametrize("code", [3857, 32649, 4547])
def test_projections_come_back(spark, code):
    lon = 112.0
    df = spark.createDataFrame([(lon + dx, lat) for dx in (-1.0, 0.0, 1.3) for lat in (-40.0, 0.0, 23.08769, 60.0)], "x double, y double")
    x, y = crs.reproject(4326, code, F.col("x"), F.col("y"))
    mid = df.select("x", "y", x.alias("px"), y.alias("py"))
    bx, by = crs.reproject(code, 4326, F.col("px"), F.col("py"))
    for r in mid.select("x", "y", bx.alias("bx"), by.alias("by")).collect():
        assert math.isclose(r["x"], r["bx"], abs_tol=1e-8) and math.isclose(r["y"], r["by"], abs_tol=1e-8)


def test_projection_known_values(spark):
    df = spark.createDataFrame([(111.0, 0.0), (111.0, 45.0)], "x double, y double")
    x, y = crs.reproject(4326, 32649, F.col("x"), F.col("y"))
    rows = df.select(x.alias("x"), y.alias("y")).collect()
    assert math.isclose(rows[0]["x"], 500000, abs_tol=1e-6) and math.isclose(rows[0]["y"], 0, abs_tol=1e-6)
    assert math.isclose(rows[1]["y"], 4982950.4, abs_tol=0.5)  # meridian arc of 45 degrees times 0.9996
    with pytest.raises(ValueError):
        crs.reproject(4326, 9999, F.col("x"), F.col("y"))


def test_rings(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 2), (0, 2))])
    row = spark.range(1).select(
        geometry.ring_area(ring).alias("a"), geometry.ring_contains(ring, 1, 1).alias("i"), geometry.ring_contains(ring, 5, 1).alias("o"), geometry.ring_envelope(ring)[2].alias("x")
    ).first()
    assert (row["a"], row["i"], row["o"], row["x"]) == (8.0, True, False, 4.0)


def test_pairs(spark):
    df = spark.createDataFrame([("a=1, b=2",), ("k = v=w",), ("none",), ("a=10,b=0",), (None,)], "t string")
    assert [r[0] for r in df.select(text.parse_pairs(F.col("t"))).collect()] == [{"a": "1", "b": "2"}, {"k": "v=w"}, {}, {"a": "10", "b": "0"}, None]
    with pytest.raises(ValueError):
        text.database_uri("other")
    assert text.database_uri("sqlite", path="a.db") == "sqlite:///a.db"


@pytest.mark.parametrize("dtype", ["u1", "u2", "i2", "f4", "f8"])
@pytest.mark.parametrize("bands", [1, 3, 4])
def test_raster_file_round_trip(dtype, bands):
    data = np.random.default_rng(2).integers(0, 200, (bands, 7, 5)).astype(dtype)
    out = geotiff.decode(geotiff.encode(geotiff.Raster(data, (2.0, 0.5, 10.0, 0.25, -2.0, 20.0), "EPSG:4326")))
    assert (out.data == data).all() and out.data.dtype == data.dtype
    assert out.transform == (2.0, 0.5, 10.0, 0.25, -2.0, 20.0) and out.crs == "EPSG:4326"
    if bands == 4:
        with pytest.raises(ValueError):
            geotiff.encode(geotiff.Raster(data), georeferenced=False)


def test_raster_window():
    data = np.arange(100).reshape(1, 10, 10).astype("u1")
    out = geotiff.window(geotiff.Raster(data, (1.0, 0, 0.0, 0, -1.0, 10.0)), 2, 3, 6, 7)
    assert (out.data[0] == data[0, 3:7, 2:6]).all() and out.transform == (1.0, 0.0, 2, 0.0, -1.0, 7)
    assert geotiff.window(geotiff.Raster(data, (1.0, 0, 0.0, 0, -1.0, 10.0)), -2, 8, 2, 12, (2, 2)).data[0].tolist() == [[0, 0], [0, 11]]


def test_raster_sources(spark, tmp_path):
    data = np.arange(3 * 70 * 50).reshape(3, 70, 50) % 251
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "x.tif").write_bytes(geotiff.encode(geotiff.Raster(data.astype("u1"), (1.0, 0.0, 5.0, 0.0, -1.0, 9.0), "EPSG:3857")))
    (tmp_path / "a" / "x.TIF").write_bytes(b"other case")
    found = datasource.folders(spark, str(tmp_path)).collect()
    assert sorted(r["folder"].rsplit("/", 1)[1] for r in found) == ["a", "b"] and {r["n"] for r in found} == {1}
    datasource.register(spark)
    plain = datasource.read_rasters(spark, str(tmp_path), 32).drop("path")
    custom = spark.read.format("tessella_raster").option("path", str(tmp_path)).option("tile", "32").load()
    assert sorted(plain.collect(), key=repr) == sorted(custom.drop("path").collect(), key=repr)
    assert plain.count() == 2 * 3 * 2
    one = custom.where("row = 2 AND col = 1").first()
    assert one["transform"] == [1.0, 0.0, 37.0, 0.0, -1.0, -55.0]
    assert np.array_equal(np.array(one["px"]).reshape(3, 6, 18), data[:, 64:, 32:])
    custom.where(F.col("path").contains("/a/")).write.format("tessella_raster").option("path", str(tmp_path / "out")).mode("append").save()
    back = spark.read.format("tessella_raster").option("path", str(tmp_path / "out")).load()
    assert back.agg(F.sum(F.size("px"))).first()[0] == data.size


def test_shapes(spark, tmp_path):
    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0), (0.0, 0.0)]
    hole = [(0.5, 0.5), (1.0, 0.5), (1.0, 1.0), (0.5, 0.5)]
    other = [(x + 5, y) for x, y in square]
    shapes = [[square, hole, other], None, [square]]
    rows = [{"name": "größe", "n": 5, "v": 1.5, "ok": True}, {"name": None, "n": None, "v": None, "ok": None}, {"name": "b", "n": -12, "v": 0.25, "ok": False}]
    (tmp_path / "s.shp").write_bytes(shapefile.write_shp(shapes))
    (tmp_path / "s.dbf").write_bytes(shapefile.write_dbf(rows))
    assert shapefile.read_shp((tmp_path / "s.shp").read_bytes()) == shapes
    assert shapefile.read_dbf((tmp_path / "s.dbf").read_bytes()) == rows
    datasource.register(spark)
    a = datasource.read_shapes(spark, str(tmp_path)).drop("path")
    b = spark.read.format("tessella_shapes").option("path", str(tmp_path / "s.shp")).load().drop("path")
    assert sorted(a.collect(), key=repr) == sorted(b.collect(), key=repr)
    parts = datasource.explode_polygons(a)
    assert sorted(len(r["rings"]) for r in parts.collect()) == [1, 1, 2]
    datasource.write_geojson(a.where("rings IS NOT NULL"), str(tmp_path / "g"))
    again = datasource.read_geojson(spark, str(tmp_path / "g"))
    assert sorted(r["id"] for r in again.collect()) == ["0", "2"]
    assert json.loads(again.where("id = '2'").first()["coordinates"])[0][2] == [2.0, 2.0]


def test_tile_fetch(spark):
    urls = spark.createDataFrame([(f"u{i}", i, i) for i in range(20)], "url string, row long, col long")
    got = datasource.fetch_tiles(urls, lambda u: b"" if u.endswith("3") else u.encode(), 4)
    assert sorted(r["row"] for r in got.collect()) == [i for i in range(20) if i not in (3, 13)]


def test_settings(tmp_path):
    path = str(tmp_path / "c.ini")
    config.save_ini(path, {"A.b": "1", "c": "x%y"}, {"c": "remote", "d": "2"})
    assert config.load_ini(path) == {"A.b": "1", "c": "remote", "d": "2"}
    (tmp_path / "bad.ini").write_text("[other]\na=1\n")
    with pytest.raises(ValueError):
        config.load_ini(str(tmp_path / "bad.ini"))
    state, now, heard = {"up": True, "calls": 0}, [0.0], []

    def fetch(namespace):
        state["calls"] += 1
        if not state["up"]:
            raise OSError
        return {"k": "v"}

    remote = config.RemoteSettings(fetch, str(tmp_path / "cache"), 10, lambda: now[0])
    remote.listeners.append(lambda *a: heard.append(a))
    assert remote.get("k") == "v" and remote.get("k") == "v" and state["calls"] == 1
    assert remote.get("no", "default") == "default" and remote.get("no") is None and state["calls"] == 2
    now[0] = 11
    state["up"] = False
    fresh = config.RemoteSettings(fetch, str(tmp_path / "cache"))
    assert fresh.get("k") == "v" and fresh.get("zzz", "d") == "d"
    assert remote.update("application", {"k": "w", "n": "1"}) == [("update", "k", "w"), ("add", "n", "1")]
    assert remote.update("application", {"n": "1"}) == [("delete", "k", "w")]
    assert heard[0] == ("add", "application", "k", "v")
    assert config.sign("s", "t") == "h+fuJVa+VHmE6lslXZLKZw3qBHY="


def test_cursor(spark):
    with connect(spark, session_properties={"spark.sql.shuffle.partitions": "3"}) as c:
        cursor = c.cursor()
        with pytest.raises(ProgrammingError):
            cursor.fetchone()
        with pytest.raises(ProgrammingError, match="Cancel query failed; no running query"):
            cursor.cancel()
        cursor.execute("SELECT id, id * 2 AS d FROM range(25)")
        assert [d[0] for d in cursor.description] == ["id", "d"] and cursor.rowcount == -1
        assert cursor.fetchone() == [0, 0] and len(cursor.fetchmany(4)) == 4 and len(cursor.fetchmany()) == 1
        assert len(cursor.fetchall()) == 19 and cursor.fetchone() is None
        cursor.cancel()
        assert len(list(cursor.execute("SELECT 1 WHERE false"))) == 0
        assert len(cursor.execute("SELECT * FROM range(5000) LIMIT 1000").fetchall()) == len(list(cursor.execute("SELECT * FROM range(5000) LIMIT 1000").genall()))
        assert cursor.execute("SELECT :a + 1", {"a": 4}).fetchall() == [[5]]
        with pytest.raises(UserError) as e:
            cursor.execute("SELECT * FROM absent_table")
        assert e.value.error_type == "USER_ERROR" and "TABLE_OR_VIEW_NOT_FOUND" in e.value.error_name
        with pytest.raises(UserError):
            cursor.execute("SELEC 1")
        assert dict(cursor.execute("SET spark.sql.shuffle.partitions").fetchall()) == {"spark.sql.shuffle.partitions": "3"}
        c.set_property("spark.sql.shuffle.partitions", "5")
        assert c.session.conf.get("spark.sql.shuffle.partitions") == "5"
        for call in (lambda: cursor.executemany("x", []), lambda: cursor.setinputsizes([]), lambda: cursor.setoutputsize(1), c.commit, c.rollback, c.start_transaction):
            with pytest.raises(NotSupportedError):
                call()


def test_retry():
    assert [Delays(5, 1200, jitter=False)(i) for i in range(1, 11)] == [10, 20, 40, 80, 160, 320, 640, 1200, 1200, 1200]
    calls = []

    def flaky(n):
        calls.append(1)
        if len(calls) < n:
            raise OSError
        return "done"

    assert retry((OSError,), 3, sleep=lambda s: None)(flaky)(3) == "done"
    calls.clear()
    with pytest.raises(OSError):
        retry((OSError,), 3, sleep=lambda s: None)(flaky)(4)
    answers = iter([503, 503, 200])
    assert retry((), 3, sleep=lambda s: None, when=lambda c: c == 503)(lambda: next(answers))() == 200


def test_service():
    seen = []
    registry = service.Registry(notify=seen.append)

    def work(number, params, report):
        report(40)
        report(41)
        return params["score"] < 0.9, {"file": "x"}

    registry.register(
        service.Service("find", [service.Argument("score", "FLOAT", check=lambda s: 0 < s < 1), service.Argument("shape", "FILE", extensions=(".shp",)), service.Argument("n", "INT", required=False)], work)
    )
    assert registry.submit("other", {})["errno"] == 20000
    for bad in ({"score": 2, "shape": "a.shp"}, {"score": "x", "shape": "a.shp"}, {"score": 0.5, "shape": "a.tif"}, {"shape": "a.shp"}):
        assert registry.submit("find", bad)["errno"] == 10000
    ids = [registry.submit("find", {"score": s, "shape": "A.SHP"})["data"]["task_id"] for s in (0.5, 0.95, 0.1)]
    assert registry.run(ids[0])["status"] == 1 and registry.tasks[ids[0]]["progress"] == 100
    assert registry.run(ids[1])["status"] == 2
    assert registry.stop(ids[2])["errno"] == 0 and registry.tasks[ids[2]]["content"] == "Stopped Before Start"
    assert registry.run(ids[2])["status"] == 2 and registry.stop(ids[0])["errno"] == 40000
    assert [s["status"] for s in seen] == [1, 2] and registry.recover() == []
    sent = []
    service.notifier("http://x", 3, 0, lambda u, b: sent.append(b) or (_ for _ in ()).throw(OSError()))({"a": 1})
    assert len(sent) == 3
    assert service.stored_name("/tmp/a.tif").endswith("_a.tif")


def test_clusters(spark):
    rng = np.random.default_rng(4)
    points = np.concatenate([rng.normal(c, 0.05, (20, 3)) for c in ((0, 0, 0), (1, 1, 0), (3, 0, 2))])
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "id long, v array<double>")
    for model in (lambda d: cluster.kmeans_labels(d, 3), lambda d: d.join(cluster.agglomerative_labels(d, "id", 3), "id"), lambda d: d.join(cluster.dbscan_labels(d, "id", 0.4), "id")):
        labelled, s, ch = cluster.evaluate(df, "id", model, None)
        groups = {}
        for r in labelled.collect():
            groups.setdefault(r["cluster"], set()).add(r["id"] // 20)
        assert len(groups) == 3 and all(len(g) == 1 for g in groups.values())
        assert s > 0.8 and ch > 100
    noise = df.unionByName(spark.createDataFrame([(99, [50.0, 50.0, 50.0])], df.schema))
    assert cluster.dbscan_labels(noise, "id", 0.4).where("id = 99").first()["cluster"] == -1
    with pytest.raises(ValueError):
        cluster.agglomerative_labels(df, "id", 3, most=10)


def test_neighbours_in_parts(spark):
    x = np.random.default_rng(7).normal(size=(80, 4))
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(80)], "id long, v array<double>")
    want = sorted((i, j) for i in range(80) for j in range(80) if ((x[i] - x[j]) ** 2).sum() <= 1)
    for block in (2048, 7):
        assert sorted((r["a"], r["b"]) for r in cluster.neighbours(df, "id", 1.0, block=block).collect()) == want


def test_silhouette_in_blocks(spark):
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(50, 2)), rng.integers(0, 3, 50)
    label[0] = 7
    df = spark.createDataFrame([(i, x[i].tolist(), int(label[i])) for i in range(50)], "id long, v array<double>, cluster long")
    got = {r["id"]: r["s"] for r in cluster.silhouette(df, "id", block=8).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for i in range(50):
        own = label == label[i]
        if own.sum() == 1:
            assert got[i] == 0
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, label == c].mean() for c in set(label) - {label[i]})
        assert math.isclose(got[i], (b - a) / max(a, b), abs_tol=1e-6)


def test_network_shapes():
    w = sig.conv_weights(78)
    rng = np.random.default_rng(6)
    q, k = rng.normal(size=(4, 78)), rng.normal(size=(4, 78))
    out = sig.conv_forward(w, q, k)
    assert w["fc1.w"].shape == (100, 128 * 20) and out.shape == (4,) and ((out > 0) & (out < 100)).all()
    assert np.allclose(out[:1], sig.conv_forward(w, q[:1], k[:1]))


def test_learning_rate_without_warmup(spark):
    rows = spark.range(10).select(sig.learning_rate(F.col("id"), 10).alias("f")).collect()
    assert rows[0]["f"] == 1.0 and rows[9]["f"] < rows[5]["f"]
    with pytest.raises(ValueError):
        sig.learning_rate(F.col("id"), 0)
