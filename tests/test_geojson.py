import json

import pytest
from pyspark.sql import functions as F

from kelvingrid.functions import projection
from kelvingrid.sources import geojson


def feature(id_, kind, coordinates, object_type, **more):
    return {"type": "Feature", "properties": {"id": id_, "object_type": object_type, **more}, "geometry": {"type": kind, "coordinates": coordinates}}


def scenario():
    x, y = 37.60, 55.75
    box = lambda a, b, s=0.0003: [[[a, b], [a + s, b], [a + s, b + s], [a, b + s]]]
    return [
        feature(1, "Point", [x, y], "source"),
        feature("p1", "LineString", [[x, y], [x + 0.005, y]], "heat_network", diameter=300, flow_tph=10, upstream_object_id=1),
        feature("c1", "Point", [x + 0.005, y], "heat_chamber", upstream_object_id="p1"),
        feature("b1", "Polygon", box(x + 0.003, y + 0.001), "oks_future", flow_tph=12.5),
        feature("t1", "Point", [x + 0.0031, y + 0.0011], "oks_connection_point", oks_id="b1"),
        feature("t2", "Point", [x + 0.001, y + 0.001], "oks_connection_point", flow_tph=3),
        feature("r1", "MultiPolygon", [box(x + 0.002, y - 0.002)], "restriction", restriction_type="park"),
        feature("r2", "LineString", [[x, y + 0.0005], [x + 0.006, y + 0.0005, 7.0]], "restriction", restriction_type="power_cable"),
    ]


def write(tmp_path, features, **root):
    p = tmp_path / "scenario.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "name": "x", "features": features, **root}))
    return str(p)


def test_ingest_and_snapshot(spark, tmp_path):
    store = str(tmp_path / "store")
    sid = geojson.ingest(spark, write(tmp_path, scenario()), store, "first")
    assert geojson.features(spark, store, sid).count() == 8
    s = geojson.snapshot(spark, store, sid)
    assert {(r.oks_id, r.flow) for r in s["terminals"].collect()} == {("b1", 12.5), ("t2", 3.0)}
    assert s["chambers"].first().diameter == 300 and s["pipes"].first().upstream == "1"  # the largest pipe at it
    assert geojson.find(spark, store, sid, "t2").first().flow_tph == 3
    assert {r.type for r in s["restrictions"].collect()} == {"park", "power_cable", "oks_existing"}
    ring = geojson.features(spark, store, sid, "oks_future").first().rings[0]
    assert len(ring) == 5 and ring[0] == ring[-1]


@pytest.mark.parametrize("change, rule", [
    (lambda f: f.pop(0), "one-source"),
    (lambda f: f.append(dict(f[0])), "unique-id"),
    (lambda f: f[1]["properties"].pop("diameter"), "diameter"),
    (lambda f: f[3]["properties"].pop("flow_tph"), "flow"),
    (lambda f: f[4]["properties"].update(oks_id="nobody"), "oks-reference"),
    (lambda f: f[2]["properties"].update(upstream_object_id="zz"), "unreachable"),
    (lambda f: f[6]["properties"].update(restriction_type="lava"), "restriction-type"),
    (lambda f: f[3].update(geometry={"type": "Polygon", "coordinates": [[[37.6, 55.75], [37.601, 55.751], [37.601, 55.75], [37.6, 55.7512]]]}), "geometry"),
    (lambda f: f[1].update(geometry={"type": "Point", "coordinates": [1, 2]}), "geometry-type"),
    (lambda f: f[1].update(geometry={"type": "MultiPoint", "coordinates": [[1, 2]]}), "geometry"),
])
def test_constraints(spark, tmp_path, change, rule):
    f = scenario()
    change(f)
    with pytest.raises(geojson.InputError) as e:
        geojson.ingest(spark, write(tmp_path, f), str(tmp_path / "store"), "broken")
    assert rule in {v[0] for v in e.value.violations}
    assert not (tmp_path / "store").exists()


def test_root_is_checked(spark, tmp_path):
    with pytest.raises(geojson.InputError):
        geojson.scan(spark, write(tmp_path, [], type="Nothing"))


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(37.6173, 55.7558), (36.1, 50.0), (41.9, 60.2)], "lon double, lat double")
    x, y = projection.to_utm(F.col("lon"), F.col("lat"))
    lon, lat = projection.to_wgs(F.col("x"), F.col("y"))
    rows = df.withColumns({"x": x, "y": y}).withColumns({"a": lon, "b": lat}).collect()
    assert abs(rows[0].x - 413224.138) < 0.01 and abs(rows[0].y - 6179766.954) < 0.01
    assert all(abs(r.a - r.lon) < 1e-6 and abs(r.b - r.lat) < 1e-6 for r in rows)
