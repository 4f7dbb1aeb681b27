import json

import pytest
from pyspark.sql import functions as F

from kelvingrid import engine as engines
from kelvingrid.engine import Engine, NotFound, NoValidPlan
from kelvingrid.operators import validation
from kelvingrid.sources import export
from kelvingrid.sources.geojson import InputError
from test_geojson import scenario, write


@pytest.mark.parametrize("mode", ["2d", "depth"])
def test_end_to_end(spark, tmp_path, mode):
    engine = Engine(spark, str(tmp_path / "store"), starts=2, steps=(12.0,) if mode == "2d" else ())
    sid = engine.ingest(write(tmp_path, scenario()), "first")
    assert engine.scenario(sid)["status"] == "READY" and engine.feature(sid, "c1")["object_type"] == "heat_chamber"
    run = engine.run(sid, mode)
    assert engine.status(run)["status"] == "DONE"
    variants = engine.variants(run).collect()
    assert variants and all(v.unconnected == 0 and v.missing == [] for v in variants) and variants[0].variant_id == ("3d_1" if mode == "depth" else "2d_1")
    assert engine.check(run).collect() == []
    out = str(tmp_path / "out.geojson")
    engine.export(run, out)
    got = json.load(open(out))["features"]
    lines = [f for f in got if f["properties"]["object_type"] == "heat_network"]
    assert lines and all(len(p) == (3 if mode == "depth" else 2) for f in lines for p in f["geometry"]["coordinates"])
    fields = {t: set(n) for t, n in validation.NEEDED.items()}
    assert all(fields[f["properties"]["object_type"]] <= set(f["properties"]) for f in got)
    first = [f for f in lines if not f["properties"]["start_node_id"].startswith("tech_")]
    if mode == "depth":
        assert all(-20 < p[2] <= -0.7 for f in lines for p in f["geometry"]["coordinates"])
        assert first and all(abs(f["geometry"]["coordinates"][0][2] + 3) < 1e-7 for f in first)
    else:
        assert all(f["properties"]["depth_start"] is None for f in lines)
    assert all(f["properties"]["tie_in_cost"] == (5e6 if f["properties"]["start_node_id"] == "c1" else 0) for f in lines)
    assert engine.violations(run, variants[0].variant_id).count() == 0
    lines_, chambers_ = engine.reconstruction(run)
    assert lines_.count() == 0  # DN 300 carries it all
    assert {r.id for r in chambers_.collect()} <= {"c1"}
    by_id = {f["properties"]["id"] for f in got} | {"c1", "t1", "t2"}
    assert all(f["properties"]["start_node_id"] in by_id and f["properties"]["end_node_id"] in by_id for f in lines)
    top = next(f for f in got if f["properties"]["object_type"] == "variant_summary" and f["properties"]["rank"] == 1)
    assert top["geometry"] is None and top["properties"]["score"] == pytest.approx(variants[0].score)
    one = export.variant(spark, out, variants[0].variant_id)
    assert one.count() == sum(f["properties"]["variant_id"] == variants[0].variant_id for f in got)
    with pytest.raises(NotFound):
        engine.variant(run, "9d_9")


def test_a_run_without_a_valid_plan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engines.validation, "geometry", lambda n, e: n.select("plan", F.lit("no").alias("rule"), F.lit("").alias("object"), F.lit("").alias("detail")))
    monkeypatch.setattr(engines.validation, "routes", lambda *a: engines.validation.geometry(a[0], a[1]))
    engine = Engine(spark, str(tmp_path / "store"), starts=1, steps=())
    sid = engine.ingest(write(tmp_path, scenario()), "first")
    with pytest.raises(NoValidPlan) as e:
        engine.run(sid)
    assert engine.status(e.value.run)["status"] == "ERROR" and engine.violations(e.value.run).count() > 0


def test_what_a_rejected_file_breaks_is_stored(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "store"))
    broken = scenario()
    broken[1]["properties"].pop("diameter")
    with pytest.raises(InputError) as e:
        engine.ingest(write(tmp_path, broken), "broken")
    assert [(r.rule, r.id) for r in engine.validation(e.value.check).collect()] == [("diameter", "p1")]
    with pytest.raises(NotFound):
        engine.validation("nothing")
