import json

from kelvingrid.engine import Engine
from kelvingrid.streaming.intake import intake
from test_geojson import scenario


def test_files_are_taken_in_once(spark, tmp_path):
    drop = tmp_path / "drop"
    drop.mkdir()
    (drop / "good.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": scenario()}))
    (drop / "bad.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": scenario()[1:]}))
    engine = Engine(spark, str(tmp_path / "store"))
    for _ in range(2):
        intake(engine, str(drop), str(tmp_path / "ck"), once=True).awaitTermination()
    rows = spark.read.parquet(f"{engine.store}/intake").collect()
    assert len(rows) == 2 and sum(r.error is None for r in rows) == 1
