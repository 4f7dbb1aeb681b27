"""A run keeps no plan whose diameters or score are wrong."""

from pyspark.sql import functions as F

from kelvingrid import engine as module
from test_geojson import scenario, write


def test_wrong_sizes_and_scores_are_refused(spark, tmp_path, monkeypatch):
    right = module.planner.optimise

    def wrong(starts, scenes):
        rows = right(starts, scenes)
        bad = F.col("start") == 1
        return rows.withColumn("cost", F.when(bad, F.col("cost") + 1000).otherwise(F.col("cost"))).withColumn("dn", F.when(bad & F.col("dn").isNotNull(), 1400).otherwise(F.col("dn")))

    monkeypatch.setattr(module.planner, "optimise", wrong)
    engine = module.Engine(spark, str(tmp_path / "store"), starts=2, steps=())
    run = engine.run(engine.ingest(write(tmp_path, scenario()), "first"))
    found = {(r.plan, r.rule) for r in spark.read.parquet(f"{engine.store}/runs/{run}/violations").collect()}
    assert found == {(p, rule) for p in (2, 3) for rule in ("diameter", "score")}
    assert {r.policy for r in engine.variants(run).collect()} == {"BALANCED"}
