"""The engine's surface: ingest scenarios, run plans, read variants back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelvingrid.functions import geometry as g
from kelvingrid.operators import candidates, depth, diversity, joint, planner, reconstruction, spatial, validation
from kelvingrid.plans import rules
from kelvingrid.plans.shared import materialise
from kelvingrid.sources import export, geojson


class NotFound(KeyError):
    """No scenario, run or variant has this id."""


class NoValidPlan(RuntimeError):
    """No plan of a run passed its validators; ``run`` is listed with the status ERROR, and its violations can be read."""

    def __init__(self, run: str):
        super().__init__(f"run {run} has no valid plan")
        self.run = run


class Engine:
    """Scenarios and runs in one store folder that driver and executors share."""

    def __init__(self, spark: SparkSession, store: str, starts: int = 3, steps: tuple[float, ...] = joint.STEPS):
        """``starts`` of the planner in a run; ``steps`` of the rounds that refine its plans together, none for no refinement."""
        self.spark, self.store, self.starts, self.steps = spark, store.rstrip("/"), min(8, max(1, starts)), steps

    def ingest(self, path: str, name: str = "scenario", lines: bool = False) -> str:
        """A scenario's id. A file that breaks the contract raises ``InputError``; what it breaks is stored under the error's ``check``."""
        try:
            return geojson.ingest(self.spark, path, self.store, name, lines)
        except geojson.InputError as e:
            e.check = uuid.uuid4().hex
            rows = self.spark.createDataFrame(e.violations, "rule string, id string, detail string")
            rows.select(F.lit(e.check).alias("check"), "*").write.mode("append").parquet(f"{self.store}/rejected")
            raise

    def validation(self, scenario: str) -> DataFrame:
        """(rule, id, detail) of a file that was rejected, by the error's ``check``; no rows for a scenario that is ready."""
        schema = "check string, rule string, id string, detail string"
        found = self.spark.createDataFrame([], schema)
        if self.has("rejected"):
            found = self.spark.read.schema(schema).parquet(f"{self.store}/rejected").where(F.col("check") == scenario)
        if found.isEmpty():
            self.scenario(scenario)
        return found.drop("check")

    def check_file(self, path: str, lines: bool = False) -> DataFrame:
        """(rule, id, detail) of everything that a scenario file breaks; nothing is stored."""
        return geojson.check(self.spark, path, lines)

    def feature(self, scenario: str, feature: str) -> dict:
        rows = geojson.find(self.spark, self.store, scenario, feature).collect()
        if not rows:
            raise NotFound(feature)
        return rows[0].asDict()

    def has(self, name: str) -> bool:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.store}/{name}")
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root)

    def one(self, name: str, id_: str) -> dict:
        """The row of a list of the store; a store without it knows none."""
        rows = self.spark.read.parquet(f"{self.store}/{name}").where(F.col("id") == id_).collect() if self.has(name) else []
        if not rows:
            raise NotFound(id_)
        return rows[0].asDict()

    def scenario(self, scenario: str) -> dict:
        return self.one("scenarios", scenario)

    def scenes(self, scenario: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
        """A scenario's working window as one row of arrays, for the planner; its tables; the legs of its pipes."""
        s = geojson.snapshot(self.spark, self.store, scenario)
        lines = s["pipes"].select("id", "path")
        legs = s["pipes"].select("id", F.col("diameter").alias("dn"), F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("p"), F.slice("path", F.lit(2), F.size("path") - 1).alias("q"))).alias("k", "s"))
        legs = materialise(legs.select(F.struct("id", "k").alias("id"), "dn", F.col("s.p.x").alias("ax"), F.col("s.p.y").alias("ay"), F.col("s.q.x").alias("bx"), F.col("s.q.y").alias("by")))
        degree = candidates.sections(s["chambers"].select("id", "x", "y"), lines)
        free = materialise(s["chambers"].join(degree, "id").where("degree <= 3").select("id", "x", "y", (4 - F.col("degree")).cast("int").alias("free")))
        # a place on a pipe, but for those near a chamber that could take the tie
        points = candidates.samples(legs).withColumn("id", F.struct("id.id", "id.k", "chainage"))
        points = points.join(spatial.within(points.select("id", "x", "y"), free.select("id", "x", "y"), 10.0, 50.0).select("id"), "id", "left_anti")
        points = points.join(candidates.sections(points.select("id", "x", "y"), lines), "id").where("degree <= 3")
        ties = free.select("id", F.lit("heat_chamber").alias("type"), "x", "y", "free").unionByName(points.select(F.to_json("id").alias("id"), F.lit("heat_network").alias("type"), "x", "y", (4 - F.col("degree")).cast("int").alias("free")))
        key = F.lit(scenario).alias("scenario")
        t = s["terminals"].agg(F.sort_array(F.collect_list(F.struct("oks_id", "x", "y", "flow"))).alias("terminals")).select(key, "terminals")
        c = ties.agg(F.sort_array(F.collect_list(F.struct("id", "type", "x", "y", "free"))).alias("ties")).select(key, "ties")
        around = s["restrictions"]
        leg = F.collect_list(F.struct("ax", "ay", "bx", "by"))
        lines = legs.groupBy("id.id", "dn").agg(leg.alias("legs")).agg(F.collect_list(F.struct("dn", "legs")).alias("pipes")).select(key, "pipes")
        ring = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))))
        r = around.agg(F.collect_list(F.struct("type", F.col("kind").isin("Polygon", "MultiPolygon").alias("closed"), ring.alias("rings"))).alias("restrictions")).select(key, "restrictions")
        return t.join(c, "scenario").join(r, "scenario").join(lines, "scenario"), s, legs

    def run(self, scenario: str, mode: str = "2d") -> str:
        """Plan a scenario; the run's id. ``mode``: 3d or depth, else 2D. Up to three materially different plans are kept."""
        self.scenario(scenario)
        deep = mode.lower() in ("3d", "depth")
        scenes, s, legs = self.scenes(scenario)
        starts = self.spark.range(self.starts).select(F.lit(scenario).alias("scenario"), F.col("id").cast("int").alias("start"))
        rows = materialise(planner.optimise(starts, scenes).withColumn("plan", (F.col("start") * 2 + F.when(F.col("stage") == "refined", 1).otherwise(0)).cast("long")))
        plans = rows.groupBy("plan").agg(F.first("score").alias("score"), F.first("cost").alias("cost"), F.first("length").alias("length"), F.first("unconnected").alias("unconnected"), F.first("policy").alias("policy"))
        # a tie on a pipe is named by a struct as text: whatever ids hold, none is taken for another
        pipe = F.when(F.col("existing_type") == "heat_network", F.get_json_object("existing_id", "$.id")).otherwise(F.col("existing_id"))
        nodes = rows.select("plan", "node", "kind", "x", "y", "oks_id", pipe.alias("existing_id"), "existing_type")
        edges = rows.where("parent is not null").select("plan", "parent", F.col("node").alias("child"), "path", "dn")
        # what the planner states must be what is computed anew from its plans; those that differ go no further
        size = g.path_length(F.col("path"))
        stated = rows.where("parent is not null").select("plan", "parent", F.col("node").alias("child"), "dn", size.alias("length"), F.coalesce(F.col("metres") / F.nullif(size, F.lit(0.0)), F.lit(1.0)).alias("special"))
        asked = lambda n: n.join(s["terminals"].select("oks_id", "flow"), "oks_id", "left").select("plan", F.col("node").alias("id"), F.coalesce("flow", F.lit(0.0)).alias("demand"))
        wrong = materialise(validation.sizes(stated, asked(nodes)).unionByName(validation.scores(plans, plans, nodes, stated, s["terminals"])))
        nodes, edges = (df.join(wrong.select("plan"), "plan", "left_anti") for df in (nodes, edges))
        flat = F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(p.x.alias("x"), p.y.alias("y"))))
        walls = materialise(spatial.explode_segments(s["restrictions"].select(F.col("id").alias("owner"), "type", F.col("kind").isin("Polygon", "MultiPolygon").alias("closed"), flat.alias("rings"))))
        pipes = materialise(legs.select("id.id", "dn", *spatial.SEGMENT))
        lines = s["pipes"].select("id", "path")

        def audit(n: DataFrame, e: DataFrame) -> DataFrame:
            found = [validation.geometry(n, e), validation.topology(n, e, s["terminals"], s["chambers"], lines), validation.routes(n, e, walls, pipes, deep)]
            if deep:
                named = e.select(F.struct("plan", "child").alias("edge"), "dn", "path", "length")
                crossings = materialise(depth.crossings_of(named, walls, pipes))
                found.append(validation.depths(named, depth.pieces(named.select("edge", "length", "dn"), depth.reconciled(depth.crossing_intervals(crossings, deep)), deep), crossings))
            return reduce(DataFrame.unionByName, found)

        tables = {"terminals": s["terminals"], "walls": walls, "lines": lines, "pipes": pipes, "chambers": s["chambers"]}
        nodes, edges, totals = joint.refine(nodes, edges, tables, audit, deep, self.steps)
        named = edges.select(F.struct("plan", "child").alias("edge"), "dn", "path", "length")
        parts = materialise(joint.priced(named, walls, pipes, deep))
        broken = materialise(audit(nodes, edges).unionByName(wrong))
        plans = materialise(totals.join(plans.select("plan", "policy"), "plan"))
        run = uuid.uuid4().hex
        folder = f"{self.store}/runs/{run}"
        broken.write.parquet(f"{folder}/violations")
        mode_ = "DEPTH" if deep else "TWO_D"
        valid = diversity.best_coverage(plans.join(broken.select("plan"), "plan", "left_anti").withColumn("all", F.lit(0)), ["all"]).drop("all")
        if valid.isEmpty():
            self.record(run, scenario, mode_, "ERROR", "no plan passed its validators")
            raise NoValidPlan(run)
        segments = edges.select("plan", F.posexplode(F.arrays_zip(F.slice("path", F.lit(1), F.size("path") - 1).alias("p"), F.slice("path", F.lit(2), F.size("path") - 1).alias("q"))).alias("k", "s")).select("plan", F.col("s.p.x").alias("ax"), F.col("s.p.y").alias("ay"), F.col("s.q.x").alias("bx"), F.col("s.q.y").alias("by"))
        sets = {
            "corridor": diversity.corridor_cells(segments, ["plan"]).select("plan", F.concat_ws("/", "cell_x", "cell_y").alias("item")),
            "ties": diversity.tie_items(nodes),
            "topology": diversity.topology_items(nodes, edges),
        }
        pairs = valid.select(F.col("plan").alias("a")).join(valid.select(F.col("plan").alias("b")), F.col("a") < F.col("b"))
        for measure, items in sets.items():
            pairs = pairs.join(diversity.set_distances(items, "plan", "item").withColumnRenamed("distance", measure), ["a", "b"], "left").fillna(0.0, [measure])
        different = pairs.where(diversity.materially_different(F.col("ties"), F.col("topology"), F.col("corridor")))
        best = diversity.portfolio(valid, different).select(F.explode(F.array("p1", "p2", "p3")).alias("plan")).where("plan is not null")
        kept = diversity.ranked_variants(valid.join(best, "plan").withColumn("mode", F.lit(mode_)), "mode")
        name = kept.select("plan", "variant_id")
        dn = edges.select("plan", F.explode(F.array("parent", "child")).alias("node"), "dn").groupBy("plan", "node").agg(F.max("dn").alias("d"))
        one = Window.partitionBy("edge").orderBy("at")
        cut = parts.withColumn("seq", F.row_number().over(one) - 1).withColumn("last", F.lead("at").over(one).isNull()).join(named.select("edge", "path"), "edge")
        level = lambda p: F.col("from_depth") + (F.col("to_depth") - F.col("from_depth")) * (p.at - F.col("at")) / (F.col("to") - F.col("at"))
        points = F.transform(g.part_of(F.col("path"), F.col("at"), F.col("to")), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), level(p).alias("depth")))
        cut = cut.select("edge.*", "seq", "last", points.alias("points"), (F.col("to") - F.col("at")).alias("length"), "cost", "factor", "from_depth", "to_depth")
        out_edges = edges.select("plan", "parent", "child", "dn", "flow").join(cut, ["plan", "child"]).join(name, "plan")
        points = s["terminals"].groupBy("oks_id").agg(F.min("point_id").alias("point_id"))
        out_nodes = nodes.join(dn, ["plan", "node"], "left").join(name, "plan").join(points, "oks_id", "left").select("variant_id", "node", "kind", "x", "y", "point_id", "existing_id", "existing_type", F.col("d").alias("dn"))
        reached = nodes.where("oks_id is not null").join(name, "plan").select("variant_id", "oks_id")
        left = s["terminals"].select("oks_id").crossJoin(F.broadcast(name.select("variant_id"))).join(reached, ["variant_id", "oks_id"], "left_anti")  # three variants at the most
        left = left.groupBy("variant_id").agg(F.sort_array(F.collect_list("oks_id")).alias("missing"))
        variants = kept.join(left, "variant_id", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
        variants = materialise(variants.select("variant_id", "plan", "rank", "policy", "score", "cost", "length", "unconnected", "construction", "chambers", "ties", "penalty", "missing"))
        variants.write.parquet(f"{folder}/variants")
        export.feature_rows(variants, out_nodes, out_edges, deep).write.partitionBy("variant_id").parquet(f"{folder}/features")
        # what the variants' ties ask of the existing network; no part of their prices
        roots = edges.groupBy("plan", F.col("parent").alias("node")).agg(F.sum("flow").alias("flow"), F.max("dn").alias("dn"))
        nodes.where("kind = 'TIE_IN'").join(roots, ["plan", "node"]).join(name, "plan").select("variant_id", "plan", "existing_id", "existing_type", "x", "y", "flow", "dn").write.parquet(f"{folder}/ties")
        self.record(run, scenario, mode_, "DONE", None)
        return run

    def record(self, run: str, scenario: str, mode: str, status: str, error: str | None) -> None:
        row = [F.lit(v).cast("string").alias(k) for k, v in (("id", run), ("scenario_id", scenario), ("mode", mode), ("status", status), ("error", error))]
        self.spark.range(1).select(*row, F.lit(100).alias("progress"), F.current_timestamp().alias("created_at")).write.mode("append").parquet(f"{self.store}/run_list")

    def status(self, run: str) -> dict:
        return self.one("run_list", run)

    def variants(self, run: str) -> DataFrame:
        self.status(run)
        return self.spark.read.parquet(f"{self.store}/runs/{run}/variants").orderBy("rank")

    def variant(self, run: str, variant_id: str) -> dict:
        rows = self.variants(run).where(F.col("variant_id") == variant_id).collect()
        if not rows:
            raise NotFound(variant_id)
        return rows[0].asDict()

    def features(self, run: str, variant_id: str | None = None) -> DataFrame:
        out = self.spark.read.parquet(f"{self.store}/runs/{run}/features")
        return out if variant_id is None else out.where(F.col("variant_id") == variant_id)

    def reconstruction(self, run: str) -> tuple[DataFrame, DataFrame]:
        """(lines, chambers) of the existing network that each variant's ties make too narrow, with what rebuilding them would cost."""
        s = geojson.snapshot(self.spark, self.store, self.status(run)["scenario_id"])
        ties = self.spark.read.parquet(f"{self.store}/runs/{run}/ties").drop("plan").withColumnRenamed("variant_id", "plan")
        pipes = s["pipes"].select("id", "upstream", "path", F.col("diameter").alias("dn"), "flow")
        chambers = s["chambers"].select("id", "upstream", F.col("diameter").alias("dn"), "x", "y")
        lines = materialise(reconstruction.lines(ties, pipes, chambers, s["source"]))
        named = lambda df: df.withColumnRenamed("plan", "variant_id")
        return named(lines), named(reconstruction.chambers_of(ties, pipes, chambers, lines))

    def violations(self, run: str, variant_id: str | None = None) -> DataFrame:
        """(plan, rule, object, detail) of the plans of a run that its validators rejected; of a variant, of the plan that it is."""
        self.status(run)
        out = self.spark.read.parquet(f"{self.store}/runs/{run}/violations")
        return out if variant_id is None else out.where(F.col("plan") == F.lit(self.variant(run, variant_id)["plan"]))

    def check(self, run: str) -> DataFrame:
        """What the output validator has against a run's features, as they are written; no rows: it passes."""
        return validation.exported(export.feature_text(self.features(run)))

    def export(self, run: str, path: str, variant_id: str | None = None) -> None:
        export.write(self.features(run, variant_id), path)


__all__ = ["Engine", "NoValidPlan", "NotFound"]
