"""GeoJSON scenarios: scan, typed rows, constraint checks, and the scenario tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvingrid.functions import geometry as g
from kelvingrid.functions import projection
from kelvingrid.operators import topology
from kelvingrid.operators.graph import reached
from kelvingrid.operators.spatial import SEGMENT, explode_segments, overlap_join, segment_boxes
from kelvingrid.plans import rules
from kelvingrid.plans.shared import discard, materialise, sorted_join

from . import collection

LIMIT = 3 << 30
POINT = "struct<x:double,y:double,z:double>"
RINGS = f"array<array<{POINT}>>"
#: Which geometries an object type may have.
GEOMETRIES = {
    "source": ("Point",),
    "heat_network": ("LineString",),
    "heat_chamber": ("Point",),
    "oks_future": ("Polygon", "MultiPolygon"),
    "oks_connection_point": ("Point",),
    "oks_existing": ("Polygon", "MultiPolygon"),
    "restriction": ("Point", "LineString", "Polygon", "MultiPolygon", "MultiLineString"),
}
KINDS = ("Point", "LineString", "Polygon", "MultiPolygon", "MultiLineString")


class InputError(ValueError):
    """A scenario that breaks the input contract; ``violations`` holds (rule, id, detail) of the first rows."""

    def __init__(self, violations: list[tuple[str, str | None, str]]):
        super().__init__("; ".join(f"{r}: {i or '-'}: {d}" for r, i, d in violations[:5]))
        self.violations = violations
        self.check: str | None = None  # under which an engine stores them


def scan(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Features of a FeatureCollection, or of JSON lines (one feature a line): (seq, properties, kind, coordinates, fault). Both are read by many tasks.

    Coordinates and properties stay text. A collection needs ``type`` and ``features``; other fields of the root are skipped. ``fault`` tells of a feature
    that is no JSON (``json``) or names a key twice at any level (``keys``).
    """
    feature = "struct<type:string,properties:string,geometry:struct<type:string,coordinates:string>>"
    if lines:
        rows = spark.read.schema("properties string, geometry struct<type:string,coordinates:string>").json(path, mode="FAILFAST")
        return rows.select(F.monotonically_increasing_id().alias("seq"), "properties", F.col("geometry.type").alias("kind"), F.col("geometry.coordinates").alias("coordinates"), F.lit(None).cast("string").alias("fault"))
    size = spark.read.text(path).select(F.col("_metadata.file_path"), F.col("_metadata.file_size").alias("n")).limit(1).collect()
    if size and size[0].n > LIMIT:
        raise InputError([("size", None, f"more than {LIMIT} bytes")])
    try:
        rows = collection.features(spark, path)
    except collection.CollectionError as e:
        raise InputError([("root", None, str(e))]) from None
    f = F.from_json("text", feature)
    return rows.select("seq", f.alias("f"), "fault").select("seq", "f.properties", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("coordinates"), "fault")


def _closed(rings: Column) -> Column:
    same = lambda r: (F.element_at(r, 1)["x"] == F.element_at(r, -1)["x"]) & (F.element_at(r, 1)["y"] == F.element_at(r, -1)["y"])
    return F.transform(rings, lambda r: F.when((F.size(r) > 0) & ~same(r), F.concat(r, F.array(F.element_at(r, 1)))).otherwise(r))


def rings_of(kind: Column, coordinates: Column) -> Column:
    """All geometries as arrays of rings of points; polygons' rings are closed. Null for other kinds or broken coordinates."""
    nest = lambda depth: "array<" * depth + "double" + ">" * depth
    point = lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"), F.get(p, 2).alias("z"))
    line = lambda c: F.transform(c, point)
    one = F.from_json(coordinates, nest(1))
    two, three, four = F.from_json(coordinates, nest(2)), F.from_json(coordinates, nest(3)), F.from_json(coordinates, nest(4))
    return (
        F.when(kind == "Point", F.array(F.array(point(one)))).when(kind == "LineString", F.array(line(two))).when(kind == "MultiLineString", F.transform(three, line))
        .when(kind == "Polygon", _closed(F.transform(three, line))).when(kind == "MultiPolygon", _closed(F.transform(F.flatten(four), line)))
    )


def scalar(properties: Column, name: str) -> Column:
    """A property as text; null if it is missing, blank, or an object."""
    v = F.get_json_object(properties, f"$.{name}")
    return F.when((F.trim(v) == "") | v.startswith("{") | v.startswith("["), F.lit(None).cast("string")).otherwise(v)


def typed(rows: DataFrame) -> DataFrame:
    """Feature rows in metres, with their bounding boxes and defaults."""
    p = F.col("properties")
    if "fault" not in rows.columns:
        rows = rows.withColumn("fault", F.lit(None).cast("string"))
    out = rows.select(
        "seq", "fault", scalar(p, "id").alias("id"), scalar(p, "object_type").alias("object_type"), scalar(p, "restriction_type").alias("restriction_type"), "kind", rings_of(F.col("kind"), F.col("coordinates")).alias("wgs"),
        F.try_to_number(scalar(p, "diameter"), F.lit("9999999")).cast("int").alias("diameter"), scalar(p, "flow_tph").try_cast("double").alias("flow_tph"),
        scalar(p, "upstream_object_id").alias("upstream"), scalar(p, "oks_id").alias("oks_id"), F.col("properties").alias("properties_json"),
        F.to_json(F.struct(F.col("kind").alias("type"), F.col("coordinates"))).alias("geometry_json"),
    )
    out = out.withColumn("rings", F.transform("wgs", projection.path_to_utm)).drop("wgs")
    flat = F.flatten("rings")
    axis = lambda a, f: f(F.transform(flat, lambda q: q[a]))
    out = out.withColumns({"min_x": axis("x", F.array_min), "min_y": axis("y", F.array_min), "max_x": axis("x", F.array_max), "max_y": axis("y", F.array_max)})
    t = F.col("object_type")
    return out.withColumns({
        "flow_tph": F.when((t == "heat_network") & F.col("flow_tph").isNull(), 0.0).otherwise(F.col("flow_tph")),
        "oks_id": F.when((t == "oks_connection_point") & F.col("oks_id").isNull() & F.col("flow_tph").isNotNull(), F.col("id")).otherwise(F.col("oks_id")),
    })


def orphans(points: DataFrame, buildings: DataFrame) -> DataFrame:
    """Those of ``points(id, oks_id)`` that name a building which ``buildings(oks_id)`` hasn't; a point that names itself needs none."""
    return sorted_join(points.where(F.col("oks_id") != F.col("id")), buildings, "oks_id", "left_anti")


def demands(points: DataFrame, buildings: DataFrame) -> DataFrame:
    """``points(oks_id, own)`` with ``flow``: that of their building in ``buildings(oks_id, flow)``, else their own, else 0."""
    return points.join(buildings, "oks_id", "left").withColumn("flow", F.coalesce("flow", "own", F.lit(0.0))).drop("own")


def violations(features: DataFrame) -> DataFrame:
    """(rule, id, detail) of every row that breaks the contract; a valid scenario has none. The typed rows are written once, for all rules."""
    return broken_rules(materialise(features, "features"))


def broken_rules(f: DataFrame) -> DataFrame:
    """``violations`` of a written table."""
    t = F.col("object_type")
    spark = f.sparkSession
    row = lambda rule, cond, detail: f.where(cond).select(F.lit(rule).alias("rule"), "id", detail.cast("string").alias("detail"))
    allowed = spark.createDataFrame([(o, k) for o, ks in GEOMETRIES.items() for k in ks], "object_type string, kind string")
    rings = F.col("rings")
    short = F.exists(rings, lambda r: F.size(r) < 4)
    polygon = F.col("kind").isin("Polygon", "MultiPolygon")
    holed = F.exists(F.flatten(rings), lambda p: p.x.isNull() | p.y.isNull() | F.isnan(p.x) | F.isnan(p.y))
    known = [r[0] for r in rules.RESTRICTIONS]
    parts = [
        row("id", F.col("id").isNull(), t),
        row("geometry", rings.isNull() | (F.size(F.flatten(rings)) < 1) | holed, F.col("kind")),
        row("geometry", polygon & short, F.lit("a ring needs four points")),
        row("geometry", (F.col("kind").isin("LineString", "MultiLineString")) & F.exists(rings, lambda r: F.size(r) < 2), F.lit("a line needs two points")),
        f.join(F.broadcast(allowed), ["object_type", "kind"], "left_anti").select(F.lit("geometry-type").alias("rule"), "id", F.concat_ws(" ", "object_type", "kind").alias("detail")),
        row("restriction-type", (t == "restriction") & ~F.coalesce(F.col("restriction_type").isin(known), F.lit(False)), F.col("restriction_type")),
        row("diameter", (t == "heat_network") & F.col("diameter").isNull(), F.lit("missing")),
        row("diameter", F.col("diameter").isNotNull() & ~F.col("diameter").isin([r[0] for r in rules.DN_TABLE]), F.col("diameter")),
        row("flow", (t == "oks_future") & F.col("flow_tph").isNull(), F.lit("missing")),
        row("flow", F.col("flow_tph") < 0, F.col("flow_tph")),
        row("oks-id", (t == "oks_connection_point") & F.col("oks_id").isNull(), F.lit("missing")),
        row("keys", F.col("fault") == "keys", F.lit("a key is repeated")),
        row("json", F.col("fault") == "json", F.lit("it is no JSON")),
        f.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("unique-id").alias("rule"), "id", F.col("n").cast("string").alias("detail")),
        f.agg(F.count_if(t == "source").alias("n")).where("n <> 1").select(F.lit("one-source").alias("rule"), F.lit(None).cast("string").alias("id"), F.col("n").cast("string").alias("detail")),
        orphans(f.where(t == "oks_connection_point"), f.where(t.isin("oks_future", "oks_existing")).select(F.col("id").alias("oks_id"))).select(F.lit("oks-reference").alias("rule"), "id", F.col("oks_id").alias("detail")),
    ]
    net = f.where(t.isin("heat_network", "heat_chamber") & F.col("upstream").isNotNull()).select("id", "upstream")
    found = reached(net, f.where(t == "source").select("id"))
    parts.append(net.join(found, "id", "left_anti").select(F.lit("unreachable").alias("rule"), "id", F.col("upstream").alias("detail")))
    # rings that cross themselves, or each other
    legs = explode_segments(f.where(polygon & rings.isNotNull()).select("id", "rings")).withColumn("feature", F.col("id")).withColumn("id", F.struct("ring", "seq"))
    boxed = segment_boxes(legs.select("id", "feature", *SEGMENT))
    ends, other = [tuple(F.col(f"{p}{c}") for c in SEGMENT) for p in ("", "r_")]
    crossed = overlap_join(boxed, boxed, 200.0, 0.0, (F.col("id") < F.col("r_id")) & g.crosses(ends, other), on=("feature",))
    parts.append(crossed.select(F.lit("geometry").alias("rule"), F.col("feature").alias("id"), F.lit("a ring crosses itself or another").alias("detail")).distinct())
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def check(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(rule, id, detail) of what a scenario file breaks; nothing is stored."""
    return violations(typed(scan(spark, path, lines)))


def find(spark: SparkSession, store: str, scenario: str, feature: str) -> DataFrame:
    """The row of one feature of a scenario, if it has it."""
    return spark.read.parquet(f"{store}/features").where((F.col("scenario_id") == scenario) & (F.col("id") == feature))


def ingest(spark: SparkSession, path: str, store: str, name: str, lines: bool = False) -> str:
    """Read, check and store a scenario; its id. Raises InputError and stores nothing if a constraint is broken."""
    features = materialise(typed(scan(spark, path, lines)), "features")
    try:
        broken = broken_rules(features).orderBy("rule", "id").limit(100).collect()
        if broken:
            raise InputError([tuple(r) for r in broken])
        scenario = uuid.uuid4().hex
        features.withColumn("scenario_id", F.lit(scenario)).write.partitionBy("scenario_id", "object_type").option("maxRecordsPerFile", 1_000_000).mode("append").parquet(f"{store}/features")
        n = features.count()
        spark.range(1).select(F.lit(scenario).alias("id"), F.lit(name).alias("name"), F.lit("READY").alias("status"), F.current_timestamp().alias("created_at"), F.lit(n).cast("long").alias("feature_count")).write.mode("append").parquet(f"{store}/scenarios")
        return scenario
    finally:
        discard(features)


def features(spark: SparkSession, store: str, scenario: str, object_type: str | None = None) -> DataFrame:
    """A scenario's rows in the order of the file; both filters prune partitions."""
    out = spark.read.parquet(f"{store}/features").where(F.col("scenario_id") == scenario)
    return (out if object_type is None else out.where(F.col("object_type") == object_type)).orderBy("seq")


def snapshot(spark: SparkSession, store: str, scenario: str, reach: float = 5000.0) -> dict[str, DataFrame]:
    """What a run works on: source, pipes, chambers, terminals, and the restrictions within ``reach`` of the terminals."""
    f = spark.read.parquet(f"{store}/features").where(F.col("scenario_id") == scenario)
    first = F.element_at(F.element_at("rings", 1), 1)
    of = lambda *types: f.where(F.col("object_type").isin(*types))
    point = [first["x"].alias("x"), first["y"].alias("y")]
    source = of("source").select("id", *point)
    pipes = of("heat_network").select("seq", "id", "upstream", "diameter", F.col("flow_tph").alias("flow"), F.element_at("rings", 1).alias("path"))
    chambers = of("heat_chamber").select("seq", "id", "upstream", "diameter", *point)
    a, b = F.element_at("path", 1), F.element_at("path", -1)
    ends = pipes.select("seq", "id", "upstream", F.col("diameter").alias("dn"), g.path_length(F.col("path")).alias("length"), a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"), "flow", "path")
    lines, nodes = topology.resolve(source, ends, chambers.withColumnRenamed("diameter", "dn"))
    pipes = materialise(lines.select("seq", "id", "upstream", F.col("dn").alias("diameter"), "flow", "path"))
    chambers = materialise(nodes.select("seq", "id", "upstream", F.col("dn").alias("diameter"), "x", "y"))
    own = of("oks_connection_point").select("seq", F.col("id").alias("point_id"), "oks_id", F.col("flow_tph").alias("own"), *point)
    terminals = demands(own, of("oks_future").select(F.col("id").alias("oks_id"), F.col("flow_tph").alias("flow"))).select("seq", "oks_id", "point_id", "x", "y", "flow")
    box = terminals.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    r = f.where(F.col("object_type").isin("restriction", "oks_existing", "oks_future"))
    if box[0] is not None:
        r = r.where((F.col("max_x") >= box[0] - reach) & (F.col("min_x") <= box[2] + reach) & (F.col("max_y") >= box[1] - reach) & (F.col("min_y") <= box[3] + reach))
    kind = F.when((F.col("restriction_type") == "oks") | F.col("object_type").isin("oks_existing", "oks_future"), "oks_existing").otherwise(F.col("restriction_type"))
    restrictions = r.select("seq", "id", kind.alias("type"), "kind", "rings", "min_x", "min_y", "max_x", "max_y")
    return {"source": source, "pipes": pipes, "chambers": chambers, "terminals": terminals, "restrictions": restrictions}


def geometry_text(kind: Column, points: Column, has_z: bool = False) -> Column:
    """A Point, LineString or Polygon as GeoJSON text, its points in degrees; z only where it is finite."""
    c = F.transform(points, lambda p: F.when(p.z.isNotNull() & ~F.isnan(p.z), F.array(p.x, p.y, p.z)).otherwise(F.array(p.x, p.y)) if has_z else F.array(p.x, p.y))
    shape = F.when(kind == "Point", F.to_json(F.element_at(c, 1))).when(kind == "LineString", F.to_json(c)).when(kind == "Polygon", F.to_json(F.array(c))).otherwise(F.raise_error(F.concat(F.lit("no such output geometry: "), kind)))
    return F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), shape, F.lit("}"))
