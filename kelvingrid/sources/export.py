"""Results as GeoJSON features: rows first, files from rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelvingrid.functions import projection
from kelvingrid.plans import rules

from .geojson import geometry_text

POINTS = "array<struct<x:double,y:double,z:double>>"


def _points(path: Column, depth: Column | None) -> Column:
    """Points in degrees; z is the negative depth in the depth mode."""
    z = F.lit(None).cast("double") if depth is None else -depth
    return projection.path_to_wgs(F.transform(path, lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), z.alias("z"))))


def feature_rows(variants: DataFrame, nodes: DataFrame, pieces: DataFrame, three_d: bool = False, depth: float = rules.DEPTH) -> DataFrame:
    """One row for each exported object: (variant_id, rank, object_type, id, geometry, properties).

    ``variants(variant_id, rank, construction, chambers, ties, penalty, cost, length, score, missing)``, ``nodes(variant_id, node, kind, x, y, point_id, existing_id, existing_type, dn)``,
    ``pieces(variant_id, parent, child, seq, last, points, dn, flow, length, cost, factor, from_depth, to_depth)``: an edge's costed pieces in order, with
    ``points`` (x, y, depth). Between two pieces of an edge lies a technical node. A terminal goes by its point's id and a tie at an existing chamber by that chamber's, which isn't
    written again. The first piece of an edge out of an existing chamber bears the price of the tie. Rebuilding the existing network costs nothing here.
    """
    deep = F.lit(depth) if three_d else None
    none = F.lit(None).cast("double")
    text = {"ignoreNullFields": "false"}

    def rows(df: DataFrame, kind: str, id_: Column, geometry: Column, properties: list) -> DataFrame:
        return df.select("variant_id", "rank", F.lit(kind).alias("object_type"), id_.alias("id"), geometry.alias("geometry"), F.to_json(F.struct(*properties), text).alias("properties"))

    at_chamber = (F.col("kind") == "TIE_IN") & (F.coalesce("existing_type", F.lit("")) == "heat_chamber")
    own = F.concat_ws("_", F.lit("ch"), "variant_id", "node")
    named = nodes.withColumn("name", F.when(F.col("kind") == "TERMINAL", F.col("point_id").cast("string")).when(at_chamber, F.col("existing_id").cast("string")).otherwise(own))
    ends = named.select("variant_id", "node", "name", at_chamber.alias("tied"))
    n = named.where(F.col("kind").isin("CHAMBER", "TIE_IN") & ~at_chamber).join(variants.select("variant_id", "rank"), "variant_id")
    dn = F.coalesce("dn", F.lit(0))
    chambers = rows(n, "heat_chamber", F.col("name"), geometry_text(F.lit("Point"), _points(F.array(F.struct("x", "y")), deep), three_d), [dn.alias("diameter"), F.when(dn > 0, rules.chamber_cost(dn)).otherwise(0.0).alias("cost")])
    technical = lambda seq: F.concat_ws("_", F.lit("tech"), "variant_id", "child", seq)
    e = pieces.join(variants.select("variant_id", "rank"), "variant_id")
    e = e.join(ends.select("variant_id", F.col("node").alias("parent"), F.col("name").alias("above"), "tied"), ["variant_id", "parent"]).join(ends.select("variant_id", F.col("node").alias("child"), F.col("name").alias("below")), ["variant_id", "child"])
    z = (lambda p: -p.depth) if three_d else (lambda p: F.lit(None).cast("double"))
    path = projection.path_to_wgs(F.transform("points", lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), z(p).alias("z"))))
    depths = [F.col("from_depth") if three_d else none, F.col("to_depth") if three_d else none]
    fields = [
        F.when(F.col("seq") == 0, F.col("above")).otherwise(technical(F.col("seq"))).alias("start_node_id"), F.when(F.col("last"), F.col("below")).otherwise(technical(F.col("seq") + 1)).alias("end_node_id"),
        F.col("flow").alias("flow_tph"), F.col("dn").alias("diameter"), "length", F.when(F.col("factor") > 1, "special").otherwise("base").alias("laying_method"),
        depths[0].alias("depth_start"), depths[1].alias("depth_end"), "cost", F.when((F.col("seq") == 0) & F.col("tied"), rules.CHAMBER_TIE).otherwise(0.0).alias("tie_in_cost"),
    ]
    lines = rows(e, "heat_network", F.concat_ws("_", F.lit("new"), "variant_id", "child", "seq"), geometry_text(F.lit("LineString"), path, three_d), fields)
    between = e.where("not last").withColumn("p", F.element_at(path, -1))
    bare = rows(between, "technical_node", technical(F.col("seq") + 1), geometry_text(F.lit("Point"), F.array("p"), three_d), [F.col("child").alias("edge")])
    zero = F.lit(0.0)
    totals = [
        "rank", F.col("construction").alias("construction_cost"), F.col("chambers").alias("chamber_construction_cost"), F.col("ties").alias("tie_in_cost"), zero.alias("reconstruction_cost"), zero.alias("chamber_reconstruction_cost"),
        F.col("penalty").alias("unconnected_penalty"), F.col("cost").alias("calculated_cost"), F.col("length").alias("new_network_length"), zero.alias("reconstruction_length"), "length", "score", F.col("missing").alias("unconnected_oks_ids"),
    ]
    summary = rows(variants, "variant_summary", F.concat_ws("_", F.lit("summary"), "variant_id"), F.lit(None).cast("string"), totals)
    return lines.unionByName(chambers).unionByName(bare).unionByName(summary)


def feature_text(rows: DataFrame) -> DataFrame:
    """(variant_id, rank, object_type, id, value): each row as a feature's text."""
    head = F.to_json(F.struct("id", "variant_id", "object_type"))
    merged = F.concat(F.regexp_replace(head, r"\}$", ","), F.regexp_replace("properties", r"^\{", ""))
    return rows.select("variant_id", "rank", "object_type", "id", F.concat(F.lit('{"type":"Feature","properties":'), merged, F.lit(',"geometry":'), F.coalesce("geometry", F.lit("null")), F.lit("}")).alias("value"))


def write(rows: DataFrame, path: str) -> None:
    """One FeatureCollection, variants in the order of their rank. Rows are sorted by the cluster; one task writes the file, no row passes the driver."""
    order = {"heat_network": 0, "heat_chamber": 1, "technical_node": 2, "variant_summary": 3}
    text = feature_text(rows).withColumn("o", F.element_at(F.create_map(*[F.lit(x) for p in order.items() for x in p]), F.col("object_type")))
    spark = rows.sparkSession
    key = F.struct(F.col("rank").cast("int").alias("rank"), "o", "id")
    first = text.agg(F.min(key)).first()[0]
    leads = F.lit(False) if first is None else (F.col("rank") == first[0]) & (F.col("o") == first[1]) & (F.col("id") == first[2])
    body = text.select(key.alias("at"), F.when(leads, F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"))
    edge = lambda n, line: spark.range(1).select(F.struct(F.lit(n).alias("rank"), F.lit(0).alias("o"), F.lit("").alias("id")).alias("at"), F.lit(line).alias("value"))
    whole = body.unionByName(edge(-(1 << 31), '{"type":"FeatureCollection","features":[')).unionByName(edge((1 << 31) - 1, "]}"))
    part = f"{path}.parts"
    whole.repartition(1).sortWithinPartitions("at").select("value").write.mode("overwrite").text(part)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(part).getFileSystem(spark._jsc.hadoopConfiguration())
    written = [f.getPath() for f in fs.globStatus(hadoop.Path(f"{part}/part-*")) if f.getLen()]
    fs.delete(hadoop.Path(path), False)
    fs.rename(written[0], hadoop.Path(path))
    fs.delete(hadoop.Path(part), True)


def variant(spark: SparkSession, path: str, variant_id: str) -> DataFrame:
    """The features of one variant of a written file: (properties, geometry)."""
    root = spark.read.schema("features array<struct<type:string,properties:string,geometry:string>>").json(path, multiLine=True)
    f = root.select(F.explode("features").alias("f")).select("f.properties", "f.geometry")
    return f.where(F.get_json_object("properties", "$.variant_id") == variant_id)
