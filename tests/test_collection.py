"""One FeatureCollection cut anywhere, against json.loads of the whole."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelvingrid.sources import collection, geojson

ODD = ['a "quoted" {text}', "back\\slash\\\\", "}", "{[", "тест }{", "\\\"}", "line\nbreak", ""]


def corpus(seed, n=60):
    r = random.Random(seed)
    feature = lambda k: {"type": "Feature", "properties": {"id": k, "note": r.choice(ODD), r.choice(ODD) + "k": [r.choice(ODD), {"a": {}}]}, "geometry": None if k % 7 == 0 else {"type": "LineString", "coordinates": [[k, 0.5], [1, 2]] * r.randrange(1, 6)}}
    root = {"name": r.choice(ODD), "crs": {"type": "name", "properties": {"x": [{}, {}]}}, "others": [{"no": "feature"}, 3, [{}]], "type": "FeatureCollection"}
    items = [*root.items(), ("features", [feature(k) for k in range(n)])]
    r.shuffle(items)
    return dict(items)


def write(tmp_path, text):
    p = tmp_path / f"c{random.randrange(1 << 40)}.geojson"
    p.write_text(text)
    return str(p)


@pytest.fixture
def small_blocks(spark, request):
    names = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    request.addfinalizer(lambda: [spark.conf.unset(k) for k in names])


@pytest.mark.parametrize("seed, style", [(0, {}), (1, {"indent": 2}), (2, {"ensure_ascii": False, "separators": (",", ":")})])
def test_cut_collection_equals_whole(spark, tmp_path, small_blocks, seed, style):
    whole = corpus(seed)
    path = write(tmp_path, json.dumps(whole, **style) + ("\n" if seed else ""))
    rows = collection.features(spark, path).orderBy("seq").collect()
    assert [r.seq for r in rows] == list(range(60)) and {r.fault for r in rows} == {None}
    assert [json.loads(r.text) for r in rows] == whole["features"]
    blocks = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_block_start")).distinct().count()
    assert blocks > 8


def test_a_feature_over_many_blocks(spark, tmp_path, small_blocks):
    wide = {"type": "Feature", "properties": {"id": 1, "list": [{"k": k} for k in range(2000)]}, "geometry": None}
    whole = {"type": "FeatureCollection", "features": [{"properties": {}}, wide, {"properties": {"id": 2}}]}
    rows = collection.features(spark, write(tmp_path, json.dumps(whole))).orderBy("seq").collect()
    assert [json.loads(r.text) for r in rows] == whole["features"]
    assert collection.features(spark, write(tmp_path, '{"features": [ ], "type": "FeatureCollection"}')).count() == 0


@pytest.mark.parametrize("text", [
    '[]', '{"type":"FeatureCollection"}', '{"type":"X","features":[]}', '{"type":"FeatureCollection","features":{}}', '{"type":"FeatureCollection","features":[]} trailing', '{"type":"FeatureCollection","features":[]}{}',
    '{"type":"FeatureCollection","features":[],"features":[]}', '{"type":"FeatureCollection","features":[1]}', '{"type":"FeatureCollection","features":[{},{},]}', '{"type":"FeatureCollection","features":[,{}]}', '{"type":"FeatureCollection","features":[{} {}]}',
    '{"type":"FeatureCollection","features":[{},,{}]}', '{"type":"FeatureCollection","features":[{}}}', '{"type":"FeatureCollection","features":[{}]', '{"type":"FeatureCollection","features":["a"]}', '{"type":"FeatureCollection" "features":[]}', '{"type":"FeatureCollection","features":[[{}]]}', ' ',
])
def test_broken_roots(spark, tmp_path, text):
    with pytest.raises(geojson.InputError) as e:
        geojson.scan(spark, write(tmp_path, text)).collect()
    assert e.value.violations[0][0] == "root"


def test_a_compressed_file_is_refused(spark, tmp_path):
    import gzip

    path = tmp_path / "c.geojson.gz"
    path.write_bytes(gzip.compress(json.dumps(corpus(3)).encode()))
    with pytest.raises(collection.CollectionError, match="compressed"):
        collection.features(spark, str(path))


def test_faults_of_features(spark, tmp_path):
    text = '{"type":"FeatureCollection","features":[{"properties":{"id":"a","b":{"x":1,"x":2}}},{"properties":{"id":"b"},"properties":{}},{"properties":{"id":"c",}},{"properties":{"id":"d"}}]}'
    assert [r.fault for r in geojson.scan(spark, write(tmp_path, text)).orderBy("seq").collect()] == ["keys", "keys", "json", None]
    rules = {(r.rule, r.id) for r in geojson.violations(geojson.typed(geojson.scan(spark, write(tmp_path, text)))).collect()}
    assert ("keys", "a") in rules and any(r == "json" for r, _ in rules) and ("keys", "d") not in rules


def test_states_of_blocks_join_up():
    data = json.dumps(corpus(4), ensure_ascii=False).encode()
    cuts = [k + 1 for k, b in enumerate(data) if b == 125]
    for at in random.Random(1).sample(cuts, 25):
        parts = [data[:at], data[at:]]
        pieces = [p.decode("utf-8", "surrogateescape") for p in parts]
        assert len(pieces) == 2
        one, two = (np.frombuffer(p, np.uint8) for p in parts)
        _, _, step, inside = collection.marks(one, False)
        _, _, rest, after = collection.marks(two, inside)
        assert int(step.sum() + rest.sum()) == 0 and not after


def test_escaped_quotes():
    data = np.frombuffer(rb'"a\"b" "c\\" "d\\\"e"', np.uint8)
    assert [int(p) for p in collection.quotes(data)] == [0, 5, 7, 11, 13, 20]
    assert collection.joined(pa.array(["a", "", "b"])).tobytes() == b"a}}b}"
