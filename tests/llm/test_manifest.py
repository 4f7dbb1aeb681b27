"""The Merkle manifest against a tree built in plain Python, and its proofs against forged ones."""

import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kelvingrid.llm import manifest

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, pos string, tree int, digest binary"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes, fanout=3):
    """All levels, and for each leaf its runs' (left, right) siblings."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([h(*low[i : i + fanout]) for i in range(0, len(low), fanout)])
    steps = []
    for at in range(len(nodes)):
        own = []
        for low in levels[:-1]:
            run = at // fanout * fanout
            own.append(("".join(low[run:at]), "".join(low[at + 1 : run + fanout])))
            at //= fanout
        steps.append(own)
    return levels[-1][0], steps


def brute(rows, fanout=3):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r, h(*map(field, r[:5]))))
    order = sorted(by, key=lambda s: b"" if s is None else b"=" + s.encode())
    roots = {}
    for s in order:
        by[s].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        roots[s] = climb([leaf for _, leaf in by[s]], fanout)
    root, above = climb([roots[s][0] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for (r, leaf), own in zip(by[s], roots[s][1], strict=True):
            path = own + above[k]
            text = r[4]
            tampered = text is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            now = h(*map(field, (*r[:4], text.replace("\n", "")))) if tampered else leaf
            for left, right in path:
                now = h(left, now, right)
            out.append((r[0], leaf, roots[s][0], root, h(*[a + b for a, b in path]), now, now == root))
    return out


def table(sources, seed):
    r = random.Random(seed)
    rows = []
    for s, n in sources:
        for _ in range(n):
            text = r.choice([None, "", "plain", "a\nb", "\n", "déjà\nvu " * r.randrange(1, 40), "x" * 3000 + "\n"])
            rows.append((r.choice([None, *range(40)]), s, r.choice(["en", None, ""]), r.choice([None, 7]), text, "clash", 5, b"z"))
    return rows


@pytest.mark.parametrize("sources", [[("a", 1)], [(None, 9), ("", 3), ("a", 82), ("z", 1), ("ä", 28), ("-", 4), ("b", 10)]], ids=["one", "many"])
def test_manifest_equals_brute_force(spark, sources):
    rows = table(sources, 5)
    rows += rows[:3] * 2  # repeated rows are leaves of their own
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = manifest.audit(docs)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == Counter(brute(rows))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    out = manifest.audit(docs)
    assert out.collect() == [] and dict(out.dtypes)["verified"] == "boolean"
    assert manifest.Manifest(docs).root is None


def test_equal_rows_spread_over_runs(spark, request):
    # small partitions are not to be merged here
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    rows = [(1, "hot", "en", 1, "same", "c", 1, b"")] * 500 + [(k, "s", "en", 1, f"t{k}", "c", 1, b"") for k in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    m = manifest.Manifest(docs, fanout=2)
    got = m.proofs().collect()
    assert len(got) == 600 and {r.pos for r in got if r.doc_id == 1 and r.leaf == h(*map(field, rows[0][:5]))} >= set(range(500))
    files = m.trees.level(0).where("tree = '=hot'").groupBy(F.input_file_name()).count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < 400


def test_proofs_of_chosen_groups_and_forged_ones(spark):
    rows = table([("a", 40), ("b", 7)], 9)
    m = manifest.Manifest(spark.createDataFrame(rows, SCHEMA), fanout=4)
    some = m.proofs(["=b"]).select("leaf", "steps", manifest.folded(F.col("leaf"), F.col("steps")).alias("root"), manifest.folded(F.sha2(F.lit("forged"), 256), F.col("steps")).alias("forged")).collect()
    assert len(some) == 7 and {r.root for r in some} == {m.root} and m.root not in {r.forged for r in some}
    # one changed row changes the root, its own group's subroot, and no other
    rows[0] = (*rows[0][:4], "changed", *rows[0][5:])
    other = manifest.Manifest(spark.createDataFrame(rows, SCHEMA), fanout=4)
    old, new = ({r.tree: r.subroot for r in x.subroots().collect()} for x in (m, other))
    assert other.root != m.root and old["=b"] == new["=b"] and old["=a"] != new["=a"]
    assert m.trees.depth == 4 and m.trees.level(3).where("tree = '=a'").count() == 1
