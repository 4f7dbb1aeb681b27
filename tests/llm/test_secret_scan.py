"""Secrets against Python's re over every text, and what the ledger scans again."""

import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from kelvingrid.llm import common, secret_scan, sieve

SCHEMA = "doc_id long, text string, blob string, todo int, n long"
PIECES = [
    "token = abc", 'password: "hunter22"', "PASSWD=ab12", "secret:token: abcdef123", "Api_Key  =  'Zm9vYmFyYmF6'", "apikey=1", "toKen=abcdef", "AKIA" + "Q" * 16, "AKIA" + "Q" * 15, "AKIAAKIA" + "7" * 14,
    "deadbeef" * 3, "deadbeef" * 2, "0" * 60, "DEADBEEF" * 4, "é" * 5, "token=" + "a" * 30, "ghp_" + "a1B2" * 9, "xoxb-" + "1" * 24, "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGci.eyJzdWIi.c2ln", "日本", "plain words", "password\n=\nx",
]


def brute(text, rules):
    out = []
    for place, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or ""):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((m.start(), place, m.end(), rule.kind))
    return sorted(out)


def line(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def brute_row(doc_id, text):
    every = brute(text, [r for v in secret_scan.RULES for r in v.rules])
    base = [f for f in every if f[1] < 3]
    n = Counter(f[3] for f in base)
    return (doc_id, n["assign"], n["access"], n["hex"], hashlib.sha256(line(base).encode()).hexdigest(), line(every))


def corpus():
    r = random.Random(6)
    texts = [None, "", " "] + PIECES + [r.choice([" ", "", "\n"]).join(r.choice(PIECES) for _ in range(r.randrange(1, 9))) for _ in range(150)] + ["filler " * 40000 + 'secret="s3cr3ts" ' + "0123456789abcdef" * 3000]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(500 + k, rows[30][1]) for k in range(40)] + [(None, rows[31][1]), (None, rows[31][1]), (7, rows[7][1])]
    return [(i, t, "clash", 3, 4) for i, t in rows]


def test_report_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = secret_scan.secrets(docs)
    assert got.columns == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_row(i, t) for i, t, *_ in rows)
    assert secret_scan.secrets(docs.limit(0)).count() == 0


def test_ledger_scans_only_what_is_new(spark, tmp_path, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    whole = secret_scan.scanner

    def counting(versions):
        run = whole(versions)

        def counted(batches):
            for b in batches:
                seen.add(sum(bin(x).count("1") for x in b.column("todo").to_pylist()))
                yield from run(iter([b]))

        return counted

    monkeypatch.setattr(secret_scan, "scanner", counting)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    base, other = secret_scan.RULES
    path = f"file://{tmp_path}/ledger"
    ledger = secret_scan.Ledger(spark, path)
    distinct = len({t or "" for _, t, *_ in rows})

    ledger.scan(docs.where("doc_id < 60"), (base,))
    first = len({t or "" for i, t, *_ in rows if i is not None and i < 60})
    assert seen.value == first
    paths = secret_scan.Ledger(spark, path).scan(docs, (base, other))  # old blobs get the new version only, new ones both; copies once
    assert seen.value == first + first + 2 * (distinct - first)
    before = seen.value
    ledger.scan(docs, (base, other))
    assert seen.value == before
    ledger.scan(docs, (base, secret_scan.Version("named@2", other.rules[:1])))
    assert seen.value == before + distinct
    assert Counter(map(tuple, secret_scan.report(ledger.findings(paths)).collect())) == Counter(brute_row(i, t) for i, t, *_ in rows)
    only = ledger.findings(paths, (other,)).collect()
    assert {s.kind for r in only for s in r.spans} == {"pem", "github", "slack", "jwt"}
    # a scan that failed before it marked its pairs is done again, and nothing is found twice
    ledger.found().limit(5).write.mode("append").parquet(f"{path}/found")
    assert Counter(map(tuple, secret_scan.report(ledger.findings(paths)).collect())) == Counter(brute_row(i, t) for i, t, *_ in rows)


def test_sieve_passes_its_keys_and_few_others(spark):
    own = spark.range(20000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("key"))
    s = sieve.Sieve(own.where("true"), "key")
    assert s.probed(own).where("not hit").count() == 0
    other = spark.range(20000, 60000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("key"))
    assert s.probed(other).where("hit").count() < 400
    assert sieve.Sieve(own.limit(0), "key").probed(other).where("hit").count() == 0
    small = sieve.Sieve(own, "key", most=4)  # beyond the bound all pass, none is lost
    assert small.blocks == 4 and small.probed(own).where("not hit").count() == 0


def test_dealt_join_spreads_rows_without_ids(spark):
    rows = common.cut(spark.range(6000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("key")).repartition(3), "rows")
    right = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "key string, v int")
    out = common.dealt_join(rows, right, "key", chunk=50)
    assert Counter((r.key if r.key == "hot" else "k", r.v) for r in out.collect()) == Counter({("hot", 1): 3000, ("k", 2): 1, ("k", None): 2999})
