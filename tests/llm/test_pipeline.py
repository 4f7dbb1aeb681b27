"""The pipeline over a small corpus against a version made of the plain definitions."""

import random
from collections import Counter

import corpus_pipeline
from kelvingrid.llm import packing, quality, rowfilter, toxicity
from kelvingrid.llm.common import table

from test_operators import norm, shingle_set


def corpus(tmp):
    r = random.Random(4)
    plain = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(240):
        own = [r.choice(plain) for _ in range(r.randrange(20, 60))]
        kind = k % 8
        if kind == 0:
            own = [w.upper() + "!!" for w in own]
        if kind == 1:
            own[3:3] = ["scum", "idiot"]
        rows.append((k, " ".join(own)))
        labels.append((k, int(kind != 0), int(kind == 1)))
    rows += [(300 + k, rows[2 + 8 * k][1]) for k in range(6)] + [(320 + k, rows[3 + 8 * k][1].replace(" ", "\n")) for k in range(4)]
    rows += [(340 + k, rows[4 + 8 * k][1] + " more") for k in range(6)] + [(400, None), (401, "")]
    # repeated ids: an equal row, a copy of another document, a text of its own; and rows without an id
    rows += [(2, rows[2][1]), (5, rows[4][1]), (6, " ".join(r.choice(plain) for _ in range(40))), (None, rows[7][1]), (None, " ".join(r.choice(plain) for _ in range(40)))]
    return rows, labels


def test_stages(spark, tmp_path):
    rows, labels = corpus(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    docs = table(spark, sf, "documents")
    spark_rows = docs.select("doc_id", "text").distinct()
    good = {(r.doc_id, r.text) for r in rowfilter.keep(spark_rows, lambda t, m=quality.train(docs, table(spark, sf, "labels")): m.kept(t, 1)).collect()}
    model = toxicity.train(docs, table(spark, sf, "labels"), where=toxicity.fold() != 0)
    clean = {(r.doc_id, r.text) for r in rowfilter.keep(spark_rows, lambda t: model.scores(t) < 0.5).collect()}
    order = lambda row: (row[0] is None, row[0] or 0, row[1])
    first = {}
    for row in sorted(good & clean, key=order):
        first.setdefault(norm(row[1]), row)
    left = sorted(first.values(), key=order)
    root = list(range(len(left)))
    sets = [shingle_set(t) for _, t in left]
    for a in range(len(left)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root = [root[b] if v == root[a] else v for v in root]
    left = [left[k] for k in sorted({v: k for k, v in reversed(list(enumerate(root)))}.values())]
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(left)
    kept = spark.createDataFrame(left, "doc_id long, text string")
    names = ["doc_id", "length", "bucket", "edge", "batch", "slot", "padding"]
    assert Counter(tuple(r[n] for n in names) for r in got) == Counter(map(tuple, packing.pack(kept).collect()))
    ids = [i for i, _ in left if i is not None]
    assert {2, 4, 6, 7} <= set(ids) and ids.count(6) == 2 and ids.count(2) == 1 and 5 in ids
    assert not any(i % 8 < 2 for i in ids if i < 240) and sum(i < 240 for i in ids) > 160 and sum(i is None for i, _ in left) == 1
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0
