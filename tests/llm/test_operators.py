"""Each operator against a brute-force version on a small fixture with nulls, empty and long texts, ties, copies and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kelvingrid.llm import common, embedding_dedup, exact_dedup, jaccard_join, labelled, packing, quality, queries, sentence_pieces, sharding, token_count, toxicity, trees, url_filter, words

WORDS = ["alpha", "Beta", "gamma,", "déjà", "vu", "x", "don't", "!!!", "Zürich", "日本", "a1b2", "end."]


def text_of(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate({97: 98, 98: 97})
    return s[:n], s[:n].translate({97: 98, 98: 97})


def fixture_rows():
    base = text_of(1, 120).split(" ")
    rows = [(0, None), (1, ""), (2, "  \n\t "), (3, "one two"), (4, "ONE  two"), (5, "one two three four"), (6, "\x00 \x0b odd\x1ccontrol \u3000wide")]
    for k in range(12):  # near copies
        own = list(base)
        for j in range(k % 4):
            own[(17 * k + 31 * j) % len(own)] = f"edit{k}{j}"
        rows.append((10 + k, " ".join(own)))
    rows += [(30 + k, text_of(100 + k, 5 + 7 * k)) for k in range(20)]
    rows += [(60 + k, text_of(7, 40)) for k in range(9)]  # exact copies
    rows += [(80, text_of(8, 6000)), (81, "w" * 40000), (82, ("long " * 30 + "tail\n") * 300), (83, "one\ttwo")]
    rows += [(60, text_of(7, 40))]  # a repeated row
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None, 1, "clash", 5) for i, t in fixture_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, c int, size string, n long").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_word_hashes_follow_the_words():
    texts = [t for _, t in fixture_rows()]
    data, starts, ends, hashes, first = words.text_words(pa.array(texts))
    seen = {}
    for t, a, b in zip(texts, first[:-1], first[1:]):
        own = (t or "").encode().lower().split()
        assert [data[s:e].tobytes() for s, e in zip(starts[a:b], ends[a:b])] == own
        for w, h in zip(own, hashes[a:b].tolist()):
            assert seen.setdefault(h, w) == w
    assert len(set(seen.values())) == len(seen)


def test_op1_counts_equal_the_library(spark, docs, empty):
    path = queries.tokenizer_path("word_bpe_49k.json")
    tok = token_count.tokenizer(path)
    want = Counter((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for i, t in fixture_rows())
    for chunk, overlap in ((token_count.CHUNK, token_count.OVERLAP), (300, 64)):
        got = token_count.token_counts(docs, path, chunk=chunk, overlap=overlap).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert token_count.token_counts(empty, path).count() == 0


CONFUSED = " ".join(thue_morse(2048))


@pytest.mark.parametrize("text", ["a" * 5000, "ab " * 999, "é<|endoftext|>x " * 500, "x<|endoftext|>" * 400, "don't " * 900, "'s's'tx'll" * 300, "x" * 700 + " y" * 900, "Σ ΑΣ " * 300, " " * 3000 + "q", "…\u0301 e\u0301 " * 400, "日本語、文章。" * 400, "漢字" * 900 + "，" + "e\u0301.e\u0301-" * 300, "1!2a'3" * 500, "İ!İ." * 300, CONFUSED])
@pytest.mark.parametrize("overlap", [1, 64])
def test_op1_splices_at_stable_boundaries(text, overlap):
    tok = token_count.tokenizer(queries.tokenizer_path("word_bpe_49k.json"))
    want = tok.encode(text, add_special_tokens=False).ids
    got = [i for p, a, b in next(token_count.encoded(tok, [text], 200, overlap)) for i in p.encoding.ids[a:b]]
    assert got == want


def test_op1_cuts_long_texts_without_blanks():
    tok = token_count.tokenizer(queries.tokenizer_path("word_bpe_49k.json"))
    text = "日本語、文章。" * 30000
    parts = next(token_count.encoded(tok, [text]))
    assert max(p.end - p.start for p, _, _ in parts) <= token_count.CHUNK
    assert sum(b - a for _, a, b in parts) == len(tok.encode(text, add_special_tokens=False))


def test_op1_refuses_a_tokenizer_without_the_proof():
    with pytest.raises(ValueError):
        token_count.tokenizer(queries.tokenizer_path("byte_bpe_50k.json"))


def brute_links(rows, cosine):
    ok = []
    for i, v, label in rows:
        x = np.array([np.nan if c is None else c for c in (v or [])], dtype=np.float64)
        ok.append(label is not None and len(x) > 0 and np.isfinite(x).all() and x.any())
    n, root = [0] * len(rows), list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], dtype=np.float64), np.array(rows[b][1], dtype=np.float64)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                    n[a] += 1
                    n[b] += 1
                    old, new = root[a], root[b]
                    root = [new if r == old else r for r in root]
    low = {}
    for r, row in zip(root, rows):
        if row[0] is not None:
            low[r] = min(low.get(r, row[0]), row[0])
    return Counter((row[0], k, low.get(r)) for row, k, r in zip(rows, n, root))


@pytest.mark.parametrize(("tile", "whole"), [(2048, 1 << 15), (7, 1 << 15), (2048, 4), (7, 60)])
def test_op2_links_equal_brute_force(spark, tile, whole):
    r = np.random.default_rng(3)
    rows = []
    for k in range(40):
        v = r.normal(size=16).astype(np.float32)
        for j in range(k % 4 + 1):
            rows.append((len(rows) * 3, (v + r.normal(size=16) * 0.04 * j).astype(np.float32).tolist(), k % 3 if k else None))
    hub = r.normal(size=16).astype(np.float32)
    rows += [(1000 + k, (hub * (k % 5 + 1)).tolist(), 1) for k in range(25)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, [], 1), (2005, [1.0, 2.0], 1), (2006, [2.0, 4.0], 1), (2007, [float("inf")] * 16, 1)]
    rows += [(1003, (hub * 2).tolist(), 1), (1003, r.normal(size=16).astype(np.float32).tolist(), 1), (None, hub.tolist(), 1), (None, r.normal(size=16).astype(np.float32).tolist(), 2)]  # repeated and null ids
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("key", F.lit("clash")).repartition(3)
    got = embedding_dedup.near_duplicates(df, tile=tile, whole=whole).collect()
    assert Counter((x.vec_id, x.n_links, x.component_id) for x in got) == brute_links(rows, 0.98)
    assert all(x.kept == (x.vec_id == x.component_id) for x in got)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_op2_compares_few_pairs_and_loses_none():
    r = np.random.default_rng(1)
    x = embedding_dedup.normalised(np.concatenate([r.normal(size=(600, 64)), np.repeat(r.normal(size=(20, 64)), 6, axis=0) + r.normal(size=(120, 64)) * 0.08]))
    y = x @ embedding_dedup.rotation(64, 7)
    met = set()
    for (lo, hi), share in zip(embedding_dedup.bounds(64, 8), embedding_dedup.shares(64, 0.04, 8)):
        for a, b in embedding_dedup.meetings(y[:, lo:hi], y[:, lo:hi], share):
            met |= set(zip(a.tolist(), b.tolist()))
    linked = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.98))}
    assert linked <= met and len(linked) > 720 and len(met) < 0.08 * len(x) ** 2


@pytest.mark.parametrize("n", [64, 1024, 2048, 4096])
def test_words_that_a_polynomial_confuses_stay_apart(n):
    for lane in (0, 1):
        data, offsets = words.buffers(pa.array(list(thue_morse(n))))
        assert len(set(words.word_hashes(data, *words.spans(data, offsets), lane).tolist())) == 2


def test_op3_round_trip_and_library_ids(spark, docs, empty):
    from sentencepiece import SentencePieceProcessor

    path = queries.tokenizer_path("piece_bpe_32k.model")
    p = SentencePieceProcessor(model_file=path)
    extra = [(500, "a▁ b"), (501, "  x   y" * 60), (502, "=" * 700), (503, "😀 é\u0301 \ufb01"), (504, " lead"), (505, "trail  ")]
    rows = spark.createDataFrame(extra, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = sentence_pieces.pieces(rows, path).collect()
    want = defaultdict(list)
    for i, t in [*extra, *fixture_rows()]:
        want[i].append(p.encode(t or ""))
    assert all(r.ids in want[r.doc_id] and r.n_pieces == len(r.ids) and r.round_trip for r in got) and len(got) == len(extra) + len(fixture_rows())
    assert sentence_pieces.pieces(empty, path).count() == 0


def library(texts):
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    return [p.encode(t) for t in texts]


def ids_of(enc, texts):
    ids, cuts = enc.encode(pa.array(texts))
    return [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:])]


def test_op3_units_with_one_hash_keep_their_own_ids(monkeypatch):
    texts = [*thue_morse(1024), *thue_morse(2048), *thue_morse(4096)]
    enc = sentence_pieces.Encoder(queries.tokenizer_path("piece_bpe_32k.model"))
    assert [i for t in texts for i in ids_of(enc, [t])] == ids_of(enc, texts) == library(texts)
    monkeypatch.setattr(words, "word_hashes", lambda data, starts, ends, lane=0: (ends - starts).astype(np.uint64))  # every length one hash
    weak = sentence_pieces.Encoder(queries.tokenizer_path("piece_bpe_32k.model"))
    some = ["one two six", "ten cat dog sun", "two one", "", "sun fun run"]
    assert ids_of(weak, some) == library(some)
    assert ids_of(weak, some[::-1]) == library(some[::-1])


def test_op3_long_texts_without_blanks():
    r = random.Random(1)
    texts = ["".join(r.choice("日本語漢字文章国際会議、。ab") for _ in range(40000)), "=" * 3000, "x" * 900 + "日" * 900, "".join(r.choice("abcdefgh") for _ in range(6000)) + "😀" * 400]
    vocab = sentence_pieces.vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))
    for t, want in zip(texts, library(texts)):
        unit = np.frombuffer((" " + t).encode(), np.uint8)
        for part in (512, 1 << 18):
            assert sentence_pieces.encode_all(vocab, unit, np.array([0]), np.array([len(unit)]), part)[0].tolist() == want


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("weak", [False, True])
def test_op4_groups_equal_brute_force(docs, empty, weak):
    options = {"digest": lambda t: F.unhex(F.substring(F.sha2(t.cast("binary"), 256), 1, 2))} if weak else {}  # one byte: many collisions
    rows = fixture_rows()
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    got = exact_dedup.exact_dedup(docs, chunk=3, fan_in=2, **options).collect()
    want = Counter((i, min(groups[norm(t)]), len(groups[norm(t)]), i == min(groups[norm(t)])) for i, t in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == want
    if not weak:
        assert {(r.doc_id, r.text_sha256) for r in got} == {(i, hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows}
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_op4_collisions_of_repeated_rows(spark):
    one = {"digest": lambda t: F.lit(b"x")}
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y"), (3, "x"), (None, "y"), (None, "z")], "doc_id long, text string")
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(rows, **one).collect())
    assert got == Counter([(1, 1, 2, True), (3, 1, 2, False), (2, 2, 3, True), (2, 2, 3, True), (None, 2, 3, False), (None, None, 1, True)])
    for options in ({}, one):
        assert sorted((r.text, r.doc_id) for r in exact_dedup.distinct_rows(rows, **options).collect()) == [("x", 1), ("y", 2), ("z", None)]


def test_op4_filter_passes_all_copies(docs):
    index = exact_dedup.MergeIndex(docs, bits=64)  # one block
    many = {bytes(r.digest) for r in index.level.where("n > 1").collect()}
    assert many and many <= {bytes(r.digest) for r in index.probed(index.runs).where("hit").collect()}
    wide = exact_dedup.MergeIndex(docs)
    assert {bytes(r.digest) for r in wide.probed(wide.runs).where("hit").collect()} == many


def test_op4_index_lookup(docs):
    index = exact_dedup.MergeIndex(docs)
    row = index.lookup([hashlib.sha256(norm(text_of(7, 40)).encode()).digest()]).first()
    assert (row.keep_id, row.n) == (60, 10)


def test_op5_ordinal_grades(spark, empty):
    r = random.Random(5)
    grade = {0: "junk spam", 1: "weak thin", 2: "fair plain", 3: "rich deep"}
    rows = []
    for k in range(400):
        g = k % 4
        own = [r.choice(WORDS) for _ in range(20)] + [r.choice(grade[max(0, min(3, g + r.choice([0, 0, 0, 1, -1])))].split()) for _ in range(6)]
        rows.append((k, " ".join(own), g))
    labels = spark.createDataFrame([(k, g) for k, _, g in rows if k % 5], "doc_id long, grade int")
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    model = quality.train(docs, labels, "grade")
    assert list(model.thresholds) == sorted(model.thresholds) and model.grades == [0, 1, 2, 3]
    got = {x.doc_id: x for x in quality.score(docs, model, cut=2).collect()}
    held = [(got[k].expected_grade, g, got[k].kept) for k, _, g in rows if k % 5 == 0]
    assert np.corrcoef([h[0] for h in held], [h[1] for h in held])[0, 1] > 0.85
    assert np.mean([h[2] == (h[1] >= 2) for h in held]) > 0.85
    assert not got[900].kept and not got[901].kept
    assert quality.score(empty, model).count() == 0
    none = quality.train(docs, labels.limit(0), "grade")
    assert all(x.kept == (x.doc_id < 900) for x in quality.score(docs, none).collect())


def test_op5_without_words_or_within_bytes(spark):
    docs = spark.createDataFrame([(1, None), (2, " "), (3, ""), (4, "a b c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert [r.kept for r in quality.score(docs, model).orderBy("doc_id").collect()] == [False, False, False, True]
    more = spark.createDataFrame([(k, "word " * 100) for k in range(50)], "doc_id long, text string")
    own = spark.createDataFrame([(k, k % 2) for k in range(50)], "doc_id long, quality int")
    assert labelled.sample(more, own, "quality", 40).count() == 40
    assert labelled.sample(more, own, "quality", 40, most_bytes=5000).count() == 10
    # the first by hash is too long for any budget: the others stay, and no single text takes all
    first = min(range(50), key=lambda k: spark.range(1).select(F.xxhash64(F.lit(11), F.lit(k).cast("long"))).first()[0])
    long = spark.createDataFrame([(k, "w" * 7000 if k == first else "word " * 20) for k in range(50)], "doc_id long, text string")
    kept = labelled.sample(long, own, "quality", 40, most_bytes=5000).collect()
    assert len(kept) == 39 and first not in {r.doc_id for r in kept}
    # repeated ids count once, by their smallest text
    twice = more.unionByName(spark.createDataFrame([(3, "b"), (3, "a"), (3, "a")], "doc_id long, text string"))
    assert [r.text for r in labelled.sample(twice, own, "quality", 50).collect() if r.doc_id == 3] == ["a"]


def test_op5_likelihood_and_thresholds_recomputed():
    """At the fit the likelihood, written out from the definition, is higher than anywhere near it along each threshold and many weights."""
    r = np.random.default_rng(3)
    rows = []
    for _ in range(300):
        i = np.sort(r.choice(12, 4, replace=False)).astype("<i4")
        v = r.random(4).astype("<f4")
        score = sum((x - 5.5) * y for x, y in zip(i.tolist(), v.tolist()))
        rows.append((i, v, int(np.searchsorted([-2.0, 2.0], score + r.normal()))))
    model = quality.fit(rows, rounds=600, rate=0.1)

    def likelihood(w, theta):
        total = 0.0
        for i, v, g in rows:
            s = float((w[i] * v).sum())
            tail = [1.0] + [1 / (1 + np.exp(t - s)) for t in theta] + [0.0]
            total += np.log(max(tail[g] - tail[g + 1], 1e-12))
        return total / len(rows) - 0.5e-6 * float((w**2).sum())

    best = likelihood(model.weights, model.thresholds)
    for k in range(2):
        for step in (-0.3, 0.3):
            theta = model.thresholds.copy()
            theta[k] += step
            assert likelihood(model.weights, theta) < best + 1e-4
    for k in range(12):
        for step in (-1.5, 1.5):
            w = model.weights.copy()
            w[k] += step
            assert likelihood(w, model.thresholds) < best + 1e-4
    assert model.thresholds[0] < model.thresholds[1]


def test_op9_isotonic_recomputed():
    """The calibration is the least-squares non-decreasing fit: no better one among the min-max means of all blocks."""
    r = np.random.default_rng(5)
    x = np.sort(r.normal(size=60))
    y = (r.random(60) < 1 / (1 + np.exp(-2 * x))).astype(float)
    best = [max(min(y[a : b + 1].mean() for b in range(k, 60)) for a in range(k + 1)) for k in range(60)]
    pools = [[k for k in range(60) if np.isclose(best[k], v)] for v in sorted({round(v, 9) for v in best})]
    curve = trees.isotonic(x, y)
    assert np.allclose(curve.at, [(x[p[0]] + x[p[-1]]) / 2 for p in pools])
    # each pool's mean, drawn to 1/2 by one row
    assert np.allclose(curve.value, np.maximum.accumulate([(y[p].sum() + 0.5) / (len(p) + 1) for p in pools]))


def test_op6_rows_law_and_mixture(docs, empty):
    got = sharding.interleave(docs, shards=4).collect()
    rows = fixture_rows()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    counts = [len(v) for v in shards.values()]
    assert len(shards) == 4 and max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in shards.values())
    source = {i: (f"s{i % 3}" if i % 7 else None) for i, _ in rows}
    per = Counter((source[r.doc_id], r.shard) for r in got)
    for s in set(source.values()):
        own = [per[(s, k)] for k in range(4)]
        assert max(own) - min(own) <= 2
    assert [tuple(r) for r in sharding.interleave(docs.repartition(5), shards=4).orderBy("shard", "slot").collect()] == sorted((tuple(r) for r in got), key=lambda r: (r[4], r[5]))
    assert sharding.interleave(empty).count() == 0


def test_op6_places_equal_brute_force(spark, docs):
    rows = [(i, t, f"s{i % 3}" if i % 7 else None) for i, t in fixture_rows()] + [(None, "x", "s1"), (None, None, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    md5 = lambda *x: hashlib.md5("|".join(["0", *x]).encode()).hexdigest()
    facts = []
    for i, t, s in rows:
        crc, size = zlib.crc32((t or "").encode()), len((t or "").encode()) + 1
        facts.append((md5("null" if i is None else str(i), str(crc)), -1 if i is None else i, crc, size, s))
    of = Counter(f[4] for f in facts)
    placed, seen = [], Counter()
    for f in sorted(facts, key=lambda f: f[:4]):
        offset = int(md5("" if f[4] is None else "s" + f[4])[:8], 16) / 2**32
        placed.append(((seen[f[4]] + offset) / of[f[4]], *f[:4]))
        seen[f[4]] += 1
    placed.sort()
    n, want = len(placed), []
    for at, (_, _, i, crc, size) in enumerate(placed):
        shard = at * 5 // n
        want.append((None if i < 0 else i, size, crc, shard, at - -(-shard * n // 5)))
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.interleave(df, shards=5).collect()) == Counter(want)


def judged(url, rules=url_filter.RULES):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len((h + p).encode()), len(h.encode()), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *max(fits)[2:]) if fits else (host, path, None, "allow")


URLS = [None, "", "nourl", "http://A.Example.COM/en/7x", "https://x.com/en/1?q", "http://com/en/", "http://xcom/en/", "ftp://a.example.net/de/88#z", "http://example.net/de/7", "http://b.org/es/#/x", "http://org?/es/", "://", "http://h/a://b.com/en/", "http://éA.com/en/", "http://.com/en/", "http://a..com./en/", "http://x.com/en/\nq", "http://x.com/en/" + "y" * 300000]


def test_op7_verdicts(spark):
    df = spark.createDataFrame([*enumerate(URLS), (3, URLS[3]), (None, URLS[4])], "page_id long, url string").withColumn("host", F.lit(1)).withColumn("rule", F.lit("clash"))
    want = Counter((k, *judged(u)) for k, u in [*enumerate(URLS), (3, URLS[3]), (None, URLS[4])])
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(df).collect()) == want
    assert url_filter.url_filter(df.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.url_filter(df, []).collect()} == {"allow"}


def test_op7_many_rules_equal_brute_force():
    r = random.Random(6)
    labels = ["a", "bc", "d", "é", "com"]
    host = lambda n: ".".join(r.choice(labels) for _ in range(n))
    path = lambda n: "".join(r.choice(["/", "x", "/é", "y"]) for _ in range(n))
    rules = list({(h, p): (r.choice(["block", "allow"]), h, p) for h, p in ((host(r.randrange(1, 4)), path(r.randrange(0, 4))) for _ in range(400))}.values())
    urls = [f"http://{host(r.randrange(1, 5))}/{path(r.randrange(0, 6))}" for _ in range(2000)]
    index = url_filter.read(url_filter.build(rules))
    got = list(zip(*[c.to_pylist() for c in url_filter.judged(index, pa.array(urls))]))
    want = [judged(u, rules) for u in urls]
    # rules of equal length and host length are the same rule
    assert got == want and sum(w[2] is not None for w in want) > 500


def test_op7_collisions_are_confirmed_by_the_string(monkeypatch):
    monkeypatch.setattr(url_filter, "digest", lambda text: 7)  # every key collides
    index = url_filter.read(url_filter.build(url_filter.RULES))
    urls = [u for u in URLS if u]
    assert list(zip(*[c.to_pylist() for c in url_filter.judged(index, pa.array(urls))])) == [judged(u) for u in urls]


def shingle_set(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    w = re.findall(r"[^\x20\x09-\x0D]+", w)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    low = {}
    for r, (i, _) in zip(root, sets):
        if i is not None:
            low[r] = min(low.get(r, i), i)
    return Counter((i, len(s), low.get(r)) for r, (i, s) in zip(root, sets))


def collected(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


@pytest.mark.parametrize(("tile", "segment", "options"), [(1024, 1 << 19, {}), (3, 1 << 19, {"hot_least": 5}), (2, 40, {"hot_least": 8, "entries": 300}), (1024, 1 << 19, {"hot_least": 4, "entries": 1000})])
def test_op8_components_equal_brute_force(docs, empty, monkeypatch, tile, segment, options):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "SEGMENT", segment)
    assert collected(jaccard_join.jaccard_components(docs, **options)) == brute_components(fixture_rows())
    assert jaccard_join.jaccard_components(empty, **options).count() == 0


def test_op8_sizes_at_the_threshold_and_one_common_passage(spark):
    r = random.Random(8)
    own = lambda n: [f"w{r.randrange(10**6)}" for _ in range(n)]
    base, passage = own(129), own(60)
    rows = [(k, " ".join(base[: 104 + k])) for k in range(26)]  # sets of 100 to 125: the first and the last link by a hair
    rows += [(100 + k, " ".join(own(4) + passage + own(k % 3))) for k in range(40)]  # mostly one passage
    rows += [(200 + k, " ".join(own(60) + passage)) for k in range(30)]  # half a passage
    rows += [(300, " ".join([*"abcd", thue_morse(1024)[0]])), (301, " ".join([*"abcd", thue_morse(1024)[1]]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute_components(rows)
    assert (300, 1, 300) in want and (301, 1, 301) in want and sum(n for (_, _, c), n in want.items() if c == 0) == 26
    for least in (4, 1000):
        assert collected(jaccard_join.jaccard_components(df, hot_least=least)) == want


def test_op8_first_rows_go_by_row_not_by_id(spark):
    text = text_of(3, 60)
    rows = [(1, text), (2, text + " more"), (2, text_of(4, 60)), (3, None), (None, text + " and more"), (None, text_of(5, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(str, (tuple(r) for r in jaccard_join.first_rows(df).collect()))) == sorted(map(str, [rows[0], rows[2], rows[3], rows[5]]))


def test_components_over_several_tasks(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 460)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {x: x for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert common.components(df.limit(0)).count() == 0
    for most in (1 << 20, 40):
        assert {x.id: x.comp for x in common.components(df, most=most).collect()} == {k: v for k, v in root.items() if k in linked}


def test_op9_held_out_accuracy(spark, empty):
    r = random.Random(9)
    rows = []
    for k in range(600):
        bad = k % 6 == 0
        own = [r.choice(WORDS) + str(r.randrange(30)) for _ in range(r.randrange(5, 60))]
        for _ in range(bad * r.randrange(1, 4)):
            own.insert(r.randrange(len(own)), r.choice(["idiot", "grobian" + r.choice("abcdef"), "Scum!"]))
        rows.append((k, " ".join(own), int(bad)))
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, where=toxicity.fold() != 0)
    got = {x.doc_id: x for x in toxicity.score(docs, model).collect()}
    held = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([got[k].predicted == rows[k][2] for k in held]) > 0.95
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values()) and got[900].score == got[901].score
    assert toxicity.score(empty, model).count() == 0
    assert all(x.predicted == 0 for x in toxicity.score(docs, toxicity.train(docs, labels.limit(0))).collect())


def test_isotonic_rises_and_trees_learn():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    m = trees.boost(x[:1500], y[:1500])
    assert ((m.raw(x[1500:]) > 0) == (y[1500:] > 0)).mean() > 0.9
    c = trees.isotonic(m.raw(x), y)
    assert (np.diff(c(np.linspace(-5, 5, 100))) >= 0).all()


def test_op10_boundaries_are_optimal():
    from itertools import combinations

    r = np.random.default_rng(4)
    for n in (1, 2, 3, 6, 9):
        for _ in range(8):
            lengths = np.sort(r.choice(200, n, replace=False))
            rows = r.integers(1, 20, n)

            def padding(cuts):
                return sum(m * (min(c for c in cuts if c >= e) - e) for e, m in zip(lengths.tolist(), rows.tolist()))

            for k in (1, 2, 3, 6):
                best = min(padding((*c, int(lengths[-1]))) for j in range(min(k, n)) for c in combinations(lengths[:-1].tolist(), j))
                got = packing.boundaries(lengths, rows, k)
                assert padding(got) == best and len(got) <= k and got[-1] == lengths[-1]
    assert packing.boundaries(lengths[:0], rows[:0], 4) == []
    many = np.sort(r.choice(100000, 3000, replace=False))
    count = r.integers(1, 9, 3000)
    slow, best = np.concatenate([[0.0], np.full(3000, np.inf)]), None
    upto = np.concatenate([[0], np.cumsum(count)]).astype(float)
    for _ in range(5):
        slow = np.array([0.0, *[np.min(slow[:j] + many[j - 1] * (upto[j] - upto[:j])) for j in range(1, 3001)]])
    cuts = np.array(packing.boundaries(many, count, 5))
    assert (cuts[np.searchsorted(cuts, many)] * count).sum() == slow[-1]


def test_op10_takes_the_counts_of_a_tokenizer(docs):
    path = queries.tokenizer_path("word_bpe_49k.json")
    counted = docs.dropDuplicates(["doc_id"]).join(token_count.token_counts(docs.dropDuplicates(["doc_id"]), path), "doc_id").select("doc_id", "text", "n_tokens")
    want = {r.doc_id: r.n_tokens for r in counted.collect()}
    got = packing.pack(counted, buckets=4, budget=2048, length=F.col("n_tokens")).collect()
    assert {r.doc_id: r.length for r in got} == want
    per = Counter((r.bucket, r.batch, r.edge) for r in got)
    assert all(n == 1 or n * edge <= 2048 for (_, _, edge), n in per.items()) and {r.edge for r in got} <= set(want.values())


def test_op10_batches_hold_all_rows_in_budget(docs, empty):
    got = packing.pack(docs, buckets=4, budget=6000).collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter((i, len((t or "").encode())) for i, t in fixture_rows())
    batches, lengths = defaultdict(list), {r.length for r in got}
    for r in got:
        assert 0 <= r.length <= r.edge and r.padding == r.edge - r.length
        batches[(r.bucket, r.batch)].append(r)
    for own in batches.values():
        assert sorted(r.slot for r in own) == list(range(len(own))) and (len(own) == 1 or len(own) * own[0].edge <= 6000) and own[0].edge in lengths
    for k in {b for b, _ in batches}:
        sizes = [len(batches[(k, j)]) for j in range(sum(b == k for b, _ in batches))]
        assert len(set(sizes[:-1])) <= 1
    assert packing.pack(empty).count() == 0


def test_null_ids_and_texts_do_not_crash(spark):
    df = spark.createDataFrame([(None, "one two three four five six"), (None, None), (1, "one two three four five six")], "doc_id long, text string").withColumn("source", F.lit(None).cast("string"))
    assert exact_dedup.exact_dedup(df).count() == 3
    assert jaccard_join.jaccard_components(df).where("component_id = 1").count() == 2
    assert sharding.interleave(df).count() == packing.pack(df).count() == 3


def test_op4_hot_copies_without_ids_are_dealt_out(spark):
    rows = [(k if k % 2 else None, "hot") for k in range(6000)] + [(10000 + k, f"t{k}") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    index = exact_dedup.MergeIndex(docs, chunk=100)
    parts = Counter(r.part for r in index.verified(index.texts().select("doc_id", "digest", "text")).where("text = 'hot'").select("part").collect())
    assert len(parts) == 60 and max(parts.values()) < 2 * 100
    got = exact_dedup.exact_dedup(docs, chunk=100).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.text_sha256 == hashlib.sha256(b"hot").hexdigest()} == {(1, 6000)}


def test_op4_filter_grows_with_what_repeats(spark):
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 6000, F.col("id") % 3000).otherwise(F.col("id")).cast("string").alias("text"))
    index = exact_dedup.MergeIndex(rows)
    hit = index.probed(index.runs).where("hit").count()
    assert 6000 <= hit < 6000 + 30  # under 1 % of the 3,000 others


def test_op8_reports_hot_shingles_of_long_texts():
    r = np.random.default_rng(2)
    frequent = jaccard_join.Frequent()
    hot = np.uint64(77)
    for batch in range(5):
        sets = [np.unique(r.integers(1 << 20, 1 << 63, 5000).astype(np.uint64)) for _ in range(200)]
        for k in (0, 1):
            sets[k] = np.unique(np.append(sets[k], hot))
        frequent.add(sets)
    keys, counts = frequent.report()
    assert hot in keys.tolist() and 4 <= counts[keys.tolist().index(77)] <= 10 and len(frequent.keys) <= frequent.most
    small = jaccard_join.Frequent(most=8)
    for _ in range(20):
        small.add([np.array([1, 2, 100 + _], np.uint64), np.array([1, 200 + _], np.uint64)])
    assert dict(zip(*(x.tolist() for x in small.report()), strict=True)).get(1, 0) >= 40 - small.short


def test_op10_carries_columns_of_clashing_names(spark, tmp_path):
    df = spark.createDataFrame([(1, "abc", 9, 8, 7, "x"), (2, None, 1, 2, 3, "y")], "doc_id long, text string, length int, Bucket int, doc_length int, `a b` string")
    out = packing.pack(df, carry=("text", "length", "Bucket", "doc_length", "a b"))
    out.write.parquet(f"{tmp_path}/out")
    assert out.columns == [*packing.OWN, "text", "doc_doc_length", "doc_Bucket", "doc_length", "a b"]
    assert {(r.doc_id, r.length, r.doc_doc_length, r.doc_length) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(1, 3, 9, 7), (2, 0, 1, 3)}


def test_op7_reads_only_the_strings_of_equal_keys():
    rules = [("block", f"h{k}.example", f"/p{k}/") for k in range(20000)]
    index = url_filter.read(url_filter.build(rules))
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, at):
            out = np.asarray(super().__getitem__(at))
            read.append(out.size)
            return out

    for name in ("host_text", "rule_text"):
        index[name] = index[name].view(Watched)
    urls = pa.array([f"http://h{k}.example/p{k}/x" for k in (0, 7, 19999)] + ["http://none.example/p1/"])
    host, path, rule, verdict = (c.to_pylist() for c in url_filter.judged(index, urls))
    assert rule == ["h0.example/p0/", "h7.example/p7/", "h19999.example/p19999/", None] and verdict == ["block"] * 3 + ["allow"]
    assert 0 < sum(read) < 1000


def test_op1_and_op3_refuse_what_they_do_not_know(tmp_path, monkeypatch):
    import json

    known = json.load(open(queries.tokenizer_path("word_bpe_49k.json")))
    for change in (lambda k: k["normalizer"]["normalizers"][1].update(content="_"), lambda k: k["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated")):
        other = json.loads(json.dumps(known))
        change(other)
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.json"
        path.write_text(json.dumps(other))
        with pytest.raises(ValueError, match="splice"):
            token_count.tokenizer(str(path))
    import sentencepiece

    whole = sentencepiece.SentencePieceProcessor.get_score
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "get_score", lambda self, i: whole(self, i) - 0.25)
    with pytest.raises(ValueError, match="ranks"):
        sentence_pieces.Vocabulary(queries.tokenizer_path("piece_bpe_32k.model"))
