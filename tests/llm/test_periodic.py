"""Periodic runs against all stretches looked at one by one."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from kelvingrid.llm import periodic


def brute_runs(w, least=6):
    """Every stretch in which words q apart are equal and that can't be longer, unless a smaller period holds in it."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in found.items())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_row(doc_id, text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def rows_of(texts, chunk=periodic.CHUNK):
    split = [t.split() for t in texts]
    first = np.concatenate([[0], np.cumsum([len(s) for s in split])])
    ids = {}
    word = np.array([ids.setdefault(x, len(ids)) for s in split for x in s], dtype=np.int64)
    start, end, period = periodic.runs(word, first, chunk=chunk)
    out = [[] for _ in texts]
    for a, b, q in zip(start.tolist(), end.tolist(), period.tolist(), strict=True):
        k = int(np.searchsorted(first, a, "right")) - 1
        out[k].append((a - int(first[k]), b - a, q))
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", min_size=0, max_size=40), min_size=1, max_size=4), st.sampled_from([3, periodic.CHUNK]))
def test_small_alphabets(texts, chunk):
    texts = [" ".join(t) for t in texts]
    assert rows_of(texts, chunk) == [brute_runs(t.split()) for t in texts]


def test_repeats_next_to_each_other():
    r = random.Random(3)
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(1, 6)):
            unit = [r.choice("abcdef") for _ in range(r.randrange(1, 9))]
            parts += unit * r.randrange(1, 9) + unit[: r.randrange(len(unit))] + [r.choice("xyz")] * r.randrange(0, 2)
        texts.append(" ".join(parts))
    assert rows_of(texts) == [brute_runs(t.split()) for t in texts]


def test_long_run_and_many_texts():
    texts = ["a " * 5000, "b " * 5000, "", "a b " * 2000 + "c", "only once here", "x" * 100000]
    assert rows_of(texts) == [[(0, 5000, 1)], [(0, 5000, 1)], [], [(0, 4000, 2)], [], []]


CASES = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "a b a b a b a b", "x a b\x0ba b\ta b a b y", "la " * 700 + "fin", "é è " * 9 + "é", "　 　 　 　 　 　"]


def test_detect_equals_brute_force(spark):
    r = random.Random(8)
    rows = [(k, t, 1, "clash", 2) for k, t in enumerate(CASES)]
    rows += [(100 + k, " ".join(r.choice("abcdefgh") for _ in range(r.randrange(0, 90))), 1, "clash", 2) for k in range(400)]
    rows += [(None, "a " * 9, 1, "clash", 2), (5, CASES[5], 1, "clash", 2), (5, CASES[5], 1, "clash", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, collapsed string, start long").repartition(3)
    got = periodic.audit(docs)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(brute_row(i, t) for i, t, *_ in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows) > 20
    assert periodic.audit(docs.limit(0)).count() == 0
    whole = {r.doc_id: r for r in periodic.detect(docs.where("doc_id < 12")).collect()}
    assert whole[7].collapsed == "x a b y" and [tuple(x) for x in whole[7].runs] == [(1, 8, 2)] and whole[8].n_words == 701
