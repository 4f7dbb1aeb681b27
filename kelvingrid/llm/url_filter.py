"""URL rules in sorted digest arrays: 64-bit xxhash keys, memory-mapped, probed by vectorised binary search.

A rule names a host and a path prefix, with ``block`` or ``allow``. Two arrays of sorted keys are written to one file: the rules' hosts, with the
path lengths that rules of each host have, and the rules (host and path), with their verdicts. The stored strings lie beside the keys, so
the file, of any size, is shipped to every executor as a Spark file and memory-mapped there; tasks carry only its name.

For a batch of urls host and path are cut out by Arrow's string kernels. The suffixes of the hosts that begin a label are hashed and searched in the first
array; for those that are found the prefixes of the path of the lengths stored with them are appended and searched in the second. A
found key is confirmed by the stored string, byte by byte; among equal keys all strings are looked at, so a collision never decides. The
longest rule wins, of equally long ones the one with the longer host; of one rule with both verdicts ``allow`` wins.

A url that is null or has no ``://`` has empty host and path and fits no rule. A url that fits no rule is
allowed: the array is a list of rules, and what isn't in it passes. Urls of any length are taken whole. Repeated urls and rows are judged one by one, null
ids stay null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from . import words
from .common import only, publish

#: The rules of the query.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
PARTS = "://(?P<host>[^/?#]*)(?P<path>[^?#]*)"
NAMES = ("host_keys", "host_ends", "host_text", "length_ends", "lengths", "rule_keys", "rule_ends", "rule_text", "allow")
TYPES = ("<u8", "<i8", "u1", "<i8", "<i8", "<u8", "<i8", "u1", "u1")


def digest(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text)


def laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Where each text ends (and 0 first), and all of them end to end."""
    return np.cumsum([0, *map(len, texts)]).astype("<i8"), np.frombuffer(b"".join(texts), np.uint8)


def build(rules: list[tuple[str, str, str]]) -> bytes:
    """The file: the sizes of the arrays named in ``NAMES``, then the arrays."""
    found: dict[tuple[bytes, bytes], bool] = {}
    for verdict, host, path in rules:
        key = host.encode(), path.encode()
        found[key] = found.get(key, False) or verdict == "allow"
    hosts: dict[bytes, set[int]] = {}
    for host, path in found:
        hosts.setdefault(host, set()).add(len(path))
    by_host = sorted(hosts, key=lambda h: (digest(h), h))
    by_rule = sorted(((h + p, a) for (h, p), a in found.items()), key=lambda r: (digest(r[0]), r[0]))
    lengths = [sorted(hosts[h]) for h in by_host]
    arrays = [
        np.array([digest(h) for h in by_host], "<u8"), *laid_out(by_host), np.cumsum([0, *map(len, lengths)]).astype("<i8"), np.array([n for own in lengths for n in own], "<i8"),
        np.array([digest(r) for r, _ in by_rule], "<u8"), *laid_out([r for r, _ in by_rule]), np.array([a for _, a in by_rule], "u1"),
    ]
    return np.array([len(a) for a in arrays], "<i8").tobytes() + b"".join(a.tobytes() for a in arrays)


def read(where) -> dict[str, np.ndarray]:
    """The arrays of a file (mapped) or of its bytes."""
    whole = np.frombuffer(where, np.uint8) if isinstance(where, bytes) else np.memmap(where, np.uint8, mode="r")
    sizes = whole[: 8 * len(NAMES)].view("<i8").tolist()
    out, at = {}, 8 * len(NAMES)
    for name, kind, n in zip(NAMES, TYPES, sizes, strict=True):
        to = at + n * np.dtype(kind).itemsize
        out[name] = np.frombuffer(whole[at:to].data, kind) if n else np.zeros(0, kind)
        at = to
    return out


@lru_cache(maxsize=8)
def mapped(name: str) -> dict[str, np.ndarray]:
    return read(SparkFiles.get(name))


def search(keys: np.ndarray, ends: np.ndarray, text: np.ndarray, wanted: list[bytes]) -> np.ndarray:
    """The place of each wanted string, -1 if it isn't stored."""
    out = np.full(len(wanted), -1)
    if not wanted or not len(keys):
        return out
    hashes = np.fromiter(map(digest, wanted), dtype=np.uint64, count=len(wanted))
    offsets, own = laid_out(wanted)
    size = np.diff(offsets)
    at = np.searchsorted(keys, hashes, "left")
    live = np.arange(len(wanted))
    while len(live):
        live = live[(at[live] < len(keys))]
        live = live[keys[at[live]] == hashes[live]]
        k = at[live]
        same = (ends[k + 1] - ends[k] == size[live])
        pair = np.flatnonzero(same)
        # only the bytes of strings with an equal key are read: the file may be much larger than what a batch asks for
        n = size[live[pair]]
        start = np.cumsum(n) - n
        stored = text[np.repeat(ends[k[pair]] - start, n) + np.arange(int(n.sum()))]
        same[pair] = words.same_bytes(stored, start, own, offsets[live[pair]], n)
        out[live[same]] = k[same]
        live = live[~same]
        at[live] += 1
    return out


def split(urls: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Host (A-Z lower-cased) and path of each url."""
    parts = pc.extract_regex(pc.fill_null(urls.cast(pa.string()), ""), PARTS)
    host, path = (pc.fill_null(pc.struct_field(parts, k), "") for k in (0, 1))
    return pc.ascii_lower(host), path


def probe(index: dict[str, np.ndarray], host: pa.Array, path: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that some rule fits, and that rule's place."""
    data, offsets = words.buffers(host)
    tail, tail_offsets = words.buffers(path)
    dots = np.flatnonzero(data == 46) + 1
    starts = np.concatenate([offsets[:-1], dots])
    row = np.concatenate([np.arange(len(host)), np.searchsorted(offsets, dots - 1, "right") - 1])
    stops = offsets[row + 1]
    fits = np.isin(stops - starts, np.unique(np.diff(index["host_ends"])))  # as long as some rule's host
    starts, stops, row = starts[fits], stops[fits], row[fits]
    raw, raw_tail = data.tobytes(), tail.tobytes()
    found = search(index["host_keys"], index["host_ends"], index["host_text"], [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
    hit = np.flatnonzero(found >= 0)
    begin, count = index["length_ends"][found[hit]], np.diff(index["length_ends"])[found[hit]]
    inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    hit, n = np.repeat(hit, count), index["lengths"][inner]
    row, a = row[hit], tail_offsets[row[hit]]
    fits = n <= tail_offsets[row + 1] - a
    hit, row, a, n = hit[fits], row[fits], a[fits], n[fits]
    wanted = [raw[s:e] + raw_tail[p : p + k] for s, e, p, k in zip(starts[hit].tolist(), stops[hit].tolist(), a.tolist(), n.tolist(), strict=True)]
    rule = search(index["rule_keys"], index["rule_ends"], index["rule_text"], wanted)
    ok = rule >= 0
    hit, row, n, rule = hit[ok], row[ok], n[ok], rule[ok]
    size = stops[hit] - starts[hit]
    order = np.lexsort((size, size + n, row))
    last = order[np.append(row[order][1:] != row[order][:-1], True)] if len(order) else order
    return row[last], rule[last]


def judged(index: dict[str, np.ndarray], urls: pa.Array) -> list[pa.Array]:
    """host, path, rule and verdict of each url."""
    host, path = split(urls)
    row, rule = probe(index, host, path)
    which, back = np.unique(rule, return_inverse=True)
    ends = index["rule_ends"]
    names = pa.array([index["rule_text"][ends[k] : ends[k + 1]].tobytes().decode() for k in which.tolist()], pa.string())
    at = np.full(len(host), -1)
    at[row] = back
    allow = np.ones(len(host), bool)
    allow[row] = index["allow"][rule] != 0
    return [host, path, names.take(pa.array(at, mask=at < 0)), pc.if_else(pa.array(allow), "allow", "block")]


def url_filter(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages(page_id, url)``."""
    data = build(rules)
    name = f"url-rules-{xxhash.xxh3_128_hexdigest(data)}.bin"
    publish(pages.sparkSession, name, data)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = mapped(name)
        for batch in batches:
            for b in words.slices(batch, "url"):
                yield pa.RecordBatch.from_arrays([b.column("page_id"), *judged(index, b.column("url"))], ["page_id", "host", "path", "rule", "verdict"])

    return only(pages, "page_id", "url").mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")


ORACLE = r"""
WITH r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
t AS (SELECT page_id, strpos(url, '://') AS pos, substr(url, strpos(url, '://') + 3) AS rest FROM pages),
u AS (SELECT page_id, CASE WHEN pos > 0 THEN translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN pos > 0 THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM t),
m AS (SELECT u.page_id, u.host, u.path, r.h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC NULLS LAST) AS k
  FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
