"""Secrets in versioned texts, by an incremental ledger of blobs.

Every version of a text is a *blob*, named by the SHA-256 of its bytes. The ledger, two Parquet tables in a folder, knows which (blob, rule version) pairs
were scanned and what was found in them; a rule version is a set of rules under one name and may never change under it.

``scan`` addresses all versions, keeps the narrow (path, blob) table, and scans the pairs that the ledger lacks, each once:

* Blobs that are known in part or that several rows hold go into a filter (``sieve``). A row that misses it holds a new blob alone and is scanned where it lies.
* Rows that pass are grouped by blob, one text each before and after the shuffle, joined with the pairs still to do, and scanned. So only
  these texts travel, and a text that a third of all rows hold travels once a task.

Findings are written before the pairs are marked as scanned: a scan that fails between is done again, and findings are read as a set.
``findings`` joins them back to all paths that hold their blob; blobs of very many paths are dealt out in parts.

Spans are of code points, the end exclusive. Null text counts as empty; null ids and repeated rows are paths like others and get rows of their own. Texts
of any length are scanned whole. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import cut, dealt_join, drop, folder, only
from .sieve import Sieve


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and without overlap, count if ``group`` has ``least`` characters; ``need`` is an RE2 pattern that each text with one matches."""

    kind: str
    pattern: str
    need: str
    group: int = 0
    least: int = 1


@dataclass(frozen=True)
class Version:
    """Some rules under a name that stands for exactly these."""

    name: str
    rules: tuple[Rule, ...]


# fixed values: the contract's rules
NAMES = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
BASE = Version(
    "base@1",
    (
        Rule("assign", NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", NAMES + r"""["']?\x20*[:=]""", 2, 6),
        Rule("access", r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", 0, 20),
        Rule("hex", r"[0-9a-f]+", r"[0-9a-f]{24}", 0, 24),
    ),
)
# fixed values: public formats of keys that name themselves
NAMED = Version(
    "named@1",
    (
        Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
        Rule("github", r"gh[pousr]_[A-Za-z0-9]+", r"gh[pousr]_[A-Za-z0-9]{36}", 0, 40),
        Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", r"xox[abprs]-[A-Za-z0-9-]{20}", 0, 25),
        Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]"),
    ),
)
RULES = (BASE, NAMED)
KINDS = tuple(r.kind for v in RULES for r in v.rules)


@cache
def compiled(rule: Rule) -> re.Pattern:
    # a run that is too short can't be the start of a longer one where the pattern is one class, so short runs needn't be visited
    return re.compile(rule.pattern[:-1] + "{%d,}" % rule.least if re.fullmatch(r"\[[^]]*\]\+", rule.pattern) else rule.pattern)


def spans(text: str, rule: Rule) -> list[tuple[int, int]]:
    return [m.span() for m in compiled(rule).finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


FOUND = "blob binary, version string, kind string, start long, stop long"


def scanner(versions: tuple[Version, ...]):
    """A task's work: rows (blob, text, todo), where bit k of ``todo`` asks for version k, to findings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.slices(batch, "text", 1 << 23):
                text, todo = b.column("text"), b.column("todo")
                out: list[tuple[bytes, str, str, int, int]] = []
                for k, version in enumerate(versions):
                    asked = pc.not_equal(pc.bit_wise_and(todo, pa.scalar(1 << k, todo.type)), pa.scalar(0, todo.type))
                    for rule in version.rules:
                        for i in pc.indices_nonzero(pc.and_(asked, pc.match_substring_regex(text, rule.need))).to_pylist():
                            blob = b.column("blob")[i].as_py()
                            out += [(blob, version.name, rule.kind, s, e) for s, e in spans(text[i].as_buffer().to_pybytes().decode("utf-8", "replace"), rule)]
                if out:
                    kinds = (pa.binary(), pa.string(), pa.string(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["blob", "version", "kind", "start", "stop"])

    return run


def address(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class Ledger:
    """What was scanned, (blob, version), and what was found, (blob, version, kind, start, stop), in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{folder(spark)}/ledger-{uuid.uuid4().hex}"

    def read(self, name: str, schema: str) -> DataFrame:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def scanned(self) -> DataFrame:
        return self.read("scanned", "blob binary, version string").distinct()

    def found(self) -> DataFrame:
        return self.read("found", FOUND).distinct()

    def pending(self, blobs: DataFrame, versions: tuple[Version, ...]) -> DataFrame:
        """(blob, n, todo): bit k of ``todo`` is set where version k was not yet run over the blob."""
        bit = F.lit(0)
        for k, v in enumerate(versions):
            bit = F.when(F.col("version") == v.name, 1 << k).otherwise(bit)
        known = self.scanned().groupBy("blob").agg(F.bit_or(bit).alias("known"))
        return blobs.join(known, "blob", "left").withColumn("todo", F.lit((1 << len(versions)) - 1).bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0))))).drop("known")

    def scan(self, docs: DataFrame, versions: tuple[Version, ...] = RULES, most: int | None = None) -> DataFrame:
        """Scan what is new in ``docs(doc_id, text)``; returns (doc_id, blob) of all rows, written down."""
        if len({v.name for v in versions}) < len(versions):
            raise ValueError("a version's name stands for one set of rules")
        every = (1 << len(versions)) - 1
        texts = only(docs, "doc_id", "text").select("doc_id", address(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        paths = cut(texts.select("doc_id", "blob"), "ledger-paths")
        todo = cut(self.pending(paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n")), versions), "ledger-pending")
        odd = (F.col("n") > 1) | (F.col("todo") != every)
        sieve = Sieve(todo.where(odd).select("blob"), "blob", **({} if most is None else {"most": most}))
        rows = sieve.probed(texts)
        alone = rows.where("not hit").select("blob", "text", F.lit(every).alias("todo"))
        shared = rows.where("hit").groupBy("blob").agg(F.any_value("text").alias("text")).join(todo.where("todo <> 0").select("blob", "todo"), "blob").select("blob", "text", "todo")
        run = words.tidy(scanner(versions))
        found = alone.mapInArrow(run, FOUND).unionByName(shared.mapInArrow(run, FOUND))
        found.write.mode("append").parquet(f"{self.path}/found")
        name = F.array_compact(F.array(*[F.when(F.col("todo").bitwiseAND(1 << k) != 0, v.name) for k, v in enumerate(versions)]))
        todo.where("todo <> 0").select("blob", F.explode(name).alias("version")).write.mode("append").parquet(f"{self.path}/scanned")
        sieve.clear()
        drop(todo)
        return paths

    def findings(self, paths: DataFrame, versions: tuple[Version, ...] = RULES) -> DataFrame:
        """(doc_id, blob, spans) of every path, its spans by start, then kind as the versions list them."""
        order = {r.kind: k for k, r in enumerate(r for v in versions for r in v.rules)}
        place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("kind")]
        own = self.found().where(F.col("version").isin([v.name for v in versions]))
        spans = F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "stop", "kind")))
        found = own.groupBy("blob").agg(spans.alias("spans"))
        empty = F.array().cast("array<struct<start:long,place:int,stop:long,kind:string>>")
        return dealt_join(paths, found, "blob").select("doc_id", "blob", F.coalesce("spans", empty).alias("spans"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(rows: DataFrame) -> DataFrame:
    """Numbers of the base kinds, the digest of their spans, and all spans, of each path."""
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    base = [r.kind for r in BASE.rules]
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return rows.select("doc_id", *counts, F.sha2(listed(of(*base)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def secrets(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``report`` of every row of ``docs``, over the ledger at ``path`` or a new one."""
    ledger = Ledger(docs.sparkSession, path)
    return report(ledger.findings(ledger.scan(docs)))


def oracle() -> str:
    """DuckDB SQL of ``report``: a match begins where its text first occurs after the match before it."""
    each = []
    for place, rule in enumerate(r for v in RULES for r in v.rules):
        quoted = compiled(rule).pattern.replace("'", "''")
        each.append(f"SELECT id, text, '{rule.kind}' AS kind, {place} AS place, {rule.least} AS least, regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {rule.group}) AS g FROM d")
    return (
        "WITH RECURSIVE d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents), m AS ("
        + " UNION ALL ".join(each)
        + """), s AS (
  SELECT id, kind, place, 0 AS k, 0::BIGINT AS start, 0::BIGINT AS stop FROM m WHERE len(m) > 0
  UNION ALL
  SELECT s.id, s.kind, s.place, s.k + 1, s.stop + instr(substr(m.text, s.stop + 1), m.m[s.k + 1]) - 1, s.stop + instr(substr(m.text, s.stop + 1), m.m[s.k + 1]) - 1 + length(m.m[s.k + 1])
  FROM s JOIN m ON s.id = m.id AND s.place = m.place WHERE s.k < len(m.m)
), f AS (SELECT s.* FROM s JOIN m ON s.id = m.id AND s.place = m.place WHERE s.k > 0 AND length(m.g[s.k]) >= m.least),
r AS (
  SELECT id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
  FROM f GROUP BY id
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN r USING (id)
"""
    )


ORACLE = oracle()
