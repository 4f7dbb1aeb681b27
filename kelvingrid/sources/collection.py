"""One FeatureCollection read by many tasks: its bytes are split by Spark, its features found by a structural pass over each part.

Spark's text reader cuts the file at closing braces, so it can be read in blocks anywhere; a closing brace never stands inside a character or behind an open escape.

1. *State.* Quotes outnumber escapes whatever came before, so a block tells without knowing its surroundings whether it ends in the other state (inside a string or not)
   than it began, and for both cases by how much it changes the depth. A prefix over the blocks, a few numbers each, gives every block its true beginning.
2. *Features.* Each block is read again. Objects that open at depth 2 are features, or parts of one if it goes on in the next block. Parts are put together by
   the block in which their feature begins; whole features never move.
3. *Root.* What is left when all that the root's arrays and objects hold is taken out is a small JSON text, its *skeleton*. Each block gives its part, and how features and commas take turns; put
   together, they are parsed as they stand, and tell under which key of the root an array lies.

Errors (``CollectionError``): a root that is no single JSON object, or has anything behind it; a root key twice; no ``type`` FeatureCollection; no ``features`` array; something else than objects in
it, or commas in other places than between them. A feature that is no JSON, or names a key twice at any level, is a row with a ``fault``. Other root keys are skipped, with all
that they hold. A task holds a batch of its block and the feature that it is at.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kelvingrid.plans.shared import materialise

#: The most blocks of one file; a few numbers of each are put in order by the driver.
BLOCKS = 1 << 20
QUOTE, SLASH = 34, 92
OPEN, CLOSE = (123, 91), (125, 93)
BLANK = b" \t\r\n"


class CollectionError(ValueError):
    """The file is no FeatureCollection."""


def quotes(data: np.ndarray) -> np.ndarray:
    """Places of quotes that no backslash escapes."""
    at = np.flatnonzero(data == QUOTE)
    held = at[(at > 0) & (data[np.maximum(at - 1, 0)] == SLASH)]
    escaped = set()
    for p in held.tolist():
        k = p - 1
        while k >= 0 and data[k] == SLASH:
            k -= 1
        if (p - 1 - k) % 2:
            escaped.add(p)
    return at if not escaped else at[~np.isin(at, np.fromiter(escaped, np.int64))]


def marks(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(quotes, places of brackets outside strings, +1 or -1 for each, whether the data end inside a string)."""
    q = quotes(data)
    brackets = np.flatnonzero(np.isin(data, (*OPEN, *CLOSE)))
    out = (np.searchsorted(q, brackets) + inside) % 2 == 0
    brackets = brackets[out]
    step = np.where(np.isin(data[brackets], OPEN), 1, -1)
    return q, brackets, step, bool((len(q) + inside) % 2)


def joined(texts: pa.Array) -> np.ndarray:
    """Pieces as the bytes that they were, a brace behind each."""
    return np.frombuffer(b"}".join([*[t.as_buffer().to_pybytes() for t in texts], b""]), np.uint8)


def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    for b in batches:
        block = b.column("block").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(block) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            yield int(block[lo]), joined(b.column("value").slice(lo, hi - lo))


STATE = "block long, parity int, out int, within int, bytes long"


def states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, parity, out, within, bytes): the change of the string state, and of the depth if the block begins outside or inside a string."""
    rows: dict[int, list[int]] = {}
    for block, data in by_block(batches):
        r = rows.setdefault(block, [0, 0, 0, 0])
        for k in (0, 1):
            _, _, step, after = marks(data, bool((r[0] + k) % 2))
            r[1 + k] += int(step.sum())
        r[0] = int(after) ^ 1  # the second pass began with the other state
        r[3] += len(data)
    yield pa.RecordBatch.from_arrays([pa.array([k for k in rows], pa.int64()), *[pa.array([r[i] for r in rows.values()], pa.int64() if i == 3 else pa.int32()) for i in range(4)]], ["block", "parity", "out", "within", "bytes"])


class Repeated(ValueError):
    pass


def unique(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise Repeated
    return out


def fault(text: bytes) -> str | None:
    """``keys`` if an object names a key twice, ``json`` if the text is no JSON object."""
    try:
        return None if isinstance(json.loads(text, object_pairs_hook=unique), dict) else "json"
    except Repeated:
        return "keys"
    except ValueError:
        return "json"


PART = "block long, at long, kind string, opening int, text binary, fault string"


class Reader:
    """The features of one block, their parts, and its note: skeleton and turns. ``opening`` counts the arrays and objects that the root opens in the block; 0 was open before."""

    def __init__(self, block: int, inside: bool, depth: int):
        self.block, self.inside, self.depth = block, inside, depth
        self.opening, self.at, self.begun = 0, 0, False
        self.held, self.skeleton = bytearray(), bytearray()
        self.turns: dict[int, list] = {}
        self.rows: list[tuple] = []

    def put(self, kind: str, text: bytes, wrong: str | None = None) -> None:
        self.rows.append((self.block, self.at, kind, self.opening, text, wrong))
        self.at += 1

    def turn(self, what: str) -> None:
        """Notes a feature (F), a comma, or anything else (x) between features: the first, the last, and whether no two neighbours are alike."""
        t = self.turns.setdefault(self.opening, [what, True, what, False])
        t[1] &= what != "x" and (not t[3] or t[2] != what)
        t[2:] = [what, True]

    def between(self, text: bytes) -> None:
        if bare := text.translate(None, BLANK):
            self.turn("," if bare == b"," else "x")

    def feed(self, data: np.ndarray) -> None:
        raw = data.tobytes()
        _, at, step, self.inside = marks(data, self.inside)
        deep = self.depth + np.cumsum(step)
        near = np.minimum(deep, deep - step) <= 2
        pos = 0
        for p, s, after in zip(at[near].tolist(), step[near].tolist(), deep[near].tolist(), strict=True):
            self.depth = after - s
            if self.depth <= 1:
                self.skeleton += raw[pos : p + 1]
                self.opening += self.depth == 1 and s > 0
            elif self.depth == 2:
                self.between(raw[pos:p])
                if s < 0:
                    self.skeleton += raw[p : p + 1]
                else:
                    self.turn("F" if raw[p] == OPEN[0] else "x")
                    self.held += raw[p : p + 1]
                    self.begun = True
            else:
                self.held += raw[pos : p + 1]
                self.put("feature" if self.begun else "tail", bytes(self.held), fault(bytes(self.held)) if self.begun else None)
                self.held.clear()
                self.begun = False
            pos = p + 1
        self.depth = int(deep[-1]) if len(deep) else self.depth
        if self.depth <= 1:
            self.skeleton += raw[pos:]
        elif self.depth == 2:
            self.between(raw[pos:])
        else:
            self.held += raw[pos:]

    def close(self) -> list[tuple]:
        if self.held:
            self.put("head" if self.begun else "middle", bytes(self.held))
        note = json.dumps({"skeleton": self.skeleton.decode("latin-1"), "turns": [[k, *t[:3]] for k, t in self.turns.items()]})
        self.put("note", note.encode())
        return self.rows


def reader(entry: dict[int, tuple[bool, int, int]]):
    """The second pass; ``entry``: whether each block begins in a string, at which depth, and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seen = None, 0
        for block, data in by_block(batches):
            if now is None or now.block != block:
                if now is not None:
                    yield batch(now.close())
                now, seen = Reader(block, *entry[block][:2]), 0
            seen += len(data)
            now.feed(data[: len(data) - max(0, seen - entry[block][2])])  # but for the brace that the file's end doesn't have
            if now.rows:
                yield batch(now.rows)
                now.rows = []
        if now is not None:
            yield batch(now.close())

    def batch(found: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["block", "at", "kind", "opening", "text", "fault"])

    return run


@F.pandas_udf(StringType())
def fault_of(texts: pd.Series) -> pd.Series:
    """``fault`` of the few features that blocks cut."""
    return texts.map(lambda t: fault(bytes(t or b"")))


def key_before(skeleton: str) -> str | None:
    """The key of the root's value that the last bracket of a skeleton opens."""
    text = skeleton.rstrip(" \t\r\n")[:-1].rstrip(" \t\r\n")
    if not text.endswith(":"):
        return None
    text = text[:-1].rstrip(" \t\r\n")
    for start in range(len(text) - 2, -1, -1):
        if text[start] == '"':
            try:
                return json.loads(text[start:].encode("latin-1"))
            except ValueError:
                continue
    return None


def under(notes: list[tuple[int, dict]]) -> list[tuple[int, int, bool]]:
    """(block, opening, whether it is the root's ``features``); raises ``CollectionError`` for what is wrong with the root or between features."""
    whole = "".join(n["skeleton"] for _, n in notes)
    try:
        root = json.loads(whole.encode("latin-1"), object_pairs_hook=unique)
    except Repeated:
        raise CollectionError("a key of the root is repeated") from None
    except ValueError as e:
        raise CollectionError(f"the root is not one JSON object: {e}") from None
    if not isinstance(root, dict) or root.get("type") != "FeatureCollection" or not isinstance(root.get("features"), list):
        raise CollectionError("one FeatureCollection with features is expected")
    _, at, step, _ = marks(np.frombuffer(whole.encode("latin-1"), np.uint8), False)
    opens = at[(step > 0) & (np.cumsum(step) == 2)]
    named = [key_before(whole[: p + 1]) == "features" for p in opens.tolist()]
    out, start, last = [], 0, ""
    for block, note in notes:
        lo, hi = np.searchsorted(opens, [start, start + len(note["skeleton"])]).tolist()
        own = [bool(lo) and named[lo - 1], *named[lo:hi]]
        start += len(note["skeleton"])
        out += [(block, k, f) for k, f in enumerate(own)]
        for k, first, sound, end in note["turns"]:
            if own[k]:
                if not sound or first == (last or ","):
                    raise CollectionError("features must be objects, with a comma between two")
                last = end
    if last == ",":
        raise CollectionError("features must be objects, with a comma between two")
    return out


def features(spark: SparkSession, path: str) -> DataFrame:
    """(seq, text, fault) of the features of the file at ``path``, in their order, ``seq`` from 0."""
    source = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_path").alias("file"), "value")
    files = source.select("file", "size").distinct().limit(2).collect()
    if len(files) != 1:
        raise CollectionError("one FeatureCollection is expected, in one file that isn't empty")
    found = source.select("block", "value").mapInArrow(states, STATE).orderBy("block").limit(BLOCKS).collect()  # a row for each block
    extra = sum(b["bytes"] for b in found) - files[0]["size"]
    if extra not in (0, 1):  # 1: nothing closes behind the last piece
        raise CollectionError("the file isn't as long as its text; compressed files aren't read")
    entry, inside, depth = {}, False, 0
    for b in found:
        entry[b["block"]] = (inside, depth, b["bytes"] - (extra if b is found[-1] else 0))
        depth += b["within"] if inside else b["out"]
        inside ^= bool(b["parity"])
    parts = materialise(source.select("block", "value").mapInArrow(reader(entry), PART), "collection")
    notes = [(n["block"], json.loads(bytes(n["text"]))) for n in parts.where("kind = 'note'").orderBy("block").select("block", "text").collect()]
    mine = spark.createDataFrame([(b, k) for b, k, f in under(notes) if f], "block long, opening int")
    rows = parts.where("kind <> 'note'")
    # parts of cut features, two a block at the most, by the feature's beginning
    begun = F.last(F.when(F.col("kind") == "head", F.struct("block", "at", "opening")), ignorenulls=True)
    cut = rows.where("kind <> 'feature'").withColumn("start", begun.over(Window.orderBy("block", "at").rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("block", "at", "text"))).alias("parts"))
    text = F.aggregate(F.transform("parts", lambda p: p["text"]), F.lit(b""), lambda a, p: F.concat(a, p))
    cut = cut.select("start.block", "start.at", "start.opening", text.alias("text")).withColumn("fault", fault_of("text"))
    every = rows.where("kind = 'feature'").select("block", "at", "opening", "text", "fault").unionByName(cut).join(F.broadcast(mine), ["block", "opening"], "left_semi")
    every = every.withColumn("k", F.row_number().over(Window.partitionBy("block").orderBy("at")) - 1)
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # over a row for each block
    starts = every.groupBy("block").agg(F.count(F.lit(1)).alias("n")).select("block", before.alias("before"))
    return every.join(starts, "block").select((F.col("before") + F.col("k")).cast("long").alias("seq"), F.col("text").cast("string").alias("text"), "fault")
