"""SentencePiece encoding and decoding by suffix-array matching.

No piece holds a blank behind another character, so a text falls into *units*: blanks, then a run without blanks. The distinct
units of a batch that were not met before are laid end to end; their suffixes, cut at the unit's end and at the longest
piece's length, are sorted; every piece of the vocabulary is then looked up in that array by binary search, which gives the
range of all its occurrences. The resulting edges (start, end, piece) are sorted by position and relaxed.

The vocabulary is a byte-pair one, where the pieces' scores order merges and are not costs of a path; so edges are relaxed in
the order of their scores instead of by shortest path: in each round every unit joins the two neighbouring symbols that span
its best edge, the leftmost of equals, until no edge spans two neighbours. Characters without a piece become their bytes. This gives the
library's ids exactly. Decoding maps ids back to text.

Where no edge of a unit crosses a place between two characters, no merge ever does: units are cut there before they are relaxed, and a
long unit (text without blanks) is encoded window by window, each up to the last such place. Only a run that edges cover without a gap, such as many equal signs,
is held whole, with some hundred bytes a byte. The ids of units met before are remembered by hash, and taken only if the unit's bytes are the same.

Blanks are U+0020 and U+2581, which the model doesn't tell apart; a text with U+2581 decodes to one with U+0020 in its
place, and the round trip is judged with that in mind. Null text counts as empty, which has no pieces and decodes to the empty
text. Texts of any length are taken whole. Null ids stay null; repeated rows are encoded one by one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import words
from .common import only

BLANK = b"\xe2\x96\x81"
DEPTH = 48
LONG = 256
PART = 1 << 18
MOST = 1 << 21


#: A text that shows what a model does before it looks for pieces: nothing but a blank before it is known to be right here.
PROBE = "\ufb01 A\tb  c"


class Vocabulary:
    """The pieces of a model: bytes with blanks as 0x20, ids, and merge ranks (0 is the best score).

    Refuses a model whose scores aren't the ranks of merges, as those of a unigram model, or that normalises texts.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        size = p.vocab_size()
        shown = b"".join(bytes([int(q[3:-1], 16)]) if p.is_byte(p.piece_to_id(q)) else q.encode() for q in p.encode(PROBE, out_type=str))
        if shown.replace(BLANK, b" ") != b" " + PROBE.encode():
            raise ValueError(f"{path}: the model normalises texts, or puts no blank before them")
        self.byte = np.zeros(256, dtype=np.int32)
        self.text: list[bytes] = []
        pieces = []
        for i in range(size):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
                self.text.append(bytes([int(piece[3:-1], 16)]))
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                self.text.append(b"")
            else:
                self.text.append(piece.encode().replace(BLANK, b" "))
                pieces.append((self.text[-1], i, p.get_score(i)))
        if any(b" " in t.lstrip(b" ") or len(t) > DEPTH for t, _, _ in pieces):
            raise ValueError("a piece has an inner blank or is too long; units would not be independent")
        if any(s != int(s) for _, _, s in pieces):
            raise ValueError(f"{path}: the pieces' scores are no ranks of merges")
        self.pieces = sorted(pieces)
        self.ids = np.array([i for _, i, _ in self.pieces], dtype=np.int64)
        scores = np.array([s for _, _, s in self.pieces])
        self.score_rank = np.searchsorted(np.unique(-scores), -scores)  # equal scores have equal ranks
        self.sizes = np.array([len(t) for t, _, _ in self.pieces], dtype=np.int64)
        self.low = np.array([t for t, _, _ in self.pieces], dtype=f"S{DEPTH + 1}")
        self.high = np.array([t + b"\xff" for t, _, _ in self.pieces], dtype=f"S{DEPTH + 1}")  # no UTF-8 text has this byte


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def suffix_array(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places of the suffixes of ``data``, each cut at its unit's end and at DEPTH, and the cut suffixes in that order."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(DEPTH, np.uint8)])
    left = np.minimum(ends - np.arange(n), DEPTH)
    keys = []
    order = None
    for k in range(0, DEPTH, 8):
        if k and not (left > k).any():
            break
        key = np.zeros(n, dtype=np.uint64)
        for j in range(k, k + 8):
            key = (key << words.U(8)) | np.where(left > j, padded[j : j + n], 0).astype(np.uint64)
        keys.append(key)
    order = np.lexsort(keys[::-1])
    table = np.zeros((n, DEPTH + 1), dtype=np.uint8)
    for k, key in enumerate(keys):
        table[:, 8 * k : 8 * k + 8] = key[order].astype(">u8").view(np.uint8).reshape(n, 8)
    return order, table.view(f"S{DEPTH + 1}").ravel()


def edges(vocab: Vocabulary, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All occurrences of all pieces, sorted by position: keys start * 64 + length, and places in ``vocab.pieces``."""
    order, cut = suffix_array(data, ends)
    a, b = np.searchsorted(cut, vocab.low, "left"), np.searchsorted(cut, vocab.high, "left")
    some = np.flatnonzero(b > a)
    count = (b - a)[some]
    piece = np.repeat(some, count)
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a[some], count)
    key = order[at].astype(np.int64) * 64 + vocab.sizes[piece]
    by = np.argsort(key)
    return key[by], piece[by]


def relax(vocab: Vocabulary, key: np.ndarray, piece: np.ndarray, starts: np.ndarray, stops: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """Starts of the symbols that remain once all merges are done. ``starts`` and ``stops``: of the characters, ``unit``: theirs."""
    never = np.int64(1) << 62

    def ranks(s: np.ndarray, e: np.ndarray) -> np.ndarray:
        want = s * 64 + (e - s)
        at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        ok = (key[at] == want) & (e - s < 64) if len(key) else np.zeros(len(s), bool)
        return np.where(ok, vocab.score_rank[piece[at]] if len(key) else 0, never)

    done = []
    s, e, u = starts, stops.copy(), unit
    r = np.full(len(s), never)
    pair = np.flatnonzero(u[1:] == u[:-1])
    r[pair] = ranks(s[pair], e[pair + 1])
    while len(s):
        first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        best = np.minimum.reduceat(r, first)
        size = np.diff(np.append(first, len(s)))
        live = np.repeat(best < never, size)
        if not live.all():
            done.append(s[~live])
            s, e, u, r = s[live], e[live], u[live], r[live]
            if not len(s):
                break
            first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
            size = np.diff(np.append(first, len(s)))
            best = best[best < never]
        hits = np.flatnonzero(r == np.repeat(best, size))
        at = hits[np.concatenate([[True], u[hits[1:]] != u[hits[:-1]]])]  # the leftmost of equals
        e[at] = e[at + 1]
        keep = np.ones(len(s), dtype=bool)
        keep[at + 1] = False
        at = at - np.arange(len(at))
        s, e, u, r = s[keep], e[keep], u[keep], r[keep]
        r[at] = never
        right = at[(at + 1 < len(s)) & (u[np.minimum(at + 1, len(s) - 1)] == u[at])]
        r[right] = ranks(s[right], e[right + 1])
        left = at[(at > 0) & (u[np.maximum(at - 1, 0)] == u[at])] - 1
        r[left] = ranks(s[left], e[left + 1])
    return np.sort(np.concatenate([*done, s]))


def relax_long(vocab: Vocabulary, key: np.ndarray, piece: np.ndarray, starts: list[int], end: int) -> list[int]:
    """The same for one unit of many characters, with a queue; ``starts`` of the symbols that remain."""
    n = len(starts)
    after, before, stop, alive = [*range(1, n), -1], [-1, *range(n - 1)], [*starts[1:], end], [True] * n
    queue: list[tuple[int, int, int, int]] = []

    def push(i: int) -> None:
        j = after[i]
        if j >= 0 and stop[j] - starts[i] < 64:
            want = starts[i] * 64 + stop[j] - starts[i]
            at = int(np.searchsorted(key, want))
            if at < len(key) and key[at] == want:
                heapq.heappush(queue, (int(vocab.score_rank[piece[at]]), i, stop[i], stop[j]))

    for i in range(n - 1):
        push(i)
    while queue:
        _, i, mid, last = heapq.heappop(queue)
        j = after[i]
        if alive[i] and stop[i] == mid and j >= 0 and stop[j] == last:
            alive[j], stop[i], after[i] = False, last, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
    return [s for s, a in zip(starts, alive, strict=True) if a]


def free(key: np.ndarray, n: int) -> np.ndarray:
    """For each place of ``n`` bytes and their end, whether no edge crosses it."""
    start = key >> 6
    stop = start + (key & 63)
    return np.cumsum(np.bincount(start + 1, minlength=n + 2) - np.bincount(stop, minlength=n + 2))[: n + 1] <= 0


def encode_units(vocab: Vocabulary, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of some units laid end to end (``ends``: where each ends), and how many each has."""
    sizes = np.diff(np.concatenate([[0], ends]))
    unit_of = np.repeat(np.arange(len(ends)), sizes)
    key, piece = edges(vocab, data, ends[unit_of])
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    stops = np.append(starts[1:], len(data))
    fresh = free(key, len(data))[starts]
    unit = np.cumsum(fresh) - 1
    begin = starts[fresh]
    long = (np.diff(np.append(begin, len(data))) > LONG)[unit]
    s = relax(vocab, key, piece, starts[~long], stops[~long], unit[~long])
    if long.any():
        finish = np.append(begin[1:], len(data))
        more = [np.array(relax_long(vocab, key, piece, starts[unit == k].tolist(), int(finish[k]))) for k in np.unique(unit[long]).tolist()]
        s = np.sort(np.concatenate([s, *more]))
    e = np.append(s[1:], len(data))
    want = s * 64 + np.minimum(e - s, 63)
    at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
    known = (key[at] == want) & (e - s < 64) if len(key) else np.zeros(len(s), bool)
    count = np.where(known, 1, e - s)
    into = np.cumsum(count) - count
    ids = np.empty(int(count.sum()), dtype=np.int32)
    ids[into[known]] = vocab.ids[piece[at[known]]] if len(key) else 0
    for k in np.flatnonzero(~known).tolist():  # rare: characters without a piece
        ids[into[k] : into[k] + count[k]] = vocab.byte[data[s[k] : e[k]]]
    return ids, np.bincount(unit_of[s], weights=count, minlength=len(ends)).astype(np.int64)


def encode_long(vocab: Vocabulary, unit: np.ndarray, part: int) -> np.ndarray:
    """Ids of one long unit, window by window; all edges that cross a place of a window lie in it and the ``DEPTH`` bytes behind it."""
    out, a, width = [], 0, part
    while a < len(unit):
        b = min(len(unit), a + width)
        if b < len(unit):
            window = unit[a : b + DEPTH]
            key, _ = edges(vocab, window, np.full(len(window), len(window)))
            cut = np.flatnonzero(free(key, len(window))[: b - a + 1] & np.append((window & 0xC0) != 0x80, True)[: b - a + 1])
            if cut[-1] == 0:
                width *= 2
                continue
            b = a + int(cut[-1])
        out.append(encode_units(vocab, unit[a:b], np.array([b - a]))[0])
        a, width = b, part
    return np.concatenate(out)


def encode_all(vocab: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, part: int = PART) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the units data[starts:ends], and how many each has; about ``part`` bytes are looked at together."""
    size = ends - starts
    upto = np.cumsum(size)
    ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] - size[at] + part, "right")))
        if size[at] > part:
            ids.append(encode_long(vocab, data[starts[at] : ends[at]], part))
            counts.append(np.array([len(ids[-1])]))
        else:
            offset = np.cumsum(size[at:to]) - size[at:to]
            take = np.arange(int(size[at:to].sum())) - np.repeat(offset, size[at:to]) + np.repeat(starts[at:to], size[at:to])
            for x, into in zip(encode_units(vocab, data[take], offset + size[at:to]), (ids, counts), strict=True):
                into.append(x)
        at = to
    return np.concatenate(ids), np.concatenate(counts)


class Encoder:
    """Encodes columns of texts; remembers the units it has met, with their bytes, and starts anew after ``MOST`` of them."""

    def __init__(self, path: str):
        self.vocab = vocabulary(path)
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.where, self.count, self.at, self.size = (np.zeros(0, np.int64) for _ in range(4))
        self.pool, self.text = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def learn(self, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> None:
        if not len(hashes):
            return
        ids, counts = encode_all(self.vocab, data, starts, ends)
        size = ends - starts
        offset = np.cumsum(size) - size
        into = np.searchsorted(self.hashes, hashes)
        put = lambda old, new: np.insert(old, into, new)
        self.hashes, self.count, self.size = put(self.hashes, hashes), put(self.count, counts), put(self.size, size)
        self.where, self.at = put(self.where, len(self.pool) + np.cumsum(counts) - counts), put(self.at, len(self.text) + offset)
        self.pool = np.concatenate([self.pool, ids])
        self.text = np.concatenate([self.text, data[np.arange(int(size.sum())) - np.repeat(offset, size) + np.repeat(starts, size)]])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin and the last end."""
        column = pc.replace_substring(pc.fill_null(column, "").cast(pa.large_string()), "▁", " ")
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise(pa.scalar("", pa.large_string()), column, pa.scalar(" ", pa.large_string())))
        data, offsets = words.buffers(column)
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        blank = data == 32
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        size = ends - starts
        hashes = words.word_hashes(data, starts, ends)
        own, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(own) > MOST or len(self.text) > 32 * MOST:
            self.clear()
        # a hash stands for the first unit that had it; whoever has other bytes is encoded by itself
        model = first[back]
        plain = size == size[model]
        plain[plain] = words.same_bytes(data, starts[plain], data, starts[model[plain]], size[plain])
        slot = np.minimum(np.searchsorted(self.hashes, own), max(len(self.hashes) - 1, 0))
        known = self.hashes[slot] == own if len(self.hashes) else np.zeros(len(own), bool)
        met = np.flatnonzero(known)
        same = self.size[slot[met]] == size[first[met]]
        same[same] = words.same_bytes(self.text, self.at[slot[met[same]]], data, starts[first[met[same]]], size[first[met[same]]])
        plain &= ~np.isin(back, met[~same])
        new = np.flatnonzero(~known)
        self.learn(own[new], starts[first[new]], ends[first[new]], data)
        found = np.searchsorted(self.hashes, own)[back]
        count, where, pool = self.count[found], self.where[found], self.pool
        odd = np.flatnonzero(~plain)
        if len(odd):
            ids, count[odd] = encode_all(self.vocab, data, starts[odd], ends[odd])
            where[odd] = len(pool) + np.cumsum(count[odd]) - count[odd]
            pool = np.concatenate([pool, ids])
        upto = np.cumsum(count)
        ids = pool[np.arange(upto[-1]) - np.repeat(upto - count, count) + np.repeat(where, count)]
        return ids, np.concatenate([[0], upto])[np.searchsorted(starts, offsets)]


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each worker process; a new worker just starts with none."""
    return Encoder(path)


def decode(vocab: Vocabulary, ids: np.ndarray) -> bytes:
    """The text of some ids, without the blank that encoding put in front."""
    return b"".join(map(vocab.text.__getitem__, ids.tolist()))[1:]


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_pieces, ids and round_trip (decoding gives the text back) of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for b in words.slices(batch, "text", 4 << 20):
                text = pc.fill_null(b.column("text"), "")
                ids, cuts = enc.encode(text)
                same = []
                for x, a, z in zip(text, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    same.append(decode(enc.vocab, ids[a:z]) == x.as_py().encode().replace(BLANK, b" "))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(cuts)), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids)), pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids", "round_trip"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, ids array<int>, round_trip boolean")
