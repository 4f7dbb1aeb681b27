"""Token counts of whole texts, as the tokenizer's own library gives them, by overlap resynchronisation.

Every text is cut into chunks that overlap, and all chunks are encoded with offsets; a text no longer than a chunk is one chunk. Two
neighbours are spliced at a *stable common boundary* of their overlap: a place between two pre-tokens of any text, at which
both encodings have a token boundary and agree on the tokens around it. If the overlap has no such place, because a run of letters is
longer than the overlap or the two encodings differ, the overlap is doubled until it has one or the chunk reaches the text's end.

Why such a place is stable: the normaliser works on single characters and their combining marks; the pattern finds runs of
letters, runs of other signs, single digits and contractions, never white space. So between white space and what follows, and
between a letter and a following punctuation mark, the pattern always starts anew, and neither mark composes with the letter. Special strings
are up to ``SPECIAL`` characters long and found before all else, so a place counts only if both encodings see that far to either side. The proof
is about this kind of tokenizer alone: ``tokenizer`` raises if a file has another normaliser, pattern or longer special strings.
A run without any such place (one word of many MB) has no boundary that could be proven, and is encoded whole.

Null text counts as empty: 0 bytes and 0 tokens. A null id stays null. Repeated rows are counted one by one. An empty table gives an
empty result. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import words
from .common import only

CHUNK = 1 << 14
OVERLAP = 1 << 8
BLANK = frozenset(" \t\n\v\f\r")
#: ASCII and ideographic punctuation that composes with nothing.
MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~、。，．：；？！")
AGREE = 2
SPECIAL = 24
#: The normaliser and the split that the proof is about.
NORMALISER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the cores belong to Spark's tasks
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    known = json.loads(tok.to_str())
    steps, split = (known["normalizer"] or {}).get("normalizers"), (known["pre_tokenizer"] or {}).get("pretokenizers", [])[:1]
    if steps != NORMALISER or split != [SPLIT] or any(len(t["content"]) > SPECIAL or t["lstrip"] or t["rstrip"] or t["single_word"] for t in known["added_tokens"]):
        raise ValueError(f"{path}: its texts can't be proven to splice")
    return tok


def letter(c: str) -> bool:
    """A letter in every version of the character tables, and one letter still in lower case."""
    return len(c.lower()) == 1 and unicodedata.ucd_3_2_0.category(c)[0] == "L"


class Part:
    """An encoding of text[start:end], asked by positions in ``text``."""

    def __init__(self, tok, text: str, start: int, end: int, encoding=None):
        self.start, self.end = start, end
        self.encoding = encoding or tok.encode(text[start:end], add_special_tokens=False)

    def begins(self, at: int) -> int | None:
        """The token that begins at a position; None if none does."""
        k = self.encoding.char_to_token(at - self.start)
        return k if k is not None and self.encoding.token_to_chars(k)[0] == at - self.start and (not k or self.encoding.token_to_chars(k - 1)[1] <= at - self.start) else None

    def around(self, k: int, before: int, after: int) -> list[tuple[int, int, int]]:
        ids = self.encoding.ids
        return [(ids[i], *(x + self.start for x in self.encoding.token_to_chars(i))) for i in range(k - before, k + after)]


def boundary(text: str, lo: int, hi: int, left: Part, right: Part) -> tuple[int, int, int] | None:
    """A stable common boundary in text[lo:hi], with the token of either part that begins there; None if there is none."""
    middle = (lo + hi) // 2
    for at in (*range(middle, hi), *range(lo, middle)):
        before, after = text[at - 1], text[at]
        if (before in BLANK and after not in BLANK) or (after in MARKS and letter(before)):
            a, b = left.begins(at), right.begins(at)
            if a is not None and b is not None:
                n, m = min(len(left.encoding) - a, len(right.encoding) - b, AGREE), min(a, b, AGREE)
                if left.around(a, m, n) == right.around(b, m, n):
                    return at, a, b
    return None


def cuts(length: int, chunk: int, overlap: int) -> list[tuple[int, int]]:
    """The chunks of a text."""
    return [(a, min(length, a + chunk)) for a in range(0, max(length - overlap, 1), max(chunk - overlap, 1))]


def spliced(tok, text: str, parts: list[Part], chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[tuple[Part, int, int]]:
    """Parts of ``text``, each with the range of its tokens that counts; together they are the tokens of the whole text."""
    now, first, from_ = parts[0], 0, 0
    ready = {p.start: p for p in parts[1:]}
    while now.end < len(text):
        wide, found = overlap, None
        while found is None and now.end < len(text):
            lo = max(from_, now.end - wide)
            after = ready.get(lo) or Part(tok, text, lo, min(len(text), lo + max(chunk, 2 * wide)))
            found = boundary(text, lo + SPECIAL, now.end - SPECIAL, now, after)
            if found is None:
                if lo == from_:  # not even the whole part has one: make the part longer
                    now = Part(tok, text, now.start, min(len(text), now.end + max(wide, chunk)))
                wide *= 2
        if found is not None:
            yield now, first, found[1]
            from_, now, first = found[0], after, found[2]
    yield now, first, len(now.encoding)


def encoded(tok, texts: list[str], chunk: int = CHUNK, overlap: int = OVERLAP) -> Iterator[list[tuple[Part, int, int]]]:
    """The spliced parts of each text; the chunks of all texts are encoded together."""
    where = [cuts(len(t), chunk, overlap) for t in texts]
    done = iter(tok.encode_batch([t[a:b] for t, own in zip(texts, where, strict=True) for a, b in own], add_special_tokens=False))
    for t, own in zip(texts, where, strict=True):
        yield list(spliced(tok, t, [Part(tok, t, a, b, next(done)) for a, b in own], chunk, overlap))


def token_counts(docs: DataFrame, path: str, limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of ``docs(doc_id, text)``; ``path`` names the tokenizer's file."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for b in words.slices(batch, "text"):
                text = pc.fill_null(b.column("text"), "")
                sizes = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
                n = np.array([sum(z - a for _, a, z in own) for own in encoded(tok, text.to_pylist(), chunk, overlap)], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return only(docs, "doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
