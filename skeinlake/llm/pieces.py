"""Splitting of oversized texts at natural boundaries.

The separators form a hierarchy: section, paragraph, line, sentence, word, character. A piece is packed greedily up to the
limit and ends at the last boundary of the highest level that leaves it at least half full; only a stretch without such a
boundary goes down to the next level. Boundaries are found in the text: before white space of any script, and after the
stops and commas of scripts that write none. Where all boundaries of a piece are forced ones of the encoding (see
``tokens``), its tokens are the sum of those of its fragments; any other piece is encoded again, so every count is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder, default_vocabulary, encoder, slices

SECTION, PARAGRAPH, LINE, SENTENCE, WORD, CHARACTER = 6, 5, 4, 3, 2, 1
#: A fragment of more tokens than this is divided between characters, so that it can be packed.
ATOM = 32

_SPACE = rb"(?:[\t\n\x0b\x0c\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
_LEAD = re.compile(_SPACE + rb"*")
_LINES = re.compile(rb"\n|\xc2\x85|\xe2\x80\xa8")
_PARAGRAPH_SIGN = "\u2029".encode()
_HEADING = re.compile(rb"(#{1,6}[ \t]|={3,}|-{3,}|\*{3,}|~{3,})")
_STOPS = tuple(bytes([c]) for c in b".!?;:")
_WIDE_STOPS = tuple(c.encode() for c in "。！？…；｡»”؟۔।॥")
_CLOSERS = tuple(c.encode() for c in "」』）】〉》”’")
_any = lambda chars: b"(?:" + b"|".join(c.encode() if isinstance(c, str) else c for c in chars) + b")"
#: White space, or stops and commas that need none behind them, with the brackets and quotes they close.
_BOUNDARY = re.compile(b"(" + _SPACE + b"+)|" + _any("。！？…；｡") + b"+" + _any(_CLOSERS) + b"*|" + _any("、，："))


def _level(data: bytes, at: int, end: int) -> int:
    """The level of the boundary before byte ``at``; the text ends at ``end``."""
    lead = _LEAD.match(data, at, end)
    lines = len(_LINES.findall(lead.group()))
    signs = _PARAGRAPH_SIGN in lead.group()
    if (lines or signs) and _HEADING.match(data, lead.end(), end):
        return SECTION
    if lines > 1 or signs:
        return PARAGRAPH
    if lines:
        return LINE
    before = data[max(0, at - 24) : at]
    while not before.endswith(_WIDE_STOPS) and before.endswith(_CLOSERS):
        before = before[:-3]
    return SENTENCE if before.endswith(_STOPS) or before.endswith(_WIDE_STOPS) else WORD


def _atoms(enc: Encoder, ids: list[tuple[int, ...]], at: np.ndarray, data: bytes, end: int):
    """Starts, levels and token counts of one text's atoms, and whether the encoding has a forced boundary before each."""
    starts, levels, counts, forced = [], [], [], []
    begins = at.tolist()
    found = {m.start() if m.group(1) else m.end() for m in _BOUNDARY.finditer(data, begins[0], end)}
    extra = sorted(found.difference(begins, (end,)))
    parts, k = [], 0
    for t, a, b in zip(ids, begins, [*begins[1:], end]):
        first, sure = k, True
        while k < len(extra) and extra[k] < b:
            k += 1
        if k == first:
            parts.append((t, a, b, True))
            continue
        edges = [a, *extra[first:k], b]
        for p, q in zip(edges, edges[1:]):
            parts.append((enc.memo[data[p:q]], p, q, sure))
            sure = False
    for t, a, b, sure in parts:
        level = _level(data, a, end)
        if len(t) <= ATOM:
            starts.append(a), levels.append(level), counts.append(len(t)), forced.append(sure)
            continue
        p, n, sizes = a, 0, enc.bpe.decode_tokens_bytes(list(t))
        for k, token in enumerate(sizes):
            n += len(token)
            q = a + n
            whole = q >= b or data[q] & 0xC0 != 0x80
            if whole and (k + 1 == len(sizes) or q - p >= ATOM or (k + 1) % ATOM == 0):
                starts.append(p), levels.append(level if p == a else CHARACTER), forced.append(sure and p == a)
                counts.append(len(enc.bpe.encode_ordinary(data[p:q].decode("utf-8", "replace"))))
                p = q
    return np.array(starts), np.array(levels), np.array(counts), np.array(forced)


def cut_text(enc: Encoder, ids, at, data: bytes, begin: int, end: int, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(first byte, end byte, tokens) of each piece of the text data[begin:end]."""
    starts, levels, counts, forced = _atoms(enc, ids, at, data, end)
    total = np.concatenate([[0], np.cumsum(counts)])
    edge = np.append(starts, end)
    n, s, out = len(starts), 0, []

    def best(s: int, e: int) -> int:
        """The last boundary up to ``e`` of the highest level that leaves the piece half full."""
        if e < n:
            low = max(int(np.searchsorted(total, total[s] + limit // 2)), s + 1)
            span = levels[low : e + 1]
            if len(span) and (top := span.max()) > CHARACTER:
                e = low + int(np.flatnonzero(span == top)[-1])
        return max(e, s + 1)

    while True:
        e = best(s, int(np.searchsorted(total, total[s] + limit, side="right")) - 1)
        tokens = int(total[e] - total[s])
        if not forced[s : e + 1].all():
            exact = lambda e: len(enc.bpe.encode_ordinary(data[edge[s] : edge[e]].decode("utf-8", "replace")))
            while (tokens := exact(e)) > limit and e > s + 1:
                e = best(s, e - 1)
        out.append((int(edge[s]), int(edge[e]), tokens))
        if e >= n:
            return out
        # the next piece begins about ``overlap`` tokens before this one's end, at the best boundary near there
        a = int(np.searchsorted(total, total[e] - overlap * 5 // 4))
        b = int(np.searchsorted(total, total[e] - overlap * 3 // 4, side="right"))
        near = np.arange(max(a, s + 1), max(min(b, e), s + 1))
        if len(near):
            rank = np.lexsort((np.abs(total[e] - overlap - total[near]), -levels[near]))
            s = int(near[rank[0]])
        else:
            around = np.arange(s + 1, e + 1)
            s = int(around[np.argmin(np.abs(total[e] - overlap - total[around]))])


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 512, overlap: int = 64, vocabulary: str | None = None) -> DataFrame:
    """``key``, piece, start_char, end_char, n_tokens, text: the ordered pieces of every text of more than ``limit`` tokens.

    Texts within the limit, and null and empty ones, have no pieces. Piece 0 starts at character 0, the last ends with the
    text, and each next piece starts inside the one before. Repeated rows repeat their pieces.
    """
    path = vocabulary or default_vocabulary()
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for b in slices(batch, 1):
                ids, at, bounds, data = enc.fragments(b.column(1))
                chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80)])
                out: list[tuple] = []
                keys = b.column(0).to_pylist()
                for k, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    if j == i or sum(map(len, ids[i:j])) <= limit:
                        continue
                    begin, end = int(at[i]), int(at[j]) if j < len(at) else len(data)
                    for n, (p, q, t) in enumerate(cut_text(enc, ids[i:j], at[i:j], data, begin, end, limit, overlap)):
                        out.append((keys[k], n, int(chars[p] - chars[begin]), int(chars[q] - chars[begin]), t, data[p:q].decode("utf-8", "replace")))
                cols = list(zip(*out)) if out else [()] * 6
                types = [b.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]
                names = [key, "piece", "start_char", "end_char", "n_tokens", "text"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    # a text of up to ``limit`` bytes has no more tokens than that
    large = docs.select(key, text).where(F.octet_length(text) > limit)
    return large.mapInArrow(run, f"`{key}` {kind}, piece int, start_char long, end_char long, n_tokens int, text string")
