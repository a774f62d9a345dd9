"""Encoding with a public byte-level BPE vocabulary, by forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be merged over: between its bytes every encoding has a
boundary. Where the left byte ends a character that isn't white space and the right byte is ASCII white space, the
vocabulary's pattern has a boundary too, whatever stands around it, so both sides encode independently and their ids are
concatenated. The fragments are short and recur, so each is encoded once for a batch of documents and then looked up.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed value: the pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Last bytes of the UTF-8 forms of white space beyond ASCII.
SPACE_TAILS = (0x85, 0xA0, *range(0x80, 0x8B), 0xA8, 0xA9, 0xAF, 0x9F)
SPACES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
#: Fragments of up to so many bytes are remembered, up to so many of them; others are encoded each time.
MEMO_BYTES, MEMO_SIZE = 40, 300_000
#: Documents that are encoded at a time, for the memory of a Python worker.
SLICE_BYTES = 4 << 20


def default_vocabulary() -> str:
    """byte_bpe_50k of the installed public tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    at = Path(spec.origin).parent if spec else Path("/opt/tokenizers")
    return str(at / "byte_bpe_50k.tiktoken")


class _Memo(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, fragment: bytes) -> tuple[int, ...]:
        ids = tuple(self.encode(fragment.decode("utf-8", "replace")))
        if len(fragment) <= MEMO_BYTES:
            if len(self) >= MEMO_SIZE:
                self.clear()
            self[fragment] = ids
        return ids


class Encoder:
    """Encodes texts with the vocabulary at ``path``: lines of a base64 token and its id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        inside = np.zeros((256, 256), dtype=bool)
        for t in ranks:
            b = np.frombuffer(t, dtype=np.uint8)
            inside[b[:-1], b[1:]] = True
        left = np.ones(256, dtype=bool)
        left[[*SPACES, *SPACE_TAILS]] = False
        left[0xC2:] = False  # no character ends with these
        right = np.zeros(256, dtype=bool)
        right[list(SPACES)] = True
        self.cut = (~inside & left[:, None] & right[None, :]).ravel()
        self.memo = _Memo(self.bpe.encode_ordinary)

    def cuts(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Positions in the bytes before which every encoding has a boundary; ``starts`` are those of documents."""
        at = np.zeros(len(data), dtype=bool)
        if len(data) > 1:
            at[1:] = self.cut[(data[:-1].astype(np.uint16) << 8) | data[1:]]
        at[starts] = True
        return np.flatnonzero(at)

    def fragments(self, texts: pa.Array) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray, bytes]:
        """Ids of each fragment, the fragments' starts in the bytes, the documents' bounds among the fragments, the bytes."""
        raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts.cast(pa.binary())]
        data = b"".join(raw)
        ends = np.cumsum([len(r) for r in raw], dtype=np.int64)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        at = self.cuts(np.frombuffer(data, dtype=np.uint8), starts[starts < ends])
        ids = list(map(self.memo.__getitem__, map(data.__getitem__, map(slice, at.tolist(), [*at[1:].tolist(), len(data)]))))
        bounds = np.searchsorted(at, np.concatenate([starts, ends[-1:]]))
        return ids, at, bounds, data

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; empty for an empty or null one."""
        if not len(texts):
            return pa.array([], pa.list_(pa.int32()))
        ids, _, bounds, _ = self.fragments(texts)
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32)
        total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))])
        return pa.ListArray.from_arrays(pa.array(total[bounds].astype(np.int32)), pa.array(flat))

    def sizes(self, texts: pa.Array) -> np.ndarray:
        """The number of ids of each text."""
        if not len(texts):
            return np.empty(0, dtype=np.int64)
        ids, _, bounds, _ = self.fragments(texts)
        total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))])
        return np.diff(total[bounds])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this process for the vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batch of about SLICE_BYTES of text, at least one row each."""
    sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(column)], dtype=np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b > a:
            yield batch.slice(a, b - a)


def token_ids(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``key`` and ids of every row. Null and empty texts have an empty list, a null key stays, repeated rows repeat."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for b in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), enc.encode(b.column(1))], names=[key, "ids"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids array<int>")


def token_sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``key`` and n_tokens of every row; 0 for null and empty texts."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for b in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(enc.sizes(b.column(1)))], names=[key, "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_tokens long")
