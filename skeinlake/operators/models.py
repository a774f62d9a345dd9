"""Where models plug in: embedders, workers on media, pooling, and hashes of images.

No model files are at hand, so the default embedder hashes words; any object with the same three members takes its place.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


class Embedder(Protocol):
    """``embed`` gives one vector for each text; ``version`` keeps vectors of different models apart."""

    version: str
    dims: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashedWords:
    """An embedder without a model: a word adds (hash mod 3) - 1 where its hash says. Equal texts have equal vectors."""

    version, dims = "hashed-words", 384

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = 2166136261
                for b in w.encode():
                    h = ((h ^ b) * 16777619) & 0xFFFFFFFF
                out[i, h % self.dims] += h % 3 - 1
        return unit(out)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x, dtype=float), where=n > 0)


def mean_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The mean of the token states that the mask keeps, scaled to length 1; states (n, tokens, dims), mask (n, tokens)."""
    m = mask[:, :, None].astype(float)
    return unit((states * m).sum(1) / np.maximum(m.sum(1), 1))


def rectangular(ids: list[list[int]], fill: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ids of one length and the mask of what is not filling."""
    out = np.full((len(ids), max(map(len, ids), default=0)), fill)
    mask = np.zeros(out.shape, dtype=int)
    for i, r in enumerate(ids):
        out[i, : len(r)], mask[i, : len(r)] = r, 1
    return out, mask


def vocabulary(path: str) -> dict[str, int]:
    """The word pieces of a tokenizer file and their ids; other kinds of model are refused."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model.get("type", "WordPiece") != "WordPiece":
        raise ValueError("the tokenizer has no word pieces")
    return model["vocab"]


def embed(rows: DataFrame, embedder: Embedder, key: str = "post_id", body: str = "text", least_bytes: int = 8, batch: int = 32) -> DataFrame:
    """``key``, embedding, model_version, text_hash of rows whose text has ``least_bytes``; the model is loaded once a worker.

    Each distinct text is embedded once: the vectors are joined back by the text's hash.
    """
    hashed = rows.where(F.octet_length(body) >= least_bytes).select(key, body, F.sha2(body, 256).alias("text_hash"))
    distinct = hashed.groupBy("text_hash").agg(F.min(body).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, batch):
                part = b.slice(s, batch)
                v = np.asarray(embedder.embed(part.column(1).to_pylist()), dtype=np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, v.size + 1, embedder.dims, dtype=np.int32)), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["text_hash", "embedding"])

    vectors = distinct.mapInArrow(run, "text_hash string, embedding array<float>")
    return hashed.select(key, "text_hash").join(vectors, "text_hash").select(key, "embedding", F.lit(embedder.version).alias("model_version"), "text_hash")


def with_context(edges: DataFrame, texts: DataFrame, key: str = "post_id", body: str = "text") -> DataFrame:
    """Texts with the text of the first post they answer in front: what context-aware vectors are made of."""
    parent = edges.where("target_post_id is not null").groupBy(F.col("source_post_id").alias(key)).agg(F.min("target_post_id").alias("_p"))
    above = texts.select(F.col(key).alias("_p"), F.col(body).alias("_t"))
    out = texts.join(parent, key, "left").join(above, "_p", "left")
    return out.select(key, F.when(F.coalesce("_t", F.lit("")) != "", F.concat("_t", F.lit(" [SEP] "), body)).otherwise(F.col(body)).alias(body))


def run_worker(blobs: DataFrame, kind: str, process: Callable[[bytes], str | None], key: str = "post_id", content: str = "content") -> DataFrame:
    """``key``, kind, text, error of a tool run on the bytes of each file: text of images, speech of sound. A file on which the
    tool fails has the error, and does not stop the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, errors = [], []
            for c in b.column(1).to_pylist():
                try:
                    texts.append(process(c) if c is not None else None)
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - a tool may fail in any way
                    texts.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([kind] * b.num_rows), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=[key, "kind", "text", "error"])

    return blobs.select(key, content).mapInArrow(run, f"{key} {blobs.schema[key].dataType.simpleString()}, kind string, text string, error string")


def ocr_confidence(tsv: Column) -> Column:
    """The mean of the confidences, the eleventh field, of the lines of a recogniser's table; negative ones are no words."""
    values = F.transform(F.split(tsv, "\n"), lambda l: F.try_element_at(F.split(l, "\t"), F.lit(11)))
    good = F.filter(F.transform(values, lambda v: F.when(F.trim(v).rlike(r"^-?\d+(\.\d+)?$"), F.trim(v).cast("double"))), lambda v: v >= 0)
    return text.let(good, lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda s, v: s + v) / F.size(g)).otherwise(0.0))


def _shrunk(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """A grey image averaged to a size; each cell is the mean of its part of the image."""
    rows = np.linspace(0, image.shape[0], height + 1)
    cols = np.linspace(0, image.shape[1], width + 1)
    area = lambda e, n: np.array([[max(0.0, min(e[i + 1], k + 1) - max(e[i], k)) for k in range(n)] for i in range(len(e) - 1)])
    a, b = area(rows, image.shape[0]), area(cols, image.shape[1])
    return (a / a.sum(1, keepdims=True)) @ image @ (b / b.sum(1, keepdims=True)).T


def _code(bits: np.ndarray) -> int:
    n = int("".join("1" if b else "0" for b in bits.ravel()), 2)
    return n - (1 << 64) if n >> 63 else n


def average_hash(image: np.ndarray) -> int:
    """64 bits: which cells of the 8 x 8 image are above its mean."""
    s = _shrunk(image, 8, 8)
    return _code(s > s.mean())


def difference_hash(image: np.ndarray) -> int:
    """64 bits: where brightness grows from left to right in the 8 x 9 image."""
    s = _shrunk(image, 8, 9)
    return _code(s[:, 1:] > s[:, :-1])


def perceptual_hash(image: np.ndarray) -> int:
    """64 bits: which of the lowest 8 x 8 frequencies of the 32 x 32 image are above their median."""
    s = _shrunk(image, 32, 32)
    k = np.arange(32)
    dct = np.cos(np.pi / 32 * (k[None, :] + 0.5) * k[:, None])
    low = (dct @ s @ dct.T)[:8, :8]
    return _code(low > np.median(low))


HASHES = {"phash": perceptual_hash, "dhash": difference_hash, "ahash": average_hash}


def image_hashes(images: DataFrame, key: str = "blob_id") -> DataFrame:
    """``key``, algo, code of grey images given as rows of numbers (``key``, width, pixels); unusable images have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, w, p in zip(*(c.to_pylist() for c in b.columns)):
                if w and p and len(p) % w == 0:
                    image = np.asarray(p, dtype=float).reshape(-1, w)
                    out += [(k, name, f(image)) for name, f in HASHES.items()]
            cols = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=[key, "algo", "code"])

    return images.select(key, "width", "pixels").mapInArrow(run, f"{key} {images.schema[key].dataType.simpleString()}, algo string, code long")
