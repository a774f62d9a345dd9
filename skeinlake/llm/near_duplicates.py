"""Near-duplicate texts by b-bit MinHash.

Each text is its set of distinct words. Of the minima of HASHES hash functions, ROWS at a time make a band key, by which
candidates meet, and the low BITS bits of each are packed into a signature of longs. A candidate's similarity is estimated
from the equal positions of two signatures, counted by bit operations and corrected for chance collisions; what could reach
the threshold is checked exactly on the words. Texts of one word set are one member of a band, with a list of who has it,
and each task passes on the bands of a set once, so copies are not compared with each other, however many there are. A band
that more than HOT word sets share is divided into parts; each two parts meet in a task of their own, which compares their
signatures as blocks and passes on only pairs that could reach the threshold.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import Stage
from .components import components

HASHES, ROWS, BITS = 256, 7, 2
#: Words whose hash a worker remembers.
MEMO = 1_000_000
#: Standard deviations by which an estimate may miss the threshold and still be checked.
SLACK = 4.0
#: Texts that are hashed at a time.
CHUNK = 2000
#: Word sets of a band that are joined as they are, and of a part of a larger one.
HOT = 1024
#: Keys of bands that one task meets, about.
PER_TASK = 4_000_000

_TAG = re.compile(r"<[^>]*>")
_QUOTE = re.compile(r">>>/\w+/\d*|>>\d+")
_WORD = re.compile(r"[^\W_]+")

_rng = np.random.default_rng(20240101)
_MUL = (_rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)) | np.uint32(1)
_XOR = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_MIX = _rng.integers(1, 1 << 62, ROWS, dtype=np.uint64) | np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= MEMO:
            self.clear()
        self[word] = h
        return h


_hashes = _Hashes()


def words(text: str | None) -> list[str]:
    """The distinct words: tags and quote references are blanks, entities decoded, lower case, runs of letters and digits."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if ">>" in text:
        text = _QUOTE.sub(" ", text)
    return list(dict.fromkeys(_WORD.findall(text.lower())))


def signatures(sets: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The identity of each (non-empty) word set, its band hashes (32 bits) and its packed signature (longs)."""
    size = np.array([len(s) for s in sets])
    w = np.fromiter(map(_hashes.__getitem__, (x for s in sets for x in s)), dtype=np.uint64, count=int(size.sum()))
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    mixed = (w ^ (w >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    ident = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), at).view(np.int64)
    w32 = (w >> np.uint64(32)).astype(np.uint32)
    low = np.empty((HASHES, len(sets)), dtype=np.uint32)
    for k in range(HASHES):
        low[k] = np.minimum.reduceat((w32 ^ _XOR[k]) * _MUL[k], at)
    # the low bits of a product hardly mix, so minima are mixed once more before their bits are used
    low = (low ^ (low >> np.uint32(16))) * np.uint32(0x45D9F3B)
    low ^= low >> np.uint32(15)
    rows = low[: HASHES // ROWS * ROWS].reshape(HASHES // ROWS, ROWS, len(sets)).astype(np.uint64)
    bands = (((rows * _MIX[None, :, None]).sum(1)) >> np.uint64(32)).astype(np.uint32).T
    kept = (low & np.uint32((1 << BITS) - 1)).astype(np.uint64).T.reshape(len(sets), -1, 64 // BITS)
    packed = (kept << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64)
    return ident, np.ascontiguousarray(bands), packed.view(np.int64)


def _hashed(texts: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """id, h, n, sig, bands of every text of ``least`` words or more; a task gives the bands of a set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for s in range(0, batch.num_rows, CHUNK):
                b = batch.slice(s, CHUNK)
                sets = [words(t) for t in b.column(1).to_pylist()]
                keep = [i for i, w in enumerate(sets) if len(w) >= max(1, least)]
                if not keep:
                    continue
                sets = [sets[i] for i in keep]
                ident, bands, sig = signatures(sets)
                new = []
                if len(seen) > MEMO:
                    seen.clear()
                for h in ident.tolist():
                    new.append(h not in seen)
                    seen.add(h)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(np.array(new) * bands.shape[1])]).astype(np.int32)),
                    pa.array(bands[new].ravel().view(np.int32)),
                )
                longs = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, sig.shape[1], dtype=np.int32)), pa.array(sig.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(keep)), pa.array(ident), pa.array([len(x) for x in sets], pa.int32()), longs, lists],
                    names=["id", "h", "n", "sig", "bands"],
                )

    usable = texts.where(F.col(key).isNotNull() & F.col(text).isNotNull() & (F.length(text) >= 2 * least - 1))
    return usable.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, h long, n int, sig array<long>, bands array<int>"
    )


def _estimate(a: Column, b: Column) -> Column:
    """The similarity of two signatures: the share of equal positions, less what chance makes equal."""
    same = F.lit(0)
    ones = int("01" * 32, 2) if BITS == 2 else -1
    for k in range(HASHES * BITS // 64):
        x = a[k].bitwiseXOR(b[k])
        if BITS == 2:  # a position differs if either of its bits does
            x = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(ones))
        same = same + (F.lit(64 // BITS) - F.bit_count(x))
    chance = 2.0**-BITS
    return (same / HASHES - chance) / (1 - chance)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, hot: pairs of word sets that share a key, of rows (k, h) in order; for a key of more than HOT sets its (k, h)."""

    def pairs(k: np.ndarray, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        sizes = np.diff(np.append(starts, len(k)))
        many = np.repeat(sizes > HOT, sizes)
        if many.any():
            yield rows(k[many], h[many], True)
            k, h = k[~many], h[~many]
        at, d = np.arange(len(k)), 1
        while len(at):
            at = at[at + d < len(k)]
            at = at[k[at] == k[at + d]]
            if len(at):
                yield rows(h[at], h[at + d], False)
            d += 1

    def rows(a: np.ndarray, b: np.ndarray, hot: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), hot))], names=["a", "b", "hot"])

    held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last key so far
    now, size, many = None, 0, False
    for b in batches:
        if not b.num_rows:
            continue
        k, h = b.column(0).to_numpy(), b.column(1).to_numpy()
        first = int(np.searchsorted(k, now, side="right")) if now is not None else 0
        if many and first:  # the held key is known to be hot, and its rows are passed on
            yield rows(k[:first], h[:first], True)
            k, h = k[first:], h[first:]
        if not len(k):
            continue
        last = int(np.searchsorted(k, k[-1]))
        if last:  # the held key is complete
            yield from pairs(np.concatenate([x[0] for x in held] + [k[:last]]), np.concatenate([x[1] for x in held] + [h[:last]]))
            held, size, many = [], 0, False
        elif held and k[-1] != now:
            yield from pairs(*(np.concatenate(x) for x in zip(*held)))
            held, size, many = [], 0, False
        elif k[-1] != now:
            many = False
        now = k[-1]
        held.append((k[last:], h[last:]))
        size += len(k) - last
        if size > HOT:
            many = True
            for x, y in held:
                yield rows(x, y, True)
            held, size = [], 0
    if held:
        yield from pairs(*(np.concatenate(x) for x in zip(*held)))


def _hot_pairs(rows: DataFrame, threshold: float, enough: float) -> DataFrame:
    """ia, ib: pairs of word sets of the same band that could reach the threshold; ``rows``: k, parts, h, id, n, sig."""
    own = F.pmod(F.xxhash64("h"), F.col("parts").cast("long")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    grid = rows.withColumn("own", own).select("k", "own", other.alias("other"), "id", "n", "sig")
    grid = grid.select("k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right"), "id", "n", "sig")

    def compare(k: tuple, held: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        right, ids, n, sig = (np.concatenate(x) for x in zip(*held))
        left = ~right if k[1] != k[2] else np.ones(len(ids), dtype=bool)
        other = right if k[1] != k[2] else left
        a, b = np.flatnonzero(left), np.flatnonzero(other)
        ones = np.uint64(int("01" * 32, 2))
        for at in range(0, len(a), 64):
            p = a[at : at + 64]
            differ = np.zeros((len(p), len(b)), dtype=np.int32)
            for w in range(sig.shape[1]):
                x = sig[p, w][:, None] ^ sig[b, w][None, :]
                if BITS == 2:
                    x = (x | (x >> np.uint64(1))) & ones
                differ += np.bitwise_count(x)
            same = 1 - differ / HASHES
            chance = 2.0**-BITS
            small, large = np.minimum(n[p][:, None], n[b]), np.maximum(n[p][:, None], n[b])
            keep = ((same - chance) / (1 - chance) >= enough) & (small >= large * threshold - 1e-9)
            if k[1] == k[2]:
                keep &= ids[p][:, None] < ids[b][None, :]
            r, c = np.nonzero(keep)
            if len(r):
                yield pa.RecordBatch.from_arrays([pa.array(ids[p[r]]), pa.array(ids[b[c]])], names=["ia", "ib"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            k, i, j, ids, n = (batch.column(c).to_numpy() for c in (0, 1, 2, 4, 5))
            right = batch.column(3).to_numpy(zero_copy_only=False)
            sig = batch.column(6).flatten().to_numpy().reshape(len(k), -1).view(np.uint64)
            cuts = (np.flatnonzero((np.diff(k) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)) + 1).tolist()
            for s, e in zip([0, *cuts], [*cuts, len(k)]):
                if (k[s], i[s], j[s]) != now:
                    if held:
                        yield from compare(now, held)
                    now, held = (k[s], i[s], j[s]), []
                held.append((right[s:e], ids[s:e], n[s:e], sig[s:e]))
        if held:
            yield from compare(now, held)

    met = grid.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j").mapInArrow(run, "ia long, ib long")
    return met.select(F.least("ia", "ib").alias("ia"), F.greatest("ia", "ib").alias("ib")).distinct()


def links(spark: SparkSession, texts: DataFrame, key: str, text: str, threshold: float, least: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of representatives of differing word sets whose similarity reaches the threshold; and id, rep of all."""
    stage = Stage(spark, "minhash")
    hashed = stage.cut(_hashed(texts, key, text, least))
    firsts = hashed.groupBy("h").agg(F.min("id").alias("rep"))
    members = hashed.select("id", "h").distinct().join(firsts, "h").select("id", "rep")
    sets = stage.cut(hashed.groupBy("h").agg(F.min(F.struct("id", "n", "sig")).alias("s"), F.max("bands").alias("bands")).select("h", "s.*", "bands"))
    bands = sets.select("h", F.posexplode("bands").alias("band", "v"))
    keyed = bands.select((F.shiftleft(F.col("band").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias("k"), "h")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), sets.count() * (HASHES // ROWS) // PER_TASK)
    seen = stage.cut(keyed.repartition(tasks, "k").sortWithinPartitions("k", "h").mapInArrow(_meet, "a long, b long, hot boolean"))
    met = seen.where("not hot").select(F.col("a").alias("ha"), F.col("b").alias("hb")).distinct()
    hot = seen.where("hot").select(F.col("a").alias("k"), F.col("b").alias("h"))
    sigs = sets.select("h", F.struct("id", "n", "sig").alias("s"))
    chance = threshold + (1 - threshold) * 2.0**-BITS
    error = math.sqrt(chance * (1 - chance) / HASHES) / (1 - 2.0**-BITS)
    enough = threshold - SLACK * error
    one = met.join(sigs.select(F.col("h").alias("ha"), F.col("s").alias("sa")), "ha")
    two = one.join(sigs.select(F.col("h").alias("hb"), F.col("s").alias("sb")), "hb")
    small, large = F.least("sa.n", "sb.n"), F.greatest("sa.n", "sb.n")
    likely = two.where((small >= large * threshold - 1e-9) & (_estimate(F.col("sa.sig"), F.col("sb.sig")) >= enough))
    likely = likely.select(F.least("sa.id", "sb.id").alias("ia"), F.greatest("sa.id", "sb.id").alias("ib"))
    if not hot.isEmpty():
        parts = hot.groupBy("k").agg(F.ceil(F.count("*") / HOT).cast("int").alias("parts"))
        likely = likely.unionByName(_hot_pairs(hot.join(parts, "k").join(sets.select("h", "id", "n", "sig"), "h"), threshold, enough)).distinct()
    likely = stage.cut(likely)
    # the words of the texts that are left, as hashes of 64 bits
    asked = likely.select(F.explode(F.array("ia", "ib")).alias("id")).distinct()
    again = texts.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(asked, "id", "left_semi")

    def word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [[_hashes[w] for w in words(t)] for t in b.column(1).to_pylist()]
            flat = np.array([x for s in sets for x in s], dtype=np.uint64).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "w"])

    held = again.mapInArrow(word_hashes, "id long, w array<long>").groupBy("id").agg(F.min("w").alias("w"))
    held = stage.cut(held)
    wa, wb = held.select(F.col("id").alias("ia"), F.col("w").alias("wa")), held.select(F.col("id").alias("ib"), F.col("w").alias("wb"))
    both = F.size(F.array_intersect("wa", "wb"))
    sure = likely.join(wa, "ia").join(wb, "ib").where(both >= F.lit(threshold) * (F.size("wa") + F.size("wb") - both) - 1e-9)
    return sure.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b")), members


def pairs(spark: SparkSession, texts: DataFrame, key: str, text: str, threshold: float = 0.7, least: int = 24) -> DataFrame:
    """a, b (a < b): every pair of keys whose texts are similar, copies among them.

    Texts of fewer than ``least`` distinct words, null texts and null keys take no part. A key that occurs again counts
    once. Band candidates find a pair of similarity s with probability 1 - (1 - s^ROWS)^(HASHES/ROWS).
    """
    stage = Stage(spark, "pairs")
    found, members = links(spark, texts, key, text, threshold, least)
    members, found = stage.cut(members), stage.cut(found)
    own = members.select("rep", F.col("id").alias("x"))
    copies = own.join(members.select("rep", F.col("id").alias("y")), "rep").where("x < y").select("x", "y")
    across = found.join(own, found["a"] == own["rep"]).select("b", "x").join(members.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b").select("x", "y")
    return copies.unionByName(across).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def groups(spark: SparkSession, texts: DataFrame, key: str, text: str, threshold: float = 0.7, least: int = 24) -> DataFrame:
    """id, group, links: every text that takes part, the smallest id of its group, and its links to differing word sets."""
    stage = Stage(spark, "groups")
    found, members = links(spark, texts, key, text, threshold, least)
    found = stage.cut(found)
    roots = components(spark, found).select(F.col("node").alias("rep"), "root")
    degree = found.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(roots, "rep", "left").join(degree, "rep", "left").select(
        "id", F.coalesce("root", "rep").alias("group"), F.coalesce("links", F.lit(0).cast("long")).alias("links")
    )
