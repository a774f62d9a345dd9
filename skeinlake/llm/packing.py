"""Filling of containers of fixed capacity, by pattern packing.

Sizes are at most the capacity, so the histogram of sizes has a bounded number of rows however many items there are; it is
all that reaches the driver. Patterns of few items that fill a container are enumerated, their repeat counts are fitted to
the histogram by non-negative least squares and rounded down, and what the rounding leaves is packed on the histogram,
largest first. The result is a table of ranges: the r-th item of a size belongs to a container that follows from r. Items
are ranked within (size, salt), so no size, however common, is ranked by one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..staging import Stage

#: Items that one task ranks, about; and tasks at most for a size, which bounds the histogram's rows for each size.
PER_TASK, SALTS = 200_000, 512
#: Sizes that patterns combine with each largest item, as quantiles of the items, and how often one may recur.
QUANTILES, REPEATS = 24, 6
ROUNDS = 200


def patterns(h: np.ndarray) -> np.ndarray:
    """Rows of (a, b, times, d): one item of size a, ``times`` of size b, one of size d or none, filling the capacity.

    a is every size that occurs, b the quantiles of the items' sizes, d the largest size that occurs and fits.
    """
    cap = len(h) - 1
    sizes = np.flatnonzero(h)
    share = np.cumsum(h[sizes]) / h[sizes].sum()
    b = np.unique(sizes[np.searchsorted(share, (np.arange(QUANTILES) + 0.5) / QUANTILES).clip(0, len(sizes) - 1)])
    grid = np.stack(np.meshgrid(sizes, b, np.arange(REPEATS + 1), indexing="ij"), -1).reshape(-1, 3)
    rest = cap - grid[:, 0] - grid[:, 1] * grid[:, 2]
    grid, rest = grid[rest >= 0], rest[rest >= 0]
    below = np.searchsorted(sizes, rest, side="right") - 1
    d = np.where(below >= 0, sizes[below.clip(0)], 0)
    rows = np.column_stack([grid, d])
    rows[rows[:, 2] == 0, 1] = 0
    filled = rows[:, 0] + rows[:, 1] * rows[:, 2] + rows[:, 3]
    return np.unique(rows[filled >= cap - max(1, cap // 256)], axis=0)


def fit(rows: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 of the patterns with the least squares of (items used - h), by multiplicative steps."""
    n = len(h)
    a, b, t, d = rows.T
    w = h.astype(float)
    w[0] = 0
    of = lambda v: v[a] + t * v[b] + v[d]
    use = lambda x: np.bincount(a, x, n) + np.bincount(b, x * t, n) + np.bincount(d, x, n)
    top = of(w)
    x = np.full(len(rows), max(1e-9, w.sum() / max(1, len(rows)) / 3))
    for _ in range(ROUNDS):
        used = use(x)
        used[0] = 0
        x *= top / np.maximum(of(used), 1e-12)
    return x


def plan(h: np.ndarray) -> tuple[list[tuple[int, int, int, int]], int]:
    """(size, first rank, items in each container, first container) for every range of items; the number of containers.

    h[s] is the number of items of size s; the last index is the capacity.
    """
    h, cap = h.astype(np.int64).copy(), len(h) - 1
    h[0] = 0
    next_rank, ranges, containers = np.zeros(cap + 1, dtype=np.int64), [], 0

    def emit(parts: dict[int, int], times: int) -> None:
        nonlocal containers
        for s, m in parts.items():
            ranges.append((s, int(next_rank[s]), m, containers))
            next_rank[s] += m * times
            h[s] -= m * times
        containers += times

    if h[cap]:
        emit({cap: 1}, int(h[cap]))
    if h.any() and len(rows := patterns(h)):
        x = np.floor(fit(rows, h) + 1e-9).astype(np.int64)
        for k in np.argsort(-x, kind="stable"):
            if not x[k]:
                break
            parts: dict[int, int] = {}
            a, b, t, d = rows[k].tolist()
            for s, m in ((a, 1), (b, t), (d, 1)):
                if s and m:
                    parts[s] = parts.get(s, 0) + m
            if times := min(int(x[k]), *(int(h[s]) // m for s, m in parts.items())):
                emit(parts, times)
    while h.any():  # each round uses up a size, so there are few
        parts, rest = {}, cap
        left = h.copy()
        while rest and len(fits := np.flatnonzero(left[: rest + 1])):
            s = int(fits[-1])
            m = min(int(left[s]), rest // s)
            parts[s] = parts.get(s, 0) + m
            left[s] -= m
            rest -= m * s
        emit(parts, max(1, min(int(h[s]) // m for s, m in parts.items())))
    return ranges, containers


def pack(spark: SparkSession, sized: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens", salts: int = SALTS) -> DataFrame:
    """``key``, part, first_token, n_tokens, container: where each part of each row of ``sized`` (key, size) goes.

    A row within the capacity is one part; a larger one is divided into full containers and a rest. A row of size 0 or
    null takes no room: it is returned with size 0 and a null container. Repeated rows are items of their own. Containers
    are numbered from 0 without gaps.
    """
    stage = Stage(spark, "packing")
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    parts = sized.select(F.col(key), n.alias("_n"), F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity) - 1, F.lit(0)).cast("int"))).alias("part"))
    items = parts.select(
        key, "part", (F.col("part") * F.lit(capacity).cast("long")).alias("first_token"),
        F.least(F.col("_n") - F.col("part") * F.lit(capacity).cast("long"), F.lit(capacity)).alias("n_tokens"),
    )
    items = stage.cut(items)
    salts = int(min(salts, 1 + items.count() // PER_TASK))
    items = items.withColumn("_salt", F.pmod(F.xxhash64(key, "part"), F.lit(salts)).cast("int"))
    counts = items.groupBy("n_tokens", "_salt").count().toPandas()  # at most (capacity + 1) * salts rows
    table = np.zeros((capacity + 1, salts), dtype=np.int64)
    table[counts["n_tokens"], counts["_salt"]] = counts["count"]
    ranges, _ = plan(table.sum(1))
    offsets = np.cumsum(table, axis=1) - table
    order = np.lexsort(([r[1] for r in ranges], [r[0] for r in ranges])) if ranges else []
    sorted_ranges = np.array(ranges, dtype=np.int64).reshape(-1, 4)[order] if ranges else np.zeros((0, 4), dtype=np.int64)
    # one row for each size in each pattern that is used: bounded by the patterns, which the capacity bounds
    shared = spark.sparkContext.broadcast((sorted_ranges, offsets))
    ranked = items.where("n_tokens > 0").withColumn(
        "_rank", F.row_number().over(Window.partitionBy("n_tokens", "_salt").orderBy(key, "part")).cast("long")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, offsets), names = shared.value, [key, "part", "first_token", "n_tokens", "container"]
        step = np.int64(1) << 44
        coded = table[:, 0] * step + table[:, 1]
        for b in batches:
            size, salt, rank = (b.column(k).to_numpy() for k in (3, 4, 5))
            r = offsets[size, salt] + rank - 1
            at = np.searchsorted(coded, size * step + r, side="right") - 1
            box = table[at, 3] + (r - table[at, 1]) // table[at, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(box)], names=names)

    kind = sized.schema[key].dataType.simpleString()
    placed = ranked.select(key, "part", "first_token", "n_tokens", "_salt", "_rank").mapInArrow(
        place, f"`{key}` {kind}, part int, first_token long, n_tokens long, container long"
    )
    return placed.unionByName(
        items.where("n_tokens = 0").select(key, "part", "first_token", "n_tokens", F.lit(None).cast("long").alias("container"))
    )
