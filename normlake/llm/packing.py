"""Items put into containers of fixed capacity by linear grouping.

Sizes are whole numbers up to the capacity, so all that the plan needs is how
many items there are of each size: a table bounded by the capacity, whatever the
number of items. The plan is made on the driver from that table. Large sizes are
rounded up within groups of equal cardinality; the configurations of the few
rounded sizes are optimised as a linear program by column generation; the actual
sizes are put in their place, and the small ones go where they fit best. The
result is a bounded table of intervals (size, ranks, containers) against which
every item, ranked within its size, finds its container.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normlake.plans.runtime import cut

#: Groups of large sizes, and the part of the capacity from which a size is large.
GROUPS, LARGE = 40, 1 / 8
#: Slices in which the items of one size are ranked, so that no size has to fit into one task.
SLICES = 64
#: Columns generated at most; the plan is right at any number.
MAX_COLUMNS = 400


def linear_groups(counts: dict[int, int], least: int, groups: int) -> list[list[tuple[int, int]]]:
    """Large sizes in descending order, cut into groups of equal cardinality: runs (size, count)."""
    sizes = sorted((s for s in counts if s >= least and counts[s]), reverse=True)
    total = sum(counts[s] for s in sizes)
    each = max(1, -(-total // groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for s in sizes:
        n = counts[s]
        while n:
            if not room:
                out.append([])
                room = each
            take = min(n, room)
            out[-1].append((s, take))
            n -= take
            room -= take
    return out


def best_configuration(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The multiset of sizes within the capacity of the greatest value (unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    low = int(sizes.min())
    for c in range(low, capacity + 1):
        fit = np.nonzero(sizes <= c)[0]
        gain = best[c - sizes[fit]] + values[fit]
        k = int(gain.argmax())
        if gain[k] > best[c - 1] + 1e-12:
            best[c], pick[c] = gain[k], fit[k]
        else:
            best[c] = best[c - 1]
    out = np.zeros(len(sizes), dtype=np.int64)
    c = capacity
    while c >= low:
        if pick[c] < 0:
            c -= 1
            continue
        out[pick[c]] += 1
        c -= int(sizes[pick[c]])
    return out, float(best[capacity])


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and how often each is used, rounded down from the linear program's optimum."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    for _ in range(MAX_COLUMNS):
        inverse = np.linalg.inv(basis)
        x = inverse @ demand
        column, value = best_configuration(sizes, np.maximum(np.ones(k) @ inverse, 0), capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = column
    x = np.linalg.inv(basis) @ demand
    return [(basis[:, j].astype(np.int64), int(np.floor(x[j] + 1e-6))) for j in range(k) if x[j] >= 1 - 1e-6]


class _Plan:
    """Containers by free space, in runs of consecutive containers, and where the items of each size go."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.opened = capacity, 0
        self.used: dict[int, int] = {}
        self.intervals: list[tuple[int, int, int, int]] = []  # size, first rank, first container, length
        self.free: dict[int, list[tuple[int, int]]] = {}
        self.order: list[int] = []

    def place(self, size: int, container: int, n: int) -> None:
        first = self.used.get(size, 0)
        self.intervals.append((size, first, container, n))
        self.used[size] = first + n

    def add(self, free: int, container: int, n: int) -> None:
        if n and free:
            if free not in self.free:
                insort(self.order, free)
            self.free.setdefault(free, []).append((container, n))

    def open(self, n: int) -> int:
        first, self.opened = self.opened, self.opened + n
        return first

    def best_fit(self, size: int, n: int) -> None:
        """Items of one size, each into the fullest container with room."""
        while n:
            i = bisect_left(self.order, size)
            if i == len(self.order):
                new = -(-n // (self.capacity // size))
                self.add(self.capacity, self.open(new), new)
                continue
            free = self.order[i]
            container, length = self.free[free].pop()
            take = min(n, length)
            if take < length:
                self.free[free].append((container + take, length - take))
            if not self.free[free]:
                del self.free[free]
                self.order.pop(i)
            self.place(size, container, take)
            self.add(free - size, container, take)
            n -= take


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS, large: float = LARGE) -> tuple[list[tuple[int, int, int, int]], int]:
    """Intervals (size, first rank, first container, length) for all items, and the number of containers."""
    out = _Plan(capacity)
    rest = {s: n for s, n in counts.items() if 0 < s <= capacity and n}
    grouped = linear_groups(rest, max(1, int(capacity * large)), groups)
    if grouped:
        # Equal rounded sizes are one size with their demand together.
        merged: dict[int, list[tuple[int, int]]] = {}
        for runs in grouped:
            merged.setdefault(runs[0][0], []).extend(runs)
        tops = np.array(sorted(merged, reverse=True), dtype=np.int64)
        queues = [merged[int(t)][::-1] for t in tops]
        demand = np.array([sum(n for _, n in q) for q in queues], dtype=float)
        for config, times in configurations(tops, demand, capacity):
            left = np.array([sum(n for _, n in q) for q in queues])
            slots = np.nonzero(config)[0]
            times = min([times, *(int(left[g] // config[g]) for g in slots)])
            if times <= 0:
                continue
            first = out.open(times)
            used = [(0, times, 0)]  # from, to, filled
            for g in slots:
                for _ in range(int(config[g])):
                    at, taken = 0, []
                    while at < times:
                        s, n = queues[g].pop()
                        take = min(n, times - at)
                        if take < n:
                            queues[g].append((s, n - take))
                        out.place(s, first + at, take)
                        rest[s] -= take
                        taken.append((at, at + take, s))
                        at += take
                    used = _overlay(used, taken)
            for a, b, filled in used:
                out.add(capacity - filled, first + a, b - a)
    for s in sorted(rest, reverse=True):
        out.best_fit(s, rest[s])
    return out.intervals, out.opened


def _overlay(a: list[tuple[int, int, int]], b: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Sum of two step functions over the same range, given as (from, to, value)."""
    out, i, j, at = [], 0, 0, a[0][0]
    while i < len(a) and j < len(b):
        to = min(a[i][1], b[j][1])
        value = a[i][2] + b[j][2]
        if out and out[-1][2] == value:
            out[-1] = (out[-1][0], to, value)
        else:
            out.append((at, to, value))
        i, j, at = i + (a[i][1] == to), j + (b[j][1] == to), to
    return out


def pack(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece, start, n_tokens, container) of every item.

    An item within the capacity is one piece, 0. A larger one is cut into full
    pieces and a rest, only then. Items of size 0 or null take no room and come
    out in no container (null). Keys may repeat; each row is an item. An empty table
    gives no rows.
    """
    spark = sizes.sparkSession
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    count = F.greatest(F.lit(1), F.ceil(n / capacity)).cast("int")
    pieces = sizes.select(key, n.alias("n"), F.explode(F.sequence(F.lit(0), count - 1)).alias("piece")).select(
        key,
        "piece",
        (F.col("piece").cast("long") * capacity).alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece").cast("long") * capacity).alias("n_tokens"),
    )
    items = cut(pieces.withColumn("slice", F.pmod(F.xxhash64(key, "piece"), F.lit(SLICES)).cast("int")))
    # capacity * SLICES rows at most.
    cells = items.where("n_tokens > 0").groupBy("n_tokens", "slice").agg(F.count(F.lit(1)).alias("n")).toPandas()
    counts = cells.groupby("n_tokens")["n"].sum().astype(int).to_dict()
    intervals, _ = plan({int(s): int(c) for s, c in counts.items()}, capacity)
    table = np.array(sorted(intervals), dtype=np.int64).reshape(-1, 4)
    cells = cells.sort_values(["n_tokens", "slice"])
    cells["first"] = cells.groupby("n_tokens")["n"].cumsum() - cells["n"]
    firsts = np.zeros((capacity + 1, SLICES), dtype=np.int64)
    firsts[cells["n_tokens"].to_numpy(dtype=int), cells["slice"].to_numpy(dtype=int)] = cells["first"].to_numpy(dtype=np.int64)
    # Rank and size in one number; a size has fewer than 2**44 items.
    starts = (table[:, 0] << 44) | table[:, 1]
    shared = spark.sparkContext.broadcast((starts, table[:, 2] - table[:, 1], firsts))

    @F.pandas_udf("long")
    def container(it: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        starts, shift, firsts = shared.value
        for s, piece, place in it:
            s, place = s.to_numpy(dtype=np.int64), place.to_numpy(dtype=np.int64)
            rank = firsts[s, piece.to_numpy(dtype=np.int64)] + place
            out = np.zeros(len(s), dtype=np.int64)
            some = s > 0
            at = np.searchsorted(starts, (s[some] << 44) | rank[some], side="right") - 1
            out[some] = shift[at] + rank[some]
            yield pd.Series(out).astype("Int64").where(some)

    order = Window.partitionBy("n_tokens", "slice").orderBy(key, "piece")
    placed = items.withColumn("place", F.row_number().over(order) - 1)
    return placed.select(key, "piece", "start", "n_tokens", container("n_tokens", "slice", "place").alias("container"))
