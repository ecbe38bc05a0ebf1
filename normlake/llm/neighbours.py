"""The most similar vectors of every vector, by score-aware quantisation.

Every vector is coded: the nearest of some base centres, and its residual with
four bits a value, the codes chosen and the code books fitted under a loss that
weighs the error parallel to the vector more than the error across it, since
that one moves large inner products. The vectors of a part are put into cells of
about UNIT rows, so there are as many cells as the rows ask for, and each vector
asks the cells nearest to it. Every cell is scanned through look-up tables of its
codes, whatever its size; what scores within the error of the codes of the least
cosine, and of the best hits, is ranked by the exact cosine. The quantisers are
fitted on a bounded sample; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normlake.plans.runtime import lookup_join, partitions, stored

#: Neighbours of each vector, and the cosine from which they count.
NEIGHBOURS, LEAST_COSINE = 5, 0.80
#: Vectors from which the quantisers are fitted, and base centres of the codes.
SAMPLE, BASES = 20_000, 64
#: Rows of a cell, about. Larger parts have FANOUT ** level cells, the least level that brings their cells
#: below UNIT; up to level DEPTH cells are told by centres, beyond by those and centres of the residuals.
UNIT, FANOUT, DEPTH = 16_384, 8, 4
#: Cells a vector asks at a level: those of the first levels, and the growth from there on. Measured on 4,000
#: isolated pairs of cosine 0.81 in random directions: from one side or the other 99.97, 99.9, 99.5 and 99.5 of
#: 100 are found at levels 1 to 4. A sample of 20,000 gives level 4 some 2,500 centres, not 4,096.
ASKED, ASKED_GROWTH = (1, 6, 18, 40, 90), 2.2
#: Rows and queries of one step of a scan, which keep its tables in the processor's cache.
TILE, CHUNK = 512, 256
#: Weight of the parallel error: inner products from this share of the norm matter.
THRESHOLD = 0.2
ROUNDS = 6


def usable(size: int) -> str:
    """SQL condition on column vec: non-null, of the right size, finite, not all zero."""
    return f"vec is not null and size(vec) = {size} and forall(vec, x -> x is not null and not isnan(x) and abs(x) < float('infinity')) and exists(vec, x -> x <> 0)"


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one, safe for very small and very large values."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)


def _centres(x: np.ndarray, count: int, rng: np.random.Generator, sphere: bool = True) -> np.ndarray:
    """Centres by k-means, of length one on the sphere; at most one for every eight vectors."""
    count = max(1, min(count, len(x) // 8))
    centres = x[rng.permutation(len(x))[:count]].copy()
    for _ in range(ROUNDS):
        near = _nearest(x, centres) if sphere else _closest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True) if sphere else np.bincount(near, minlength=count)[:, None].astype(np.float32)
        centres = np.where(size > 1e-6, sums / np.maximum(size, 1e-6), centres).astype(np.float32)
    return centres


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(1) for i in range(0, len(x), 4096)])


def level_of(rows: int) -> int:
    """The least level at which a part of so many rows has cells below UNIT on average."""
    level = 0
    while rows > UNIT * FANOUT**level:
        level += 1
    return level


@dataclass
class Quantiser:
    """Base centres (BASES x d), code books (d x 16) of the residuals, the error of the codes, and the centres of the cells by level."""

    bases: np.ndarray
    books: np.ndarray
    eta: float
    slack: float = 0.1
    cells: dict[int, np.ndarray] = field(default_factory=dict)
    finer: dict[int, np.ndarray] = field(default_factory=dict)
    depth: int = DEPTH

    @classmethod
    def fit(cls, sample: np.ndarray, levels: int = 0, seed: int = 11) -> Quantiser:
        """Spherical k-means, then code books by alternating anisotropic assignment and update."""
        rng = np.random.default_rng(seed)
        x = sample.astype(np.float32)
        n, d = x.shape
        bases = _centres(x, BASES, rng)
        # Relative weight of parallel to orthogonal error for inner products above THRESHOLD.
        eta = (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)
        few = x[rng.permutation(n)[: min(n, 8192)]]
        base = bases[_nearest(few, bases)]
        r = few - base
        # Sixteen quantiles of each residual to begin with.
        books = np.quantile(r, (np.arange(16) + 0.5) / 16, axis=0).T.astype(np.float32)
        out = cls(bases, np.ascontiguousarray(books), max(1.0, float(eta)), depth=DEPTH)
        for _ in range(ROUNDS):
            out._update(few, r, out.encode(few, base))
        # How far a score is off for a query at the least cosine, at worst in the sample, and half as much again.
        across = rng.normal(size=few.shape).astype(np.float32)
        across -= (across * few).sum(1, keepdims=True) * few
        across /= np.maximum(np.linalg.norm(across, axis=1, keepdims=True), 1e-6)
        query = LEAST_COSINE * few + np.sqrt(1 - LEAST_COSINE**2) * across
        decoded = base + out.decode(out.encode(few, base))
        out.slack = float(1.5 * np.abs((query * (few - decoded)).sum(1)).max()) + 1e-3
        for level in range(1, min(levels, DEPTH) + 1):
            out.cells[level] = _centres(x, FANOUT**level, rng)
        if levels > DEPTH:
            rest = x - out.cells[DEPTH][_nearest(x, out.cells[DEPTH])]
            for level in range(1, min(levels - DEPTH, DEPTH) + 1):
                out.finer[level] = _centres(rest, FANOUT**level, rng, sphere=False)
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.take_along_axis(self.books[None], codes[:, :, None].astype(np.intp), 2)[:, :, 0]

    def encode(self, x: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Codes (n x d) that minimise the anisotropic loss: nearest first, then by coordinate descent."""
        n, d = x.shape
        r = (x - base).astype(np.float32)
        codes = np.empty((n, d), dtype=np.uint8)
        parallel = np.zeros(n, dtype=np.float32)
        rows = np.arange(n)
        for sweep in range(2):
            for s in range(d):
                error = r[:, s, None] - self.books[s][None]
                along = error * x[:, s, None]
                loss = error**2
                if sweep:
                    parallel = parallel - along[rows, codes[:, s]]
                    loss = loss + (self.eta - 1) * (parallel[:, None] + along) ** 2
                codes[:, s] = loss.argmin(1)
                parallel = parallel + along[rows, codes[:, s]]
        return codes

    def _update(self, x: np.ndarray, r: np.ndarray, codes: np.ndarray) -> None:
        """The code book values of least loss for the given codes, one dimension at a time."""
        decoded = np.take_along_axis(self.books[None], codes[:, :, None].astype(np.intp), 2)[:, :, 0]
        along = (r - decoded) * x
        total = along.sum(1)
        for s in range(x.shape[1]):
            rest = total - along[:, s]
            u, t = x[:, s], r[:, s]
            weight = 1 + (self.eta - 1) * u * u
            goal = t * weight + (self.eta - 1) * rest * u
            below = np.bincount(codes[:, s], weight, 16)
            above = np.bincount(codes[:, s], goal, 16)
            self.books[s] = np.where(below > 0, above / np.maximum(below, 1e-12), self.books[s])
            fresh = (t - self.books[s][codes[:, s]]) * u
            total = rest + fresh
            along[:, s] = fresh

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Look-up tables (bytes of a code x 256 x queries): the score of each byte; the first is the base, the others are two codes each."""
        t = (q.T[:, None, :] * self.books[:, :, None]).astype(np.float32)
        if len(t) % 2:
            t = np.concatenate([t, np.zeros_like(t[:1])])
        low, high = t[0::2], t[1::2]
        pairs = (high[:, :, None, :] + low[:, None, :, :]).reshape(len(low), 256, len(q))
        base = np.zeros((1, 256, len(q)), dtype=np.float32)
        base[0, : len(self.bases)] = self.bases @ q.T
        return np.concatenate([base, pairs])

    def code(self, x: np.ndarray) -> np.ndarray:
        """The bytes of a row: its base, then two codes a byte."""
        own = _nearest(x, self.bases)
        codes = self.encode(x, self.bases[own])
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
        return np.concatenate([own[:, None].astype(np.uint8), codes[:, 0::2] | (codes[:, 1::2] << 4)], 1)

    def nearest_cells(self, x: np.ndarray, level: int) -> np.ndarray:
        """The cells that rows ask at a level (n x count), the nearest, in which they stand, first."""
        if level == 0:
            return np.zeros((len(x), 1), dtype=np.int64)
        top = min(level, self.depth)
        score = x @ self.cells[top].T
        first = _leading(score, ASKED[top])
        if level <= self.depth:
            return first
        fine = self.finer[min(level - self.depth, self.depth)]
        half = (fine**2).sum(1) / 2
        count = int(ASKED[self.depth] * ASKED_GROWTH ** (level - self.depth))
        best = np.take_along_axis(score, first, 1)
        n = len(fine)
        found = np.empty((len(x), min(count, first.shape[1] * n)), dtype=np.int64)
        for i in range(len(x)):
            rest = (x[i] - self.cells[self.depth][first[i]]) @ fine.T - half
            all_ = (best[i][:, None] + rest).ravel()
            order = _leading(all_[None], found.shape[1])[0]
            # The own cell is the finest within the nearest centre, whatever the others score.
            own = int(rest[0].argmax())
            order = np.concatenate([[own], order[order != own]])[: found.shape[1]]
            found[i] = first[i][order // n] * n + order % n
        return found


def _leading(score: np.ndarray, count: int) -> np.ndarray:
    """The places of the largest values of each row, the largest first."""
    count = min(count, score.shape[1])
    best = np.argpartition(-score, count - 1, axis=1)[:, :count]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(score, best, 1), axis=1, kind="stable"), 1)


def scan(model: Quantiser, q: np.ndarray, base: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine) of the best rows of a cell for each query: table scan, then exact ranking.

    Rows are in order of their keys, and equal cosines keep that order. A row is
    ranked exactly if its score is within the error of the least cosine and, both
    ways, of the last score that would be kept: no number of rows is a limit.
    """
    found = []
    columns = np.ascontiguousarray(codes.T)
    for i in range(0, len(q), CHUNK):
        part = q[i : i + CHUNK]
        t = model.tables(part)
        buffer = np.empty((TILE, len(part)), dtype=np.float32)
        hits = []
        for lo in range(0, len(base), TILE):
            hi = min(lo + TILE, len(base))
            total = t[0][columns[0, lo:hi]]
            for j in range(1, len(columns)):
                total += np.take(t[j], columns[j, lo:hi], axis=0, out=buffer[: hi - lo], mode="clip")
            row, query = np.nonzero(total >= LEAST_COSINE - model.slack)
            hits.append((query, row + lo, total[row, query]))
        query, row, score = (np.concatenate(h) for h in zip(*hits, strict=True))
        order = np.lexsort((-score, query))
        query, row, score = query[order], row[order], score[order]
        start = np.searchsorted(query, np.arange(len(part)))
        size = np.diff(np.append(start, len(query)))
        last = np.full(len(part), -np.inf)
        many = size > NEIGHBOURS
        last[many] = score[start[many] + NEIGHBOURS]
        keep = score >= last[query] - 2 * model.slack
        query, row = query[keep], row[keep]
        exact = np.concatenate([np.einsum("ij,ij->i", part[query[k : k + 50_000]], base[row[k : k + 50_000]]) for k in range(0, len(query), 50_000)] or [np.zeros(0)])
        exact = np.round(exact, 12)
        good = exact >= LEAST_COSINE
        query, row, exact = query[good], row[good], exact[good]
        order = np.lexsort((row, -exact, query))
        query, row, exact = query[order], row[order], exact[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place <= NEIGHBOURS
        found.append((query[keep] + i, row[keep], exact[keep]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def fit_on(classes: DataFrame, levels: int, sample: int = SAMPLE) -> Quantiser:
    """The quantiser of classes(class, vec), from at most `sample` vectors in order of a hash."""
    n = classes.count()
    order = F.xxhash64("class", F.lit(3))
    # Half as many again as needed, so that no more than that is gathered from all tasks together.
    share = min(1.0, 1.5 * sample / max(1, n))
    few = classes.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)))
    rows = few.dropDuplicates(["class"]).select("vec").orderBy(order).limit(sample).toPandas()
    x = unit(np.array(rows["vec"].tolist(), dtype=np.float64).reshape(len(rows), -1))
    return Quantiser.fit(x, levels)


def _placed(rows: DataFrame, model: Quantiser) -> DataFrame:
    """(part, cell, role, key, class, vec, codes) of rows(part, level, place, key, class, vec).

    A row stands in its cell, with its codes; the first row of a class asks there,
    too (role 1 instead of 0), and asks the other near cells (role 2, no codes).
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x = unit(matrix(part.column(5))).astype(np.float32)
                level, asks = part.column(1).to_numpy(), part.column(2).to_numpy() == 1
                code = pa.array([c.tobytes() for c in m.code(x)], pa.binary())
                for l in np.unique(level):
                    at = np.nonzero(level == l)[0]
                    cells = m.nearest_cells(x[at], int(l))
                    own = part.take(pa.array(at))
                    role = np.where(asks[at], 1, 0).astype(np.int32)
                    yield _rows(own, cells[:, 0], role, code.take(pa.array(at)))
                    if cells.shape[1] > 1 and asks[at].any():
                        who = np.nonzero(asks[at])[0].repeat(cells.shape[1] - 1)
                        yield _rows(own.take(pa.array(who)), cells[asks[at], 1:].ravel(), np.full(len(who), 2, dtype=np.int32), pa.nulls(len(who), pa.binary()))

    def _rows(b: pa.RecordBatch, cell: np.ndarray, role: np.ndarray, code: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(cell), pa.array(role), b.column(3), b.column(4), b.column(5), code], names=["part", "cell", "role", "key", "class", "vec", "codes"])

    return rows.select("part", "level", "place", "key", "class", "vec").mapInArrow(run, "part string, cell long, role int, key string, class long, vec array<float>, codes binary")


def _search(placed: DataFrame, model: Quantiser, rows: int) -> DataFrame:
    """(class, key, cosine): the best rows of every asked cell for every asking class.

    A cell of far more than UNIT rows, as a tight set makes it, is cut into blocks.
    """
    spark = placed.sparkSession
    shared = spark.sparkContext.broadcast(model)
    keyed = placed.withColumn("c", F.xxhash64("part", "cell"))
    crowded = keyed.where("role < 2").groupBy("c").agg(F.ceil(F.count(F.lit(1)) / UNIT).cast("int").alias("blocks")).where("blocks > 2")
    cut_up = lookup_join(keyed, crowded, "c").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    every = F.explode(F.when(F.col("role") == 0, F.array(own)).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))).alias("block")
    spread = cut_up.select("c", "role", "key", "class", "vec", "codes", own.alias("own"), every)
    # In other blocks than its own a row only asks.
    role = F.when((F.col("role") == 1) & (F.col("block") != F.col("own")), 2).otherwise(F.col("role"))
    spread = spread.select("c", "block", (role == 2).alias("guest"), (role > 0).alias("asks"), "key", "class", "vec", "codes")
    met = spread.repartition(partitions(spark, rows, UNIT), "c", "block").sortWithinPartitions("c", "block", "guest", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        group: tuple | None = None
        held: list[pa.RecordBatch] = []
        ready: tuple | None = None

        def answer(x: np.ndarray, names: pa.Array) -> Iterator[pa.RecordBatch]:
            found_q, found_r, cosine = scan(m, x, ready[1], ready[2])
            if len(found_q):
                yield pa.RecordBatch.from_arrays([names.take(pa.array(found_q)), ready[0].take(pa.array(found_r)), pa.array(cosine)], names=["class", "key", "cosine"])

        def close() -> Iterator[pa.RecordBatch]:
            """Index the rows of a cell, and answer those of them that ask."""
            nonlocal ready
            if held:
                whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                x = unit(matrix(whole.column(6)))
                codes = np.frombuffer(b"".join(whole.column(7).to_pylist()), dtype=np.uint8).reshape(len(x), -1)
                ready = (whole.column(4), x, codes)
                asks = np.nonzero(whole.column(3).to_numpy(zero_copy_only=False))[0]
                held.clear()
                if len(asks):
                    yield from answer(x[asks], whole.column(5).take(pa.array(asks)))

        for batch in batches:
            c, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            guest = batch.column(2).to_numpy(zero_copy_only=False)
            edge = np.nonzero((c[1:] != c[:-1]) | (b[1:] != b[:-1]) | (guest[1:] != guest[:-1]))[0] + 1
            for lo, hi in zip(np.append(0, edge), np.append(edge, len(c)), strict=True):
                if lo == hi:
                    continue
                if group != (c[lo], b[lo]):
                    yield from close()
                    group, ready = (c[lo], b[lo]), None
                part = batch.slice(lo, hi - lo)
                if not guest[lo]:
                    held.append(part)
                    continue
                yield from close()
                if ready is not None:
                    yield from answer(unit(matrix(part.column(6))), part.column(5))
        yield from close()

    return met.mapInArrow(run, "class long, key string, cosine double")


def similar_pairs(vectors: DataFrame, size: int) -> DataFrame:
    """(part, key_a, key_b), key_a < key_b in byte order: one is among the NEIGHBOURS most similar of the other.

    vectors(part, key, vec) are compared within a part. Null keys or parts and
    unusable vectors (null, of another size, not finite, all zero) take no part.
    Ties of the cosine, rounded to twelve decimals, go to the smaller key. Equal
    vectors are searched once; of a group of equal vectors the NEIGHBOURS + 1
    smallest keys stand in the index, which suffice for any row's neighbours.
    Repeated rows count once; an empty table gives no rows.
    """
    good = vectors.where(F.col("key").isNotNull() & F.col("part").isNotNull()).where(usable(size)).select("part", "key", "vec")
    rows = stored(good.withColumn("class", F.xxhash64("part", "vec")).dropDuplicates(["part", "key"]))
    order = Window.partitionBy("class").orderBy("key")
    first = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= NEIGHBOURS + 1)
    level = F.lit(0)
    for step in range(2 * DEPTH):
        level = level + (F.col("n") > UNIT * FANOUT**step).cast("int")
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.max("n").alias("most"), F.sum("n").alias("rows")).first()
    if not total["rows"]:
        return rows.select("part", F.col("key").alias("key_a"), F.col("key").alias("key_b")).limit(0)
    levels = min(2 * DEPTH, level_of(total["most"]))
    if levels:
        first = lookup_join(first, counts.select("part", level.alias("level")), "part")
    else:
        first = first.withColumn("level", F.lit(0))
    model = fit_on(rows.select("class", "vec"), levels)
    placed = stored(_placed(first, model))
    found = _search(placed, model, total["rows"])
    # At most ASKED times blocks times NEIGHBOURS + 1 rows a query.
    ranked = F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("s"), F.col("key")))), 1, NEIGHBOURS + 1)
    best = stored(found.groupBy("class").agg(ranked.alias("best")))
    each = lookup_join(rows.select("part", "key", "class"), best, "class").where("best is not null")
    own = F.slice(F.filter("best", lambda x: x["key"] != F.col("key")), 1, NEIGHBOURS)
    pairs = each.select("part", "key", F.explode(own).alias("n")).select("part", F.least("key", "n.key").alias("key_a"), F.greatest("key", "n.key").alias("key_b"))
    return pairs.distinct()
