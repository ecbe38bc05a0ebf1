"""Sets of mutually similar vectors.

A vector is described by the sides of random hyperplanes on which it lies, a set
of tokens whose Jaccard similarity follows the angle. MinHash bands over these
sets bring likely neighbours into common buckets; the exact Jaccard similarity of
the token sets discards chance meetings and the exact cosine decides. That links
most of every large set. Then every pair of a part is compared, in blocks, of which
only the links between such groups come out, and how many similar ones a vector
has: no pair is left out, and large sets are not multiplied out. Connected
components make groups, and a group whose members are not all similar to its
medoid, the member of highest degree, is split around it, and what is left again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from normlake.llm.components import connected_components
from normlake.llm.neighbours import matrix, unit, usable
from normlake.plans.runtime import cut, lookup_join, partitions, stored

#: Cosine from which two vectors belong together, and least members of a set.
COSINE, LEAST_MEMBERS = 0.80, 3
#: Hyperplanes, bands and rows of a band. The bands link most of every large set; they bear only on how many
#: links the comparison of all pairs gives.
PLANES, BANDS, ROWS = 128, 16, 8
#: Jaccard similarity of the token sets below which a pair is dropped: a pair of cosine 0.80
#: agrees in 0.795 of the planes on average, here 0.67, three and a half deviations less.
LEAST_JACCARD = 0.50
#: Rows of bands matched in one task, about.
TASK_ROWS = 1_000_000
#: Rows of a block in that comparison, about, and how many of them meet a block at once. A row is sent once
#: for each block of its part.
BLOCK, STRIPE = 65_536, 128


def planes(size: int, seed: int = 5) -> np.ndarray:
    """The random hyperplanes, the same everywhere."""
    return np.random.default_rng(seed).normal(size=(size, PLANES)).astype(np.float32)


def orders(seed: int = 6) -> np.ndarray:
    """For each MinHash function the tokens in its order, up to the depth that practically always decides."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(2 * PLANES)[:40] for _ in range(BANDS * ROWS)])


def bands(sides: np.ndarray, parts: np.ndarray, order: np.ndarray, count: int) -> np.ndarray:
    """One hash a band (n x count) of vectors given by their sides (n x PLANES, boolean)."""
    present = np.concatenate([sides, ~sides], 1)
    out = np.empty((len(sides), count), dtype=np.uint64)
    for b in range(count):
        h = parts.view(np.uint64) + np.uint64(b * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for r in range(ROWS):
            tokens = order[b * ROWS + r]
            # The first present token of the order is the minimum.
            least = tokens[present[:, tokens].argmax(1)].astype(np.uint64)
            h = (h ^ least) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        out[:, b] = h
    return out


def candidate_pairs(vectors: DataFrame, size: int, count: int = BANDS) -> DataFrame:
    """(a, b), a < b, of vectors(part, content, vec): next to each other in a bucket of a band, and Jaccard similar token sets.

    A chain through each bucket, and not its pairs: the components it makes are
    those of all its similar pairs, but for places where a stranger stands
    between; all pairs are compared in full afterwards.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, order = planes(size), orders()
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                sides = unit(matrix(part.column(2))).astype(np.float32) @ h > 0
                band = bands(sides, part.column(0).to_numpy(), order, count)
                packed = np.packbits(sides, axis=1)
                n = len(sides)
                order_ = np.arange(n).repeat(count)
                tokens = pa.array([p.tobytes() for p in packed], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(band.ravel().view(np.int64)), part.column(1).take(pa.array(order_)), tokens.take(pa.array(order_))], names=["band", "content", "tokens"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy(), np.frombuffer(b"".join(b.column(2).to_pylist()), dtype=np.uint64).reshape(b.num_rows, -1)) for b in batches if b.num_rows]
        if not parts:
            return
        s, c, t = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        # In a bucket the order of the first sides brings alike members side by side.
        order = np.lexsort((c, t[:, 0].byteswap(), s))
        s, c, t = s[order], c[order], t[order]
        at = np.nonzero((s[1:] == s[:-1]) & (c[1:] != c[:-1]))[0]
        alike = PLANES - np.bitwise_count(t[at] ^ t[at + 1]).sum(1).astype(np.int64)
        # |A and B| = agreeing planes, |A or B| = 2 * PLANES - that.
        good = at[alike >= LEAST_JACCARD * (2 * PLANES - alike)]
        if len(good):
            both = np.unique(np.sort(np.stack([c[good], c[good + 1]], 1), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    described = vectors.select(F.xxhash64("part").alias("p"), "content", "vec").mapInArrow(describe, "band long, content long, tokens binary")
    tasks = partitions(vectors.sparkSession, vectors.count() * count, TASK_ROWS)
    return described.repartition(tasks, "band").mapInArrow(match, "a long, b long").distinct()


def cosine(x: str, y: str) -> F.Column:
    """Exact cosine of two array columns, in double precision."""
    as_double = lambda c: F.transform(c, lambda v: v.cast("double"))
    dot = lambda a, b: F.aggregate(F.zip_with(as_double(a), as_double(b), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    return dot(F.col(x), F.col(y)) / F.sqrt(dot(F.col(x), F.col(x)) * dot(F.col(y), F.col(y)))


def verified(pairs: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose vectors have the cosine."""
    a = vectors.select(F.col("content").alias("a"), F.col("vec").alias("va"))
    b = vectors.select(F.col("content").alias("b"), F.col("vec").alias("vb"))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                value = np.einsum("ij,ij->i", unit(matrix(batch.column(2))), unit(matrix(batch.column(3))))
                yield batch.select(["a", "b"]).filter(pa.array(value >= least))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "va", "vb").mapInArrow(similar, "a long, b long")


def _joining(x: np.ndarray, y: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of links x - y that join labels, no circles among them, and the labels afterwards; joined ones take their smallest."""
    held = [np.empty(0, dtype=np.int64)]
    at = np.arange(len(x))
    while len(at := at[labels[x[at]] != labels[y[at]]]):
        lo, hi = np.minimum(labels[x[at]], labels[y[at]]), np.maximum(labels[x[at]], labels[y[at]])
        own, first = np.unique(hi, return_index=True)
        held.append(at[first])
        to = np.arange(labels.max() + 1)
        to[own] = lo[first]
        while (further := to[to]).tolist() != to.tolist():
            to = further
        labels = to[labels]
    return np.concatenate(held), labels


def similar_within(vectors: DataFrame, least: float) -> DataFrame:
    """Every pair of vectors(part, content, grp, vec) of a part is compared: rows (a, b, 0) and (content, content, n).

    a and b are groups with members that have the cosine; these links join all such
    groups, but not each two of them stand in one. The n of a vector add up to
    the number of its similar ones. Parts are cut into blocks of about BLOCK rows, and
    each two of them meet in one group, which gives no more rows than it has.
    """
    blocks = vectors.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = lookup_join(vectors, blocks, "part").withColumn("own", F.pmod(F.xxhash64("content", F.lit(11)), "blocks"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    keyed = met.select("part", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "content", "grp", "vec")

    def compare(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        own, lo, hi, content, grp = (group.column(c).to_numpy() for c in ("own", "lo", "hi", "content", "grp"))
        x = unit(matrix(group.column("vec").combine_chunks()))
        rough = x.astype(np.float32)
        left, right = np.nonzero(own == lo[0])[0], np.nonzero(own == hi[0])[0]
        opposite = rough[right].T
        _, labels = np.unique(grp, return_inverse=True)
        degree = np.zeros(len(content), dtype=np.int64)
        a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for start in range(0, len(left), STRIPE):
            rows = left[start : start + STRIPE]
            score = rough[rows] @ opposite
            # Single precision is off by far less than this; next to the threshold double precision decides.
            hit = score >= least - 1e-4
            doubtful = np.nonzero(score[hit] < least + 1e-4)[0]
            i, j = np.nonzero(hit)
            i, j = rows[i], right[j]
            good = i != j
            for k in range(0, len(doubtful), 100_000):
                d = doubtful[k : k + 100_000]
                good[d] &= np.einsum("ij,ij->i", x[i[d]], x[j[d]]) >= least
            i, j = i[good], j[good]
            degree += np.bincount(i, minlength=len(degree))
            if lo[0] != hi[0]:
                degree += np.bincount(j, minlength=len(degree))
            kept, labels = _joining(i, j, labels)
            a.append(grp[i[kept]])
            b.append(grp[j[kept]])
        some = np.nonzero(degree)[0]
        n = np.concatenate([np.zeros(sum(map(len, a)), dtype=np.int64), degree[some]])
        return pa.table({"a": np.concatenate([*a, content[some]]), "b": np.concatenate([*b, content[some]]), "n": n})

    return keyed.groupBy("part", "lo", "hi").applyInArrow(compare, "a long, b long, n long")


def _around_medoids(grouped: DataFrame, vectors: DataFrame, least: float) -> DataFrame:
    """(content, medoid) of grouped(content, group_id, degree): every group split around its members of highest degree."""
    left = cut(grouped)
    done = None
    while True:
        medoid = left.groupBy("group_id").agg(F.max_by("content", F.struct("degree", -F.col("content"))).alias("medoid"))
        centre = medoid.join(vectors.select(F.col("content").alias("medoid"), F.col("vec").alias("vm")), "medoid")
        held = lookup_join(left, centre, "group_id").join(vectors.select("content", "vec"), "content")
        held = cut(held.select("content", "group_id", "degree", "medoid", ((F.col("content") == F.col("medoid")) | (cosine("vec", "vm") >= least)).alias("near")))
        part = held.where("near").select("content", "medoid")
        done = part if done is None else done.unionByName(part)
        # Every round takes a star out of every group; the rest of a group falls into components, each split on its own.
        rest = held.where("not near").select("content", "group_id", "degree")
        if rest.isEmpty():
            return done
        inside = rest.join(vectors.select("content", "vec"), "content").select(F.col("group_id").alias("part"), "content", F.col("content").alias("grp"), "vec")
        links = cut(similar_within(inside, least).where("n = 0").select("a", "b"))
        again = connected_components(links).select(F.col("record_id").alias("content"), "group_id")
        left = cut(rest.drop("group_id").join(again, "content", "left").select("content", F.coalesce("group_id", "content").alias("group_id"), "degree"))


def similarity_sets(vectors: DataFrame, size: int, least: float = COSINE) -> DataFrame:
    """(part, key, content, set_id, medoid) of every vector in a set with others; set_id is a content hash.

    vectors(part, key, vec) are compared within a part. Null keys and parts and
    unusable vectors (see neighbours.usable) are in no set. Equal vectors are one
    content, searched once, and belong together. Repeated rows count once. An
    empty table gives no rows.
    """
    good = vectors.where(F.col("key").isNotNull() & F.col("part").isNotNull()).where(usable(size)).select("part", "key", "vec")
    rows = stored(good.withColumn("content", F.xxhash64("part", "vec")).dropDuplicates(["part", "key"]))
    unique = stored(rows.groupBy("content").agg(F.first("part").alias("part"), F.first("vec").alias("vec")))
    near = cut(verified(candidate_pairs(unique, size), unique, least))
    rank = lambda c: F.struct(F.xxhash64(c, F.lit(9)), F.col(c))
    # Two links of every vertex hold together what all of them do.
    ends = near.select(F.explode(F.array(F.struct(F.col("a").alias("v"), F.col("b").alias("w")), F.struct(F.col("b").alias("v"), F.col("a").alias("w")))).alias("e")).select("e.v", "e.w")
    two = ends.groupBy("v").agg(F.min_by("w", rank("w")).alias("x"), F.max_by("w", rank("w")).alias("y"))
    thin = cut(two.select("v", F.explode(F.array_distinct(F.array("x", "y"))).alias("w")).select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct())
    first = connected_components(thin).select(F.col("record_id").alias("content"), F.col("group_id").alias("grp"))
    placed = stored(unique.join(first, "content", "left").select("part", "content", F.coalesce("grp", "content").alias("grp"), "vec"))
    # All pairs: what the bands left out joins their groups, and the degrees are exact.
    found = cut(similar_within(placed, least))
    degree = found.where("n > 0").groupBy(F.col("a").alias("content")).agg(F.sum("n").alias("degree"))
    grouped = placed.select("content", "grp").join(degree, "content")
    joins = found.where("n = 0").select("a", "b").distinct()
    if not joins.isEmpty():
        whole = cut(connected_components(joins).select(F.col("record_id").alias("grp"), "group_id"))
        grouped = lookup_join(cut(grouped), whole, "grp")
    else:
        grouped = grouped.withColumn("group_id", F.col("grp"))
    stars = cut(_around_medoids(grouped.select("content", F.coalesce("group_id", "grp").alias("group_id"), "degree"), unique, least))
    named = stars.select("content", F.col("medoid").alias("set_id"))
    return lookup_join(rows.select("part", "key", "content"), named, "content").select(
        "part", "key", "content", F.coalesce("set_id", "content").alias("set_id")
    )


def cluster_members(vectors: DataFrame, size: int, least_members: int = LEAST_MEMBERS) -> DataFrame:
    """(cluster_id, node_id) of every set of at least that many members; cluster_id is its smallest key."""
    placed = cut(similarity_sets(vectors, size))
    sets = placed.groupBy("set_id").agg(F.min("key").alias("cluster_id"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_members)
    return lookup_join(placed.select("key", "set_id"), sets, "set_id").where("cluster_id is not null").select("cluster_id", F.col("key").alias("node_id"))


def describe_clusters(members: DataFrame, vectors: DataFrame, recorded: DataFrame, size: int, typical: int = 3) -> DataFrame:
    """(cluster_id, size, typical, recorded): the most typical members and how many members the best recorded community holds.

    Typical are those with the greatest cosine to the sum of the set's unit
    vectors (ties: smaller key), as a comma-separated list. recorded(community_id,
    node_id) may repeat rows and name members that are gone.
    """
    own = members.join(vectors.where(usable(size)).select(F.col("key").alias("node_id"), "vec").dropDuplicates(["node_id"]), "node_id")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    unit_ = own.withColumn("u", F.transform("vec", lambda v: v.cast("double") / norm))
    # Sums are combined map-side, value by value.
    sums = unit_.groupBy("cluster_id").agg(F.array(*[F.sum(F.col("u")[i]) for i in range(size)]).alias("total"), F.count(F.lit(1)).alias("size"))
    score = F.round(F.aggregate(F.zip_with("u", "total", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v), 9)
    ranked = lookup_join(unit_, sums, "cluster_id").select("cluster_id", "node_id", "size", score.alias("score"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("score"), "node_id"))
    best = ranked.withColumn("place", place).where(F.col("place") <= typical)
    named = best.groupBy("cluster_id").agg(F.first("size").alias("size"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "node_id"))), lambda x: x["node_id"].cast("string")), ",").alias("typical"))
    held = members.join(recorded.select("community_id", "node_id").distinct(), "node_id").groupBy("cluster_id", "community_id").agg(F.count(F.lit(1)).alias("n"))
    most = held.groupBy("cluster_id").agg(F.max("n").alias("recorded"))
    return named.join(most, "cluster_id", "left").select("cluster_id", "size", "typical", F.coalesce("recorded", F.lit(0)).alias("recorded"))
