from __future__ import annotations

import numpy as np
import pytest

from normlake.llm import clusters as C
from normlake.llm import neighbours as N
from tests.conftest import rows

SIZE = 16


def brute(data: dict[tuple[str, str], np.ndarray]) -> set:
    out = set()
    for part in {p for p, _ in data}:
        keys = sorted(k for p, k in data if p == part)
        x = N.unit(np.stack([data[part, k] for k in keys]).astype(np.float64))
        s = np.round(x @ x.T, 12)
        np.fill_diagonal(s, -2)
        for i, k in enumerate(keys):
            for j in np.argsort(-s[i], kind="stable")[: N.NEIGHBOURS]:
                if s[i, j] >= N.LEAST_COSINE:
                    out.add((part, *sorted((k, keys[j]))))
    return out


def grouped(n_sets: int, members: int, noise: float, seed: int) -> dict[tuple[str, str], np.ndarray]:
    rng = np.random.default_rng(seed)
    out, key = {}, 0
    for g in range(n_sets):
        centre = rng.normal(size=SIZE)
        for _ in range(members):
            out[f"c{g % 3}", str(key)] = (centre + noise * rng.normal(size=SIZE)).astype(np.float32)
            key += 1
    return out


def frame(spark, data, extra=()):
    listed = [(p, k, [float(x) for x in v], k) for (p, k), v in data.items()]
    return spark.createDataFrame(listed + list(extra), "part string, key string, vec array<float>, class string")


def test_neighbours_against_brute_force(spark):
    data = grouped(8, 40, 0.35, 1)
    assert rows(N.similar_pairs(frame(spark, data), SIZE)) == brute(data)


@pytest.mark.parametrize(("unit", "fanout", "depth"), [(64, 4, 4), (16, 4, 1)])
def test_neighbours_in_many_cells(spark, monkeypatch, unit, fanout, depth):
    """Cells by centres, and by centres of residuals; small cells that are cut into blocks."""
    monkeypatch.setattr(N, "UNIT", unit)
    monkeypatch.setattr(N, "FANOUT", fanout)
    monkeypatch.setattr(N, "DEPTH", depth)
    data = grouped(8, 40, 0.3, 1)
    want, got = brute(data), rows(N.similar_pairs(frame(spark, data), SIZE))
    assert len(want & got) >= 0.95 * len(want)
    assert len(want & got) >= 0.95 * len(got)


def test_scan_ranks_few_rows_exactly():
    """The tables alone leave out all but the rows within the error of the codes."""
    rng = np.random.default_rng(5)
    x = N.unit(rng.normal(size=(3000, 64)))
    x[1::2] = N.unit(x[::2] + 0.05 * rng.normal(size=(1500, 64)))
    m = N.Quantiser.fit(x)
    q, r, s = N.scan(m, x, x, m.code(x.astype(np.float32)))
    exact = x @ x.T
    assert set(zip(q.tolist(), r.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(exact >= N.LEAST_COSINE))))
    assert m.slack < 0.15


def test_neighbours_of_odd_rows(spark):
    v = [1.0] + [0.0] * (SIZE - 1)
    same = [("a", str(i), v, "x") for i in range(12)] + [("a", "3", v, "x")]
    odd = [("a", "z1", None, "x"), ("a", "z2", [0.0] * SIZE, "x"), ("a", "z3", [1.0], "x"), ("a", "z4", [float("nan")] * SIZE, "x"), (None, "z5", v, "x"), ("b", "z6", v, "x"), ("a", None, v, "x")]
    got = rows(N.similar_pairs(spark.createDataFrame(same + odd, "part string, key string, vec array<float>, class string"), SIZE))
    # Ties go to the smaller keys, in byte order.
    keys = sorted(str(i) for i in range(12))
    want = {("a", *sorted((k, o))) for k in keys for o in [x for x in keys if x != k][:5]}
    assert got == want
    assert rows(N.similar_pairs(frame(spark, {}), SIZE)) == set()


def test_quantiser_scores_follow_the_inner_products():
    rng = np.random.default_rng(3)
    x = N.unit(rng.normal(size=(400, SIZE)))
    m = N.Quantiser.fit(x)
    codes = m.code(x.astype(np.float32))
    t = m.tables(x[:5])
    score = sum(t[j][codes[:, j]] for j in range(codes.shape[1])).T
    error = np.abs(score - x[:5] @ x.T)
    assert error.max() < 0.25 and error.mean() < 0.05


def members(data: dict) -> dict:
    out = {}
    for part in {p for p, _ in data}:
        keys = sorted((int(k) for p, k in data if p == part))
        x = N.unit(np.stack([data[part, str(k)] for k in keys]).astype(np.float64))
        seen: set[int] = set()
        for i, k in enumerate(keys):
            if k not in seen:
                own = [keys[j] for j in np.nonzero(x @ x[i] >= C.COSINE)[0]]
                seen.update(own)
                if len(own) >= C.LEAST_MEMBERS:
                    out |= dict.fromkeys((k, o) for o in own)
    return out


def numbered(spark, data, extra=()):
    listed = [(p, int(k), [float(x) for x in v]) for (p, k), v in data.items()]
    return spark.createDataFrame(listed + list(extra), "part string, key long, vec array<float>")


def test_clusters_against_brute_force(spark):
    data = grouped(12, 5, 0.12, 5)
    assert rows(C.cluster_members(numbered(spark, data), SIZE)) == set(members(data))


def test_clusters_of_copies_and_odd_rows(spark):
    v = [1.0, 2.0] + [0.0] * (SIZE - 2)
    odd = [("a", 90, None), ("a", 91, [0.0] * SIZE), ("a", 92, [1.0]), (None, 93, v), ("b", 94, v), ("a", None, v)]
    copies = [("a", i, v) for i in range(30)] + [("a", 3, v)]
    got = rows(C.cluster_members(numbered(spark, {}, copies + odd), SIZE))
    assert got == {(0, i) for i in range(30)}
    assert rows(C.cluster_members(numbered(spark, {}), SIZE)) == set()


def test_loose_groups_are_split(spark):
    # A chain along a circle: neighbours are similar, the ends are not.
    angle = [i * 0.3 for i in range(12)]
    data = {("a", str(i)): np.array([np.cos(t), np.sin(t)] + [0.0] * (SIZE - 2), dtype=np.float32) for i, t in enumerate(angle)}
    got = rows(C.cluster_members(numbered(spark, data), SIZE))
    by: dict[int, list[int]] = {}
    for c, n in got:
        by.setdefault(c, []).append(n)
    for own in by.values():
        # All of a set are similar to one of its members.
        x = N.unit(np.stack([data["a", str(n)] for n in own]).astype(np.float64))
        assert ((x @ x.T) >= C.COSINE - 1e-9).all(1).any()


def test_long_chains_are_split_whole(spark):
    """A chain of more than twenty stars: every vector that is similar to another one of it comes out in a set with its medoid."""
    axis = np.eye(SIZE)
    x = [np.cos(t) * axis[i] + np.sin(t) * axis[i + 1] for i in range(SIZE - 1) for t in np.arange(0, np.pi / 2, 0.2)]
    data = {("a", str(i)): v.astype(np.float32) for i, v in enumerate(x)}
    placed = C.similarity_sets(numbered(spark, data), SIZE).collect()
    assert len(placed) == len(x)
    by: dict[int, list[int]] = {}
    for r in placed:
        by.setdefault(r.set_id, []).append(r.key)
    assert len(by) > 20
    for own in by.values():
        y = N.unit(np.stack([x[n] for n in own]))
        assert ((y @ y.T) >= C.COSINE - 1e-6).all(1).any()
    # Stars are taken whole: few vectors stay alone in a chain where each has neighbours.
    assert sum(len(v) == 1 for v in by.values()) <= len(by) / 2


@pytest.mark.parametrize("block", [8192, 700])
def test_loose_sets_among_many_unlinked_vectors(spark, monkeypatch, block):
    """Sets of three just over the cosine, in one part of mostly unlinked vectors that lean to one side."""
    monkeypatch.setattr(C, "BLOCK", block)
    rng = np.random.default_rng(21)
    size, sets, alone = 64, 150, 4000
    lean = 0.3 * rng.normal(size=size)
    x = []
    for _ in range(sets):
        # Exact cosine 0.83 between any two of a set.
        base = np.linalg.qr(np.column_stack([lean + rng.normal(size=size), rng.normal(size=(size, 3))]))[0].T
        x += [np.sqrt(0.83) * base[0] + np.sqrt(0.17) * base[k] for k in (1, 2, 3)]
    x += list(lean + rng.normal(size=(alone, size)))
    data = {("a", str(i)): v.astype(np.float32) for i, v in enumerate(x)}
    want = {(3 * (i // 3), i) for i in range(3 * sets)}
    assert set(members(data)) == want
    assert rows(C.cluster_members(numbered(spark, data), size)) == want


@pytest.mark.parametrize("block", [65_536, 150])
def test_stars_of_leaves_that_are_not_similar(spark, monkeypatch, block):
    """Leaves are similar to their centre only: no link of a vector that has another one may be left out."""
    monkeypatch.setattr(C, "BLOCK", block)
    rng = np.random.default_rng(12)
    size, sets, leaves = 64, 30, 14
    x = []
    for _ in range(sets):
        base = np.linalg.qr(rng.normal(size=(size, leaves + 1)))[0].T
        x += [base[0], *(0.82 * base[0] + np.sqrt(1 - 0.82**2) * base[1:])]
    data = {("a", str(i)): v.astype(np.float32) for i, v in enumerate(x)}
    want = {(i // (leaves + 1) * (leaves + 1), i) for i in range(len(x))}
    assert rows(C.cluster_members(numbered(spark, data), size)) == want


def test_links_and_degrees_of_all_pairs(spark):
    data = grouped(6, 30, 0.45, 17)
    keys = [int(k) for _, k in data]
    listed = [(p, int(k), int(k), [float(v) for v in x]) for (p, k), x in data.items()]
    got = rows(C.similar_within(spark.createDataFrame(listed, "part string, content long, grp long, vec array<float>"), C.COSINE))
    x = N.unit(np.stack(list(data.values())).astype(np.float64))
    parts = np.array([p for p, _ in data])
    similar = (x @ x.T >= C.COSINE) & (parts[:, None] == parts) & ~np.eye(len(x), dtype=bool)
    assert {a: n for a, b, n in got if n} == {k: int(n) for k, n in zip(keys, similar.sum(1), strict=True) if n}
    links = [(a, b) for a, b, n in got if not n]
    assert all(similar[keys.index(a), keys.index(b)] for a, b in links)
    reach = np.linalg.matrix_power((similar | np.eye(len(x), dtype=bool)).astype(float), 60) > 0
    assert len(links) == len(x) - len({tuple(r) for r in reach.tolist()})


def test_describing_clusters(spark):
    data = grouped(3, 5, 0.1, 9)
    df = numbered(spark, data)
    own = C.cluster_members(df, SIZE)
    recorded = spark.createDataFrame([(1, 0), (1, 0), (1, 1), (2, 2), (3, 999)], "community_id long, node_id long")
    got = {r.cluster_id: r for r in C.describe_clusters(own, df, recorded, SIZE).collect()}
    assert got[0].size == 5 and got[0].recorded == 2 and len(got[0].typical.split(",")) == 3


@pytest.mark.parametrize("value", [1e-30, 1e30])
def test_extreme_lengths(value):
    assert np.allclose(np.linalg.norm(N.unit(np.full((2, 4), value)), axis=1), 1)
