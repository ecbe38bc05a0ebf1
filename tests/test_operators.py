from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from normlake.functions import vectors as V
from normlake.functions.text import match_expression
from normlake.operators import chunking, graph, refs, retrieval, state
from tests.conftest import rows


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(F.round(V.cosine(F.col("a"), F.col("b")), 6), V.normalised(F.col("a"))).collect()
    assert (got[0][0], got[0][1]) == (0.96, [0.6, 0.8])
    assert (got[1][0], got[1][1]) == (0.0, [0.0, 0.0])


def test_codec(spark):
    v = [0.0, 1.5, -2.25, 3.125]
    df = spark.createDataFrame([(v,), (None,)], "v array<float>")
    assert [r[0] for r in df.select(V.from_blob(V.to_blob("v"))).collect()] == [v, None]
    with pytest.raises(Exception, match="3 bytes"):
        spark.createDataFrame([(bytearray(b"abc"),)], "b binary").select(V.from_blob("b")).collect()


def test_search_rejects_other_sizes_and_keeps_scope(spark):
    v = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0])], "id long, document_id long, vec array<double>")
    assert [r.id for r in retrieval.search(v, [0.1, 0.9], 2).collect()] == [2, 1]
    assert [r.id for r in retrieval.search(v, [0.1, 0.9], 2, [1]).collect()] == [1]
    assert retrieval.search(v, [0.1, 0.9], 2, []).count() == 0
    with pytest.raises(Exception, match="another size"):
        retrieval.search(v, [1.0], 1).collect()


def test_batch_search_equals_single(spark):
    rng = random.Random(4)
    data = [(i, i % 2, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    v = spark.createDataFrame(data, "id long, space long, vec array<double>")
    q = v.where("id < 6").select(F.col("id").alias("query_id"), "space", F.col("vec").alias("qvec"))
    for block in (7, 1000):
        got = retrieval.batch_search(q, v, 4, block=block)
        for i in range(6):
            one = retrieval.search(v.where(f"space = {i % 2}"), data[i][2], 4)
            assert [r.id for r in got.where(f"query_id = {i}").orderBy("rank").collect()] == [r.id for r in one.collect()]


def test_keyword_query():
    assert match_expression("AT 4.3.2") == '"AT" OR "4.3.2"'
    assert match_expression("§ — ()") == ""


def test_index_edge_cases(spark):
    c = spark.createDataFrame([(1, "Art. 33 Meldung"), (2, "33 Artikel"), (3, None), (4, "")], "id long, text string")
    index = retrieval.postings(c)
    assert rows(retrieval.phrase_search(index, "Art. 33")) == {(1,)}
    assert rows(retrieval.bm25(index, "§").select("id")) == set()
    assert rows(retrieval.bm25(index, "Meldung").select("id")) == {(1,)}
    assert retrieval.bm25_batch(index, spark.createDataFrame([(1, None), (2, "meldung")], "query_id long, query string"), 3).count() == 1


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="Ab1.!? \n§ä…)\"", max_size=60))
def test_segments_cover_the_text(text):
    parts = chunking.segments(text)
    raw = text.encode()
    assert all(raw[a:b].decode() == s for a, b, s in parts)
    assert "".join("".join(s.split()) for _, _, s in parts) == "".join(text.split())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=20), st.integers(1, 30), st.floats(0, 2))
def test_windows_advance_and_cover(sizes, budget, overlap):
    parts, at = [], 0
    for n in sizes:
        parts.append((at, at + n, "x" * n))
        at += n
    found = chunking.windows(parts, budget, overlap)
    assert sorted({i for w in found for i in range(w["first"], w["last"] + 1)}) == list(range(len(parts)))
    assert all(a["first"] < b["first"] for a, b in zip(found, found[1:], strict=False))


def test_reference_ranges_and_caps():
    assert refs.spread("13") == ["13"]
    assert refs.spread("13 bis 15") == ["13", "14", "15"]
    assert refs.spread("15 bis 13") == ["15"]
    assert refs.spread("1 bis 31") == ["1", "31"]
    assert len(refs.spread("1 bis 30")) == 30
    assert refs.expand_hits(range(10, 15), [[100], [101, 102], [103], [104], [105]], 5) == [(100, 1), (101, 2), (103, 3)]
    assert refs.expand_hits([10, 11], [[11], [10, 200]], 4) == [(200, 2)]


def test_state_rules(spark):
    changes = spark.createDataFrame([(1, "a", None, True, 1), (1, "b", "x", False, 2), (1, "c", None, False, 3)], "k long, v string, e string, f boolean, seq long")
    assert rows(state.last_write(changes.select("k", "v", "seq"), ["k"])) == {(1, "c")}
    assert rows(state.first_write(changes.select("k", "v", "seq"), ["k"])) == {(1, "a")}
    assert rows(state.last_non_null(changes.select("k", "v", "e", "seq"), ["k"], ["e"])) == {(1, "c", "x")}
    assert rows(state.latch(changes.select("k", "v", "f", "seq"), ["k"], "f")) == {(1, "c", True)}
    assert rows(state.counted(changes.select("k", "v", "seq"), ["k"])) == {(1, 3, "c")}
    cells = spark.createDataFrame([("r", "a"), ("r", "b"), ("s", "a"), ("r", None)], "run_id string, row_uid string")
    assert rows(state.prune(cells, "r", ["a"])) == {("r", "a"), ("s", "a")}
    assert rows(state.prune(cells, "r", [])) == {("s", "a")}
    pools = spark.createDataFrame([(1, "gguf"), (1, "gguf"), (2, "onnx")], "pool_id long, kind string")
    with pytest.raises(ValueError, match="more than one"):
        state.checked_members(pools, "gguf")


def test_merges_equal_a_step_by_step_merge(spark):
    rng = random.Random(2)
    for _ in range(3):
        ids = list(range(12))
        pairs = [(rng.choice(ids), rng.choice([*ids, 99])) for _ in range(15)]
        request = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "seq long, winner_id long, loser_id long")
        nodes = spark.createDataFrame([(i,) for i in ids], "id long")
        got = [(r.winner_id, r.loser_id) for r in graph.executed_merges(request, nodes).orderBy("seq").collect()]
        assert got == graph.fold_merges(pairs, set(ids))


def test_hops_and_label_propagation(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 6), (None, 7), (8, None)], "source_id long, target_id long")
    seeds = spark.createDataFrame([(1,), (9,)], "seed long")
    assert rows(graph.neighbourhood(seeds, e, 2)) == {(1, 1, 0), (1, 2, 1), (1, 3, 2), (9, 9, 0)}
    two = [(a, b) for g in ((1, 2, 3), (11, 12, 13)) for a in g for b in g if a < b]
    found = dict(rows(graph.label_propagation(spark.createDataFrame(two, "source_id long, target_id long"), 4)))
    assert {found[i] for i in (1, 2, 3)}.isdisjoint({found[i] for i in (11, 12, 13)})


def test_store_and_stream(spark, tmp_path):
    from normlake.sources.store import Store, write_json
    from normlake.streaming.upserts import upsert, upsert_stream

    store = Store(spark, str(tmp_path / "store"))
    assert store.tables() == []
    kind = "k long, seq long, v string"
    upsert(store, "t", spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], kind), ["k"])
    upsert(store, "t", spark.createDataFrame([(1, 2, "c"), (2, 0, "old")], kind), ["k"])
    assert rows(store.read("t").select("k", "v")) == {(1, "c"), (2, "b")}
    spark.createDataFrame([(3, 1, "s"), (1, 3, "d")], kind).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    upsert_stream(stream, store, "t", ["k"], str(tmp_path / "cp")).awaitTermination(60)
    assert rows(store.read("t").select("k", "v")) == {(1, "d"), (2, "b"), (3, "s")}
    assert store.vacuum() == 2
    assert store.read("t").count() == 3
    write_json(store.read("t"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_structural_rules():
    long = "Das Institut hat den Bericht vorzulegen. " * 6
    numbered = [(0, 100, "§ 1 Anwendung", 10.0, False), (0, 220, long, 10.0, False), (0, 340, "(1) Meldung der Daten", 10.0, False), (0, 460, long, 10.0, False)]
    got = chunking.structural_chunks(numbered)
    assert [c["section"] for c in got] == ["§ 1", "§ 1 (1)"]
    # A bold short line that opens a paragraph is a heading; page numbers and contents lines go.
    bold = [(0, 100, long, 10.0, False), (0, 600, "Zweiter Teil", 10.0, True), (0, 720, long, 10.0, False), (1, 50, "Seite 3", 10.0, False), (1, 90, "Meldung ..... 7", 10.0, False)]
    assert [c["title"] for c in chunking.structural_chunks(bold)] == ["", "Zweiter Teil"]
    # Overlong text is cut at sentences and nothing is lost.
    text = "Ein Satz mit Wörtern. " * 300
    cut = chunking.structural_chunks([(0, 100, text, 10.0, False), (0, 220, text, 10.0, False)])
    assert len(cut) > 1 and "".join("".join(c["text"].split()) for c in cut) == "".join((text * 2).split())
    assert chunking.structural_chunks([]) == []
    assert chunking.LineProfile(patterns=((1, "heading_l1", "(", "i"),)).compiled() == []
