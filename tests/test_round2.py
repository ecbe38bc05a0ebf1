"""Keyword index, store, layout source, sections, evidence and graph retrieval on small cases."""

from __future__ import annotations

import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from normlake.operators import chunking, evalset, graph, refs, retrieval
from normlake.operators.keywords import KeywordIndex
from normlake.sources.layout import lines_of, read_hocr
from normlake.sources.store import Conflict, Store
from normlake.streaming.upserts import upsert
from tests.conftest import rows

TEXTS = "id long, part long, text string"


@pytest.fixture
def index(spark, tmp_path):
    own = KeywordIndex(Store(spark, str(tmp_path / "index")), buckets=4)
    own.rebuild(spark.createDataFrame([(1, 1, "Meldung nach AT 4.3.2"), (2, 2, "Siehe AT 4.3.2 und AT 9"), (3, 1, None), (4, 1, ""), (5, 1, "die Meldung, die Meldung"), (5, 1, "die Meldung, die Meldung")], TEXTS))
    return own


def found(df) -> list[int]:
    return [r.id for r in df.orderBy(F.desc("score"), "id").collect()]


def test_keyword_index_follows_changes(spark, index):
    assert found(index.bm25("Meldung")) == [5, 1]
    assert rows(index.phrase("AT 4.3.2")) == {(1, 1), (2, 2)} and rows(index.phrase("4 AT")) == set()
    assert index.bm25("§ — ()").count() == 0 and index.phrase("").count() == 0
    index.apply(changed=spark.createDataFrame([(1, 1, "nichts mehr"), (6, 3, "eine Meldung")], TEXTS))
    assert set(found(index.bm25("Meldung"))) == {5, 6}
    index.apply(deleted=spark.createDataFrame([(5,), (99,)], "id long"))
    assert found(index.bm25("Meldung")) == [6]
    # A changed text counts once, and merging segments changes nothing.
    before = rows(index.bm25("AT Meldung").select("id", F.round("score", 9)))
    index.merge()
    assert len(index._segments()) == 1 and rows(index.bm25("AT Meldung").select("id", F.round("score", 9))) == before
    assert index.store.read("keywords.stats").first()["n"] == index.store.read("keywords.docs").count() == 5


def test_kept_index_equals_the_plain_scores(spark, index):
    texts = spark.createDataFrame([(1, 1, "Meldung nach AT 4.3.2"), (2, 2, "Siehe AT 4.3.2 und AT 9"), (3, 1, None), (4, 1, ""), (5, 1, "die Meldung, die Meldung")], TEXTS)
    plain = retrieval.postings(texts)
    for q in ("Meldung", "AT 4.3.2", "die die AT", "unbekannt"):
        assert rows(index.bm25(q).select("id", F.round("score", 9))) == rows(retrieval.bm25(plain, q).select("id", F.round("score", 9)))
    asked = spark.createDataFrame([(1, "Meldung AT"), (2, None), (3, ""), (4, "die Siehe"), (5, "unbekannt")], "query_id long, query string")
    got = {(r.query_id, r.id): round(r.score, 9) for r in index.batch(asked, 5).collect()}
    assert got == {(r.query_id, r.id): round(r.score, 9) for r in retrieval.bm25_batch(plain, asked, 5).collect()}
    assert {q for q, _ in got} == {1, 4}
    # By part, of kept texts only; the statistics stay.
    part = index.batch(asked, 1, by_part=True, kept=spark.createDataFrame([(1,), (2,)], "id long"))
    assert {(r.query_id, r.part, r.id): round(r.score, 9) for r in part.collect()} == {(1, 1, 1): got[1, 1], (1, 2, 2): got[1, 2], (4, 2, 2): got[4, 2]}


def test_empty_index(spark, tmp_path):
    own = KeywordIndex(Store(spark, str(tmp_path / "empty")))
    own.rebuild(spark.createDataFrame([], TEXTS))
    assert own.bm25("x").count() == 0 and own.phrase("x").count() == 0
    assert own.batch(spark.createDataFrame([(1, "x")], "query_id long, query string"), 3).count() == 0


def test_commits_at_once(spark, tmp_path):
    a = Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([(1,)], "x long")
    a.commit({"t": one})
    base = a.manifest()["number"]
    a.commit({"u": one})
    with pytest.raises(Conflict):
        a.commit({"t": one.limit(0)}, base=base)
    assert a.read("t").count() == 1 and a.tables() == ["t", "u"]
    # Any number of readers sees a whole manifest: files are made under another name first.
    assert a.vacuum() == 1
    assert a.manifest()["number"] == 2


def test_migration(spark, tmp_path):
    root = str(tmp_path / "m")
    Store(spark, root, 1).commit({"t": spark.createDataFrame([(1, "A"), (2, "a")], "id long, k string")})
    steps = {2: lambda s: {"t": s.read("t").withColumn("k", F.lower("k"))}, 3: lambda s: {"t": s.read("t").groupBy("k").agg(F.min("id").alias("id"))}}
    store = Store(spark, root, 3)
    assert store.migrate(steps) == 2 and store.migrate(steps) == 0
    assert rows(store.read("t").select("id", "k")) == {(1, "a")} and store.manifest()["schema_version"] == 3
    with pytest.raises(ValueError):
        Store(spark, root, 2).migrate(steps)
    with pytest.raises(ValueError):
        Store(spark, root, 4).migrate(steps)


def test_upserts_rewrite_their_buckets_only(spark, tmp_path):
    store = Store(spark, str(tmp_path / "b"))
    kind = "k long, seq long, v string"
    upsert(store, "t", spark.createDataFrame([(i, 1, "a") for i in range(40)], kind), ["k"], bucket_rows=10)
    places = store.manifest()["tables"]["t"]
    assert len(places) == 4
    upsert(store, "t", spark.createDataFrame([(7, 2, "b"), (7, 0, "old")], kind), ["k"], bucket_rows=10)
    after = store.manifest()["tables"]["t"]
    assert sum(places[b] != after[b] for b in places) == 1
    assert store.read("t").count() == 40 and rows(store.read("t").where("k = 7").select("v")) == {("b",)}
    upsert(store, "t", spark.createDataFrame([(i, 3, "c") for i in range(100, 160)], kind), ["k"], bucket_rows=10)
    upsert(store, "t", spark.createDataFrame([(7, 4, "d")], kind), ["k"], bucket_rows=10)
    assert len(store.manifest()["tables"]["t"]) >= 8 and store.read("t").count() == 100
    assert rows(store.read("t").where("k = 7").select("v")) == {("d",)}


HOCR = """<html><body><div class='ocr_page' title='image "a.png"; bbox 0 0 100 100; ppageno 0'>
<p class='ocr_par'><span class='ocr_line' title='bbox 1 10 90 20; x_size 12.5'><strong>Art. 1</strong> <span class='ocrx_word'><b>Begriffe</b></span></span><br>
<span class='ocr_line' title='bbox 1 40 90 50'>Die Bank &amp; <em>das</em> Institut</span><span class='ocr_line' title='bbox 1 60 90 70'> </span></p></div>
<div class='ocr_page' title='ppageno 1'><span class='ocr_header' title='bbox 1 5 9 15; x_fsize 8'>Seite 2</span></div></body></html>"""


def test_layout_files(spark, tmp_path):
    assert lines_of(HOCR) == [(0, 100, "Art. 1 Begriffe", 12.5, True), (0, 400, "Die Bank & das Institut", 10.0, False), (1, 50, "Seite 2", 8.0, False)]
    assert lines_of("") == [] and lines_of("<p>no lines</p>") == []
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.hocr").write_text(HOCR)
    (tmp_path / "x" / "b.hocr").write_bytes(b"\xff<span class='ocr_line' title='bbox 0 0 1 9'>z\xff</span>")
    (tmp_path / "x" / "c.hocr").write_text("")
    got = read_hocr(spark, str(tmp_path / "x"))
    assert got.count() == 4 and rows(got.where("line_no = 0 and page = 0 and bold").select("text", "size")) == {("Art. 1 Begriffe", 12.5)}
    chunks = chunking.structural_table(got.where("path like '%a.hocr'").select(F.lit(1).cast("long").alias("doc_id"), "page", "y", "line_no", "text", "size", "bold"))
    assert [(r.section, r.title) for r in chunks.collect()] == [("Art. 1", "Begriffe")]


@pytest.mark.parametrize(
    ("sections", "omitted", "most", "want"),
    [("sss", "", 5, ([11, 12], None)), ("ssss", "", 2, ([11, 12], 13)), ("sst", "", 5, ([11], None)), ("sss", "1", 5, ([], None)), ("ss", "", 0, ([], 11)), ("sss", "0", 5, ([11, 12], None)), ("s", "", 3, ([], None))],
)
def test_sections_that_go_on(spark, sections, omitted, most, want):
    data = [(10 + i, 1, i, c, str(i) in omitted, "x") for i, c in enumerate(sections)] + [(90, None, 0, "s", False, "x"), (91, 2, 5, None, False, "x"), (92, 2, 6, " ", None, "x")]
    df = spark.createDataFrame(data, "id long, document_id long, chunk_index long, section string, is_omitted boolean, r string")
    got = {r.chunk_id: (r.continuation, r.continues_at) for r in chunking.continued_sections(df, most).collect()}
    assert got[10] == want and 91 not in got and 92 not in got
    assert chunking.continued_sections(df.where("false"), most).count() == 0


def test_long_lines_are_cut_in_one_pass():
    text = "Das Institut hat z.B. nach Abs. 3 zu berichten. " * 22_000
    began = time.time()
    assert len(chunking.sentences(text)) > 20_000 and time.time() - began < 2
    began = time.time()
    chunking.sentences("." * 1_000_000 + "x" + "a." * 200_000)
    assert time.time() - began < 2


def test_evidence_of_edges(spark):
    edges = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    given = spark.createDataFrame([(1, 10, "a"), (1, 10, "b"), (1, 11, None), (2, None, "x"), (None, 5, "y"), (9, 1, "z")], "edge_id long, chunk_id long, evidence string")
    got = {r.id: r.evidence for r in graph.with_evidence(edges, given).collect()}
    assert got == {1: {10: "b", 11: None}, 2: {}, 3: {}}
    assert all(r.evidence == {} for r in graph.with_evidence(edges, given.where("false")).collect())
    old = spark.createDataFrame([(1, 7, 1, 2, "R"), (2, 7, 1, 2, "r"), (3, 7, 1, 2, "S"), (4, 7, None, 2, "R")], "id long, context_id long, source_id long, target_id long, relation_type string")
    moved = graph.moved_to_natural_key(old, spark.createDataFrame([(1, 5), (2, 5), (2, 6), (3, 7), (4, 8), (3, None)], "edge_id long, chunk_id long"))
    assert rows(moved) == {(1, 5), (1, 6), (3, 7)}


NODES = [(1, 1, "A", "PERSON", "a", [1.0, 0.0]), (2, 1, "B", "ORG", "b", [0.0, 1.0]), (3, 1, "C", "ORG", None, None), (4, 2, "D", "ORG", "d", [1.0, 0.1]), (5, 3, "E", "ORG", "e", [1.0, 0.0, 0.0])]


@pytest.mark.parametrize(("hops", "want"), [(1, {1, 2}), (2, {1, 2, 3})])
def test_graph_from_a_query_vector(spark, hops, want):
    n = spark.createDataFrame(NODES, "id long, context_id long, label string, shown_type string, description string, vec array<double>")
    edges = spark.createDataFrame([(1, 1, 2, "R"), (2, 2, 3, "S"), (3, 3, None, "T")], "id long, source_id long, target_id long, relation string")
    vectors = n.where("vec is not null and context_id = 1").select("id", F.lit(1).alias("space"), "context_id", "vec")
    asked = spark.createDataFrame([(7, 1, [1.0, 0.0]), (8, 2, [1.0, 0.0])], "query_id long, space int, qvec array<double>")
    got = graph.graph_context(graph.seed_nodes(asked, vectors, 1), n, edges, hops).collect()
    assert {r.id for r in got if r.kind == "node"} == want and {r.seed for r in got} == {7}
    assert "A (PERSON): a" in {r.line for r in got} and ("A -[R]-> B" in {r.line for r in got})


def test_seeds_of_contexts_and_of_models(spark):
    """One query asks each context, a batch each model; the walk then leaves the contexts it came from."""
    n = spark.createDataFrame(NODES, "id long, context_id long, label string, shown_type string, description string, vec array<double>")
    vectors = n.where("vec is not null").select("id", F.lit(1).alias("space"), "context_id", "vec")
    asked = spark.createDataFrame([(7, 1, [1.0, 0.0])], "query_id long, space int, qvec array<double>")
    assert rows(graph.seed_nodes(asked, vectors, 1)) == {(7, 1), (7, 4)}
    assert rows(graph.seed_nodes(asked, vectors, 1, per_context=False)) == {(7, 1)}
    ball = graph.neighbourhood(spark.createDataFrame([(7, 1)], "seed long, node_id long"), spark.createDataFrame([(1, 5), (5, 4)], "source_id long, target_id long"), 2)
    assert rows(ball) == {(7, 1, 0), (7, 5, 1), (7, 4, 2)}


def test_communities_by_vector(spark):
    v = [1.0, 0.0]
    found_ = spark.createDataFrame([(1, 7, 1, 1, "a", "s", v), (2, 7, 1, 2, "b", "s", v), (3, 7, 1, None, "c", None, v), (4, 8, 1, 1, "d", "s", v), (5, 8, 1, None, "e", "s", v), (6, 8, 1, None, "f", "s", None)], "id long, context_id long, space int, lens_id long, label string, summary_text string, vec array<double>")
    contexts = spark.createDataFrame([(7, 1), (8, None)], "context_id long, active_lens_id long")
    asked = spark.createDataFrame([(9, 1, v)], "query_id long, space int, qvec array<double>")
    assert rows(graph.community_search(asked, found_, contexts, 5)) == {(9, 1, "a: s"), (9, 3, "c: "), (9, 5, "e: s")}


def test_merges_against_a_plain_loop(spark):
    import random

    rnd = random.Random(4)
    n = 60
    log = [(i, rnd.randrange(n), rnd.randrange(n)) for i in range(80)]
    edges = [(i, 7, rnd.randrange(n), rnd.randrange(n), rnd.choice("RrS")) for i in range(200)]
    alive, to = set(range(n)), {}
    for _, w, l in log:
        if w != l and w in alive and l in alive:
            alive.discard(l)
            to[l] = w

    def end(x: int) -> int:
        while x in to:
            x = to[x]
        return x

    winners = {end(w) for w in to.values()}
    want: dict[tuple, int] = {}
    for i, c, a, b, r in edges:
        a, b = end(a), end(b)
        if not (a == b and a in winners):
            key = (c, a, b, r.lower())
            want[key] = min(i, want.get(key, i))
    nodes = spark.createDataFrame([(i,) for i in range(n)], "id long")
    done = graph.executed_merges(spark.createDataFrame(log, "seq long, winner_id long, loser_id long"), nodes)
    kept, left = graph.merge_nodes(nodes, spark.createDataFrame(edges, "id long, context_id long, source_id long, target_id long, relation_type string"), done)
    assert {r.id for r in kept.collect()} == alive
    assert {(r.context_id, r.source_id, r.target_id, r.relation_type.lower()): r.id for r in left.collect()} == want


def test_short_anchors(spark):
    entries = spark.createDataFrame([(1, '["konto"]'), (2, '["ab"]'), (3, "broken"), (4, '["x"]'), (5, '["bank konto"]'), (6, None)], "id long, anchors_any string")
    chunks = spark.createDataFrame([(1, "Das Kontoblatt"), (2, "Girokonto der Bank"), (3, None), (4, "Labor xyz"), (5, "eine Bank Konto führt")], "id long, text string")
    assert rows(evalset.anchor_hits(entries, chunks)) == {(1, 1), (1, 2), (1, 5), (2, 4), (4, 4), (5, 5)}
    assert evalset.anchor_hits(entries.where("false"), chunks).count() == 0


def test_batch_search_of_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.integers(-2, 3, (90, 4)).astype(float)
    df = spark.createDataFrame([(i, 0, i % 3, v.tolist()) for i, v in enumerate(x)], "id long, space long, context_id long, vec array<double>")
    q = df.where("id % 10 = 0").select(F.col("id").alias("query_id"), "space", F.col("vec").alias("qvec"))
    small = rows(retrieval.batch_search(q, df, 7, query_block=3, vector_block=11).select("query_id", "id", "rank"))
    assert small == rows(retrieval.batch_search(q, df, 7).select("query_id", "id", "rank"))
    assert Counter(a for a, _, _ in small) == Counter({i: 7 for i in range(0, 90, 10)})


def test_citations_at_odd_places():
    lexicon = refs.Lexicon()
    for text in ("§", "§§", "Art.", "Artikel", "Verordnung (EU)", "Verordnung (EU) Nr. 5/", "AT 4a", "§ 5 Abs.", "§ 5 des", "§ 5 der ", "Art. 5 der Verordnung (", "§ 5 bis", "§ 99999999999999999999 KWG"):
        refs.references(text, lexicon)
    assert [r[0] for r in refs.references("AT 4.3a und AT 4.", lexicon)] == ["MARISK:AT4"]
    assert [r[0] for r in refs.references("Art. 5 CRR-Novelle, Art. 6 CRR.", lexicon)] == ["CRR:Art.6"]


def test_databases(spark, tmp_path):
    from normlake.sources.database import Database

    memory = Database.in_memory(spark, {"a": ([(1, "x"), (2, None)], "id long, v string"), "b": ([(1,)], "id long")})
    assert rows(memory.sql("SELECT a.v FROM {a} a JOIN {b} b ON a.id = b.id")) == {("x",)}
    memory["a"].write.parquet(f"{tmp_path}/a.parquet")
    (tmp_path / "note.txt").write_text("no table")
    opened = Database.open(spark, str(tmp_path))
    assert list(opened.tables) == ["a"] and opened["a"].count() == 2


def test_ages_against_a_given_clock(spark):
    from datetime import UTC, datetime

    from normlake.functions.dates import with_age

    df = spark.createDataFrame([(1, datetime(2025, 12, 31, 23, 59, 59, 700_000)), (2, None)], "id long, at timestamp")
    got = {r.id: (r.epoch, r.shown, r.age) for r in with_age(df, "at", datetime(2026, 1, 1)).collect()}
    at = int(datetime(2025, 12, 31, 23, 59, 59, tzinfo=UTC).timestamp())
    assert got == {1: (at, "2025-12-31 23:59:59", 1), 2: (None, None, None)}


def test_letters_with_marks():
    from normlake.functions.text import plain_tokens

    assert plain_tokens("Čeština ŻÓŁW Ångström ñandú Øre") == ["cestina", "zołw", "angstrom", "nandu", "ore"]
