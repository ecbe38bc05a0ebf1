"""Queries that cover what their counterparts with SQL leave out."""

from __future__ import annotations

import json
import re
from collections import Counter
from datetime import datetime

from normlake.operators import chunking as C
from normlake.operators import refs as N
from normlake.plans import retrieval_queries, table_queries, text_queries
from normlake.plans.runtime import table
from tests.conftest import rows

DATA = "/root/testdata/sf0.001"


def test_keys_and_labels_outside_ascii(spark, tmp_path):
    early, late = datetime(2024, 1, 1), datetime(2024, 2, 1)
    refs = [(1, 5, "KWG:§25a", late), (2, 5, "kwg:§25A", early), (3, 5, "CRR:Art.92", late), (4, 6, "KWG:§25a", late)]
    spark.createDataFrame(refs, "id long, context_id long, ref_key string, created_at timestamp").write.parquet(f"{tmp_path}/chunk_refs.parquet")
    nodes = [(7, 5, "Über Bank"), (8, 5, "Über BANK"), (9, 5, "über Bank"), (10, 5, "Bank")]
    spark.createDataFrame(nodes, "id long, context_id long, label string").write.parquet(f"{tmp_path}/ontology_nodes.parquet")
    got = rows(table_queries.QUERIES["a12_first_of_every_key"](spark, str(tmp_path)))
    assert got == {(5, "kwg:§25a", 1, early), (5, "crr:art.92", 3, late), (6, "kwg:§25a", 4, late)}
    # Only ASCII letters fold.
    got = rows(table_queries.QUERIES["l8_every_label"](spark, str(tmp_path)))
    assert got == {(5, "Über bank", 7), (5, "über bank", 9), (5, "bank", 10)}


def test_references_of_every_kind(spark, tmp_path):
    texts = [
        (1, 5, "Nach Artikel 279 Absatz 4 AUSV und § 12 BETG.", False),
        (2, 5, "Art. 92 CRR; die Verordnung (EU) Nr. 575/2013; Siehe AT 4.3.2.", False),
        (3, 5, "§§ 13 bis 14 DEPG", True),
        (4, 6, "§§ 13 bis 14 des Kreditwesengesetzes", False),
        (5, 6, "Nichts davon.", False),
        (6, 6, None, False),
    ]
    spark.createDataFrame(texts, "id long, context_id long, text string, is_omitted boolean").write.parquet(f"{tmp_path}/chunks.parquet")
    assert rows(text_queries.QUERIES["n9_all_references"](spark, str(tmp_path))) == {
        (1, 5, "AUSV:Art.279", "article"),
        (1, 5, "BETG:§12", "paragraph"),
        (2, 5, "CRR:Art.92", "article"),
        (2, 5, "EU:2013/575", "regulation"),
        (2, 5, "MARISK:AT4.3.2", "module"),
        (4, 6, "KWG:§13", "paragraph"),
        (4, 6, "KWG:§14", "paragraph"),
    }


def test_references_of_all_chunks_equal_a_plain_loop(spark):
    chunks = table(spark, DATA, "chunks").select("id", "context_id", "text", "is_omitted").collect()
    want = {(c.id, c.context_id, key, kind) for c in chunks if not c.is_omitted for key, kind, _, _ in N.references(c.text, text_queries.TABLE_LEXICON)}
    got = rows(text_queries.QUERIES["n9_all_references"](spark, DATA))
    assert got == want and {kind for *_, kind in got} >= {"paragraph", "article"}


def section(metadata: str | None) -> str | None:
    try:
        found = json.loads(metadata or "")
        return found.get("section") if isinstance(found, dict) else None
    except ValueError:
        return None


def sites(chunks: list, refs: list) -> dict[str, int]:
    """The site of every key, one key at a time."""
    kept = {c.id: c for c in chunks if not c.is_omitted}
    used = {(r.chunk_id, r.ref_key) for r in refs if r.chunk_id is not None}
    density = Counter(c for c, _ in used)
    out = {}
    for key in {r.ref_key for r in refs if r.ref_key is not None}:
        found = []
        of_key = [(kept[c], False) for c, k in used if k == key and c in kept]
        if m := re.fullmatch(r"(EU:[^:]+):Art\.(.+)", key):
            documents = {kept[c].document_id for c, k in used if k == m[1] and c in kept and kept[c].chunk_index <= 2}
            of_key += [(c, True) for c in kept.values() if c.document_id in documents and m[2] in " ".join(x for x in (c.text, c.signature, section(c.metadata)) if x)]
        for c, own in of_key:
            site = N.defines(key, c.text, (c.signature, section(c.metadata)), text_queries.TABLE_LEXICON)
            if site or not own:
                found.append((not own, not site, 0 if site else -density[c.id], c.document_id, c.chunk_index, c.id))
        if found:
            out[key] = min(found)[-1]
    return out


def test_sites_of_all_keys_and_expansion_of_all_questions(spark):
    chunks, refs = table(spark, DATA, "chunks").collect(), table(spark, DATA, "chunk_refs").collect()
    want = sites(chunks, refs)
    assert rows(text_queries.QUERIES["n15_definition_sites"](spark, DATA)) == set(want.items()) and want
    hits: dict[int, list] = {}
    for r in retrieval_queries.QUERIES["r13_keyword_batch"](spark, DATA).collect():
        hits.setdefault(r.query_id, []).append((r["rank"], r.id))
    expanded = set()
    for query, own in hits.items():
        primary = [c for _, c in sorted(own)]
        targets = []
        for c in primary:
            first: dict[str, int] = {}
            for r in sorted((r for r in refs if r.chunk_id == c and r.ref_key is not None), key=lambda r: r.id):
                first.setdefault(r.ref_key, r.id)
            targets.append([want[k] for k in first if k in want])
        expanded |= {(query, c, rank) for c, rank in N.expand_hits(primary, targets, 5)}
    assert rows(text_queries.QUERIES["n16_expanded_questions"](spark, DATA)) == expanded and expanded


def test_pieces_of_all_chunks_equal_a_plain_loop(spark):
    texts = [(c.id, c.text) for c in table(spark, DATA, "chunks").collect() if c.text]
    got = rows(text_queries.QUERIES["c1_chunk_sentences"](spark, DATA))
    assert got == {(i, n, *s) for i, t in texts for n, s in enumerate(C.sentences(t))}
    got = rows(text_queries.QUERIES["c2_chunk_segments"](spark, DATA))
    assert got == {(i, n, *s) for i, t in texts for n, s in enumerate(C.segments(t))}
    got = rows(text_queries.QUERIES["c4_chunk_windows"](spark, DATA))
    assert got == {(i, *w.values()) for i, t in texts for w in C.windows(C.segments(t), 60, 0.2)}
