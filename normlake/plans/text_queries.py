"""References and chunking: fixed cases with known results, and the whole tables.

SQL of a fixed case is the list of the known results; whole-table queries have
SQL where it can say the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from normlake.operators import chunking as C
from normlake.operators import refs as N
from normlake.plans.registry import Registry, values_sql
from normlake.plans.retrieval_queries import kept_index
from normlake.plans.runtime import cut, table

registry = Registry()
QUERIES, SQL = registry.queries, registry.sql
add = registry.add

#: Texts and the keys they name, in order.
NAMED = [
    ("Die Anforderungen des § 25a KWG sind einzuhalten.", "KWG:§25a"),
    ("gemäß §25a KWG", "KWG:§25a"),
    ("§ 25a Abs. 1 KWG", "KWG:§25a"),
    ("§ 25a Abs. 1 Satz 3 Nr. 1 KWG", "KWG:§25a"),
    ("Nach § 6 GwG hat das Institut …", "GWG:§6"),
    ("§ 6 Absatz 2 GwG", "GWG:§6"),
    ("die Vorgaben aus § 10 GwG", "GWG:§10"),
    ("§ 64a VAG", "VAG:§64a"),
    ("Pflichten nach § 80 WpHG", "WPHG:§80"),
    ("Regelungen des § 91 Abs. 2 AktG", "AKTG:§91"),
    ("nach Art. 28 DORA", "DORA:Art.28"),
    ("Artikel 28 DORA", "DORA:Art.28"),
    ("Art. 5 Abs. 1 DORA", "DORA:Art.5"),
    ("Art. 30 DORA regelt vertragliche Vereinbarungen.", "DORA:Art.30"),
    ("gemäß Art. 92 CRR", "CRR:Art.92"),
    ("Verordnung (EU) 2022/2554", "EU:2022/2554"),
    ("die Verordnung (EU) Nr. 575/2013 (CRR)", "EU:2013/575"),
    ("Verordnung (EU) 2016/679", "EU:2016/679"),
    ("Siehe AT 4.3.2 der MaRisk.", "MARISK:AT4.3.2"),
    ("Modul BTO 1.1", "MARISK:BTO1.1"),
    ("Anforderungen in BTR 2.1", "MARISK:BTR2.1"),
    ("BT 3 der MaRisk", "MARISK:BT3"),
    ("AT 4.3.2 Absatz 1", "MARISK:AT4.3.2"),
    ("gemäß AT 9 (Auslagerung)", "MARISK:AT9"),
    ("Absatz 3 dieses Artikels bleibt unberührt.", ""),
    ("wie in diesem Absatz beschrieben", ""),
    ("Art. 28 dieses Übereinkommens", ""),
    ("siehe Seite 28", ""),
    ("vgl. S. 128 des Berichts", ""),
    ("auf den Seiten 12 bis 15", ""),
    ("vom 28. Mai 2022", ""),
    ("im Jahr 2022", ""),
    ("Stand: 14.12.2022", ""),
    ("§ 5 Satz 1 des Vertrags", ""),
    ("gemäß § 3 der Ordnung", ""),
    ("Art. 12 des Anhangs", ""),
    ("§ 25a KWG verlangt Regelungen; ferner gelten AT 4.3.2 und § 25a Abs. 3 KWG sowie Art. 28 DORA.", "KWG:§25a,MARISK:AT4.3.2,DORA:Art.28"),
    ("Artikel 92 Absatz 1 Buchstabe c der Verordnung (EU) Nr. 575/2013", "EU:2013/575:Art.92,EU:2013/575"),
    ("Artikel 5 Absatz 1 und 2 der Verordnung (EU) 2022/2554", "EU:2022/2554:Art.5,EU:2022/2554"),
    ("Artikel 4 Absatz 1 Nummer 25 der Verordnung (EU) Nr. 575/2013", "EU:2013/575:Art.4,EU:2013/575"),
    ("in den Artikeln 3 bis 5 der Delegierten Verordnung (EU) 2024/1774", "EU:2024/1774:Art.3,EU:2024/1774:Art.4,EU:2024/1774:Art.5,EU:2024/1774"),
    ("Artikel 5 gilt entsprechend, wie in der Verordnung (EU) 2016/679 bestimmt", "EU:2016/679"),
    ("Artikel 12 findet Anwendung. Unberührt bleibt die Verordnung (EU) Nr. 575/2013.", "EU:2013/575"),
    ("Artikel 30 Verordnung (EU) Nr. 575/2013", "EU:2013/575"),
    ("nach § 6 des Geldwäschegesetzes", "GWG:§6"),
    ("§ 7 der Verordnung", ""),
    ("§ 25a KWG und die dazugehörigen Verwaltungsvorschriften", "KWG:§25a"),
    ("§§ 13 bis 13c des Vertrags", ""),
    ("Artikel 387 bis 410 der Anlage", ""),
]
RANGES = [
    ("§§ 13 bis 13c KWG", "13,13a,13b,13c"),
    ("§§ 13-13c KWG", "13,13a,13b,13c"),
    ("§§ 13–13c KWG", "13,13a,13b,13c"),
    ("§§ 17 bis 22 KWG", "17,18,19,20,21,22"),
    ("§§ 10c bis 10i KWG", "10c,10d,10e,10f,10g,10h,10i"),
    ("§§ 1 bis 100 KWG", "1,100"),
    ("§§ 13 bis 13c, 15 und 17 bis 22 des Kreditwesengesetzes", "13,13a,13b,13c,15,17,18,19,20,21,22"),
]


def _parsed(s: SparkSession, texts: list[str], lexicon: N.Lexicon | None = None) -> DataFrame:
    rows = s.createDataFrame([(i, 1, t, False) for i, t in enumerate(texts)], "id long, context_id long, text string, is_omitted boolean")
    found = N.extract(rows, lexicon)
    keys = F.transform(F.array_sort(F.collect_list(F.struct("start", "ord", "ref_key"))), lambda x: x["ref_key"])
    numbered = found.withColumn("ord", F.monotonically_increasing_id())
    return rows.join(numbered.groupBy(F.col("chunk_id").alias("id")).agg(keys.alias("keys")), "id", "left").select("text", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))


@add("n1_references", values_sql(["text", "keys"], NAMED))
def _(s: SparkSession, d: str) -> DataFrame:
    return _parsed(s, [t for t, _ in NAMED]).select("text", F.array_join("keys", ",").alias("keys"))


@add("n3_ranges", values_sql(["text", "numbers"], RANGES))
def _(s: SparkSession, d: str) -> DataFrame:
    numbers = F.transform("keys", lambda k: F.regexp_replace(k, "^KWG:§", ""))
    return _parsed(s, [t for t, _ in RANGES]).select("text", F.array_join(numbers, ",").alias("numbers"))


_REGULATIONS = [("575", "2013", "2013/575"), ("2022", "2554", "2022/2554"), ("2016", "679", "2016/679")]


@add("n4_regulation_number", values_sql(["a", "b", "number"], _REGULATIONS))
def _(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(a, b, N.regulation_number(a, b)) for a, b, _ in _REGULATIONS], "a string, b string, number string")


_OWN = [("§ 14 EnWG", "ENWG:§14"), ("§ 14 des Energiewirtschaftsgesetzes", "ENWG:§14"), ("§ 14 KWG", "")]


@add("n7_own_lexicon", values_sql(["text", "keys"], _OWN))
def _(s: SparkSession, d: str) -> DataFrame:
    lexicon = N.Lexicon.of([("enwg", ["Energiewirtschaftsgesetz"], True)])
    return _parsed(s, [t for t, _ in _OWN], lexicon).select("text", F.array_join("keys", ",").alias("keys"))


_EQUAL = [("CRR:Art.395", "CRR:Art.395,EU:2013/575:Art.395"), ("EU:2022/2554:Art.28", "EU:2022/2554:Art.28,DORA:Art.28"), ("KWG:§25a", "KWG:§25a")]


@add("n8_equivalent_keys", values_sql(["ref_key", "keys"], _EQUAL))
def _(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(k, ",".join(N.equivalent(k))) for k, _ in _EQUAL], "ref_key string, keys string")


#: The acts of the tables' texts are invented; as an own lexicon they are recognised.
TABLE_ACTS = "ausv betg depg divo emiv foeg grkv inrg krvg liqv mepv netv ofag pfhg sang truv verg wpav zasg zugv".split()
#: With the built-in acts beside them.
TABLE_LEXICON = N.Lexicon.of([(a, [N.ACT_NAMES[a]] if a in N.ACT_NAMES else [], True) for a in (*N.ACTS, *TABLE_ACTS)])


@add(
    "n9_plain_paragraphs",
    f"""SELECT DISTINCT id AS chunk_id, upper(m[2]) || ':§' || m[1] AS ref_key FROM (SELECT id, list_value(regexp_extract(x, '§\\s*(\\d+[a-z]?)', 1), regexp_extract(x, '([A-Z]{{4}})$', 1)) AS m
    FROM (SELECT id, unnest(regexp_extract_all(text, '§\\s*\\d+[a-z]?(?:\\s*,?\\s*(?:Abs(?:atz|\\.)?|Satz|Nr\\.?|Nummer|S\\.)\\s*\\d+[a-z]?)*\\s*(?:{"|".join(a.upper() for a in TABLE_ACTS)})(?:[^A-Za-zÄÖÜäöü]|$)', 0)) AS y, regexp_replace(y, '[^A-Za-zÄÖÜäöü]$', '') AS x FROM chunks WHERE NOT is_omitted))""",
)
def _(s: SparkSession, d: str) -> DataFrame:
    lexicon = N.Lexicon.of([(a, [], True) for a in TABLE_ACTS])
    found = N.extract(table(s, d, "chunks"), lexicon)
    return found.where("kind = 'paragraph'").select("chunk_id", "ref_key").distinct()


@add("n9_all_references")
def _(s: SparkSession, d: str) -> DataFrame:
    """References of every kind in all chunks that are not omitted; SQL has no grammar for them, so tested against a plain loop."""
    found = N.extract(table(s, d, "chunks"), TABLE_LEXICON)
    return found.select("chunk_id", "context_id", "ref_key", "kind").distinct()


@add("n10_reverse_lookup", "SELECT ref_key, count(DISTINCT chunk_id) AS chunks FROM chunk_refs WHERE chunk_id IN (SELECT id FROM chunks) GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    own = table(s, d, "chunks").select(F.col("id").alias("chunk_id"))
    return table(s, d, "chunk_refs").join(own, "chunk_id", "left_semi").groupBy("ref_key").agg(F.countDistinct("chunk_id").alias("chunks"))


_BOUND = [("§ 25", "gemäß § 25 KWG", True), ("§ 25", "gemäß § 25a KWG", False), ("AT 4.3", "siehe AT 4.3.", True), ("AT 4.3", "siehe AT 4.3.2", False), ("Artikel 395", "Artikel 395 (1)", True)]


@add("n12_bounded", values_sql(["surface", "text", "found"], _BOUND))
def _(s: SparkSession, d: str) -> DataFrame:
    import re

    return s.createDataFrame([(a, t, bool(re.search(N.bounded(a), t.lower()))) for a, t, _ in _BOUND], "surface string, text string, found boolean")


_CONFLICT = [("§25a VAG regelt dies", "§25a", "KWG", True), ("§25a KWG regelt dies", "§25a", "KWG", False), ("§25a regelt dies", "§25a", "KWG", False)]


@add("n13_other_act", values_sql(["text", "surface", "own", "conflict"], _CONFLICT))
def _(s: SparkSession, d: str) -> DataFrame:
    rows = [(t, a, o, N.names_other_act(t, a, o)) for t, a, o, _ in _CONFLICT]
    return s.createDataFrame(rows, "text string, surface string, own string, conflict boolean")


_SITES = [("EU:2013/575:Art.395", 7), ("KWG:§25", 2), ("KWG:§99", 4)]


def _site_case(s: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A regulation (document 1), its citing chunk, a norm with two sections, and one that is only mentioned."""
    chunks = [
        (20, 1, 0, "Verordnung (EU) Nr. 575/2013", None, None),
        (7, 1, 7, "Artikel 395 Obergrenze", None, None),
        (8, 1, 8, "Artikel 395a Ergänzung", None, None),
        (1, 2, 1, "Der Antrag nach § 25 KWG und Artikel 395 der Verordnung (EU) Nr. 575/2013", None, None),
        (2, 3, 2, "Meldungen", None, '{"section": "§ 25 (1)"}'),
        (3, 3, 3, "Weitere Meldungen", None, '{"section": "§ 25 (2)"}'),
        (5, 4, 1, "Nach § 99 KWG gilt dies.", None, None),
        (4, 4, 2, "Auch nach § 99 KWG und § 98 KWG gilt dies.", None, None),
        (6, 5, 0, "§ 25a KWG", "§25a", None),
    ]
    refs = [(20, "EU:2013/575"), (1, "EU:2013/575:Art.395"), (1, "KWG:§25"), (2, "KWG:§25"), (3, "KWG:§25"), (3, "KWG:§1"), (3, "KWG:§2"), (5, "KWG:§99"), (4, "KWG:§99"), (4, "KWG:§98"), (6, "KWG:§25a")]
    c = s.createDataFrame([(*r, False) for r in chunks], "id long, document_id long, chunk_index long, text string, signature string, metadata string, is_omitted boolean")
    return s.createDataFrame([(k,) for k, _ in _SITES], "ref_key string"), c, s.createDataFrame(refs, "chunk_id long, ref_key string")


@add("n15_definition_site", values_sql(["ref_key", "chunk_id"], _SITES))
def _(s: SparkSession, d: str) -> DataFrame:
    return N.resolve(*_site_case(s))


@add("n15_resolved_keys", "SELECT DISTINCT r.ref_key FROM chunk_refs r JOIN chunks c ON c.id = r.chunk_id WHERE NOT c.is_omitted AND r.ref_key IS NOT NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    """Every key with a citing chunk resolves, over the whole tables."""
    refs = table(s, d, "chunk_refs")
    return N.resolve(refs.where("ref_key is not null").select("ref_key"), table(s, d, "chunks"), refs).select("ref_key")


@add("n15_definition_sites")
def _(s: SparkSession, d: str) -> DataFrame:
    """The chunk that every cited key points to, over the whole tables; tested against a plain loop."""
    refs = table(s, d, "chunk_refs")
    return N.resolve(refs.where("ref_key is not null").select("ref_key"), table(s, d, "chunks"), refs, TABLE_LEXICON)


_ADDED = [(1, 100, 1), (1, 101, 2), (1, 103, 3), (2, 200, 2)]


@add("n16_expanded_hits", values_sql(["query_id", "chunk_id", "via_rank"], _ADDED))
def _(s: SparkSession, d: str) -> DataFrame:
    first = [(1, i + 1, c, t) for i, (c, t) in enumerate(zip(range(10, 15), [[100], [101, 102], [103], [104], [105]], strict=True))]
    second = [(2, 1, 10, [11]), (2, 2, 11, [10, 200])]
    rows = s.createDataFrame(first + second, "query_id long, rank long, chunk_id long, targets array<long>")
    # The second query asks for four hits: two may be added.
    return N.expand_all(rows, 5)


@add("n16_expanded_questions")
def _(s: SparkSession, d: str) -> DataFrame:
    """The five best chunks of every golden question, expanded by the sites of what they cite, in order of the citations."""
    queries = table(s, d, "eval_golden_entries").select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    chunks, refs = table(s, d, "chunks"), table(s, d, "chunk_refs")
    hits = cut(kept_index(s, d).batch(queries, 5).select("query_id", "rank", F.col("id").alias("chunk_id")))
    cited = refs.where("ref_key is not null").join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("chunk_id", "ref_key").agg(F.min("id").alias("id"))
    cited = cut(cited)
    sites = N.resolve(cited.select("ref_key"), chunks, refs, TABLE_LEXICON).withColumnRenamed("chunk_id", "site")
    targets = cited.join(sites, "ref_key").groupBy("chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "ref_key", "site"))), lambda x: x["site"]).alias("targets"))
    rows = hits.join(targets, "chunk_id", "left").select("query_id", "rank", "chunk_id", F.coalesce("targets", F.array().cast("array<long>")).alias("targets"))
    return N.expand_all(rows, 5)


@add("n17_refs_of_chunk", "SELECT DISTINCT chunk_id, id, ref_key FROM chunk_refs WHERE context_id = 3")
def _(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunk_refs").where("context_id = 3").select("chunk_id", "id", "ref_key").distinct().orderBy("chunk_id", "id")


# Chunking

_TEXTS = [
    ("Hello world. How are you? I am fine!", 3),
    ("Dr. Smith met Mr. Lee at 5 p.m. Then they left.", 2),
    ("Use nomic v1.5 now. Done.", 2),
]


@add("c1_sentences", values_sql(["text", "n"], _TEXTS))
def _(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(t, len(C.sentences(t))) for t, _ in _TEXTS], "text string, n long")


_LINES = "Überschrift\n- Punkt eins\n- Punkt zwei\nFließtext. Zweiter Satz."
_SEGMENTS = [(0, 0, 12, "Überschrift"), (1, 13, 25, "- Punkt eins"), (2, 26, 38, "- Punkt zwei"), (3, 39, 50, "Fließtext."), (4, 51, 64, "Zweiter Satz.")]


@add("c2_segments", values_sql(["idx", "start", "end_", "segment"], _SEGMENTS))
def _(s: SparkSession, d: str) -> DataFrame:
    found = C.segment_table(s.createDataFrame([(1, _LINES)], "doc_id long, text string"))
    return found.select(F.col("idx").cast("long").alias("idx"), "start", F.col("end").alias("end_"), "segment")


@add("c2_segment_coverage", "SELECT id AS doc_id, length(regexp_replace(text, '\\s', '', 'g'))::BIGINT AS chars FROM chunks WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0")
def _(s: SparkSession, d: str) -> DataFrame:
    """Every character but white space is in exactly one segment."""
    found = C.segment_table(table(s, d, "chunks"), key="id")
    return found.groupBy(F.col("id").alias("doc_id")).agg(F.sum(F.length(F.regexp_replace("segment", r"\s", ""))).alias("chars"))


_WINDOWS = [(0, 0, 3, "[0] Eins.\n[1] Zwei.\n[2] Drei.\n[3] Vier.")]


@add("c4_windows", values_sql(["idx", "first", "last", "text"], _WINDOWS))
def _(s: SparkSession, d: str) -> DataFrame:
    found = C.window_table(s.createDataFrame([(1, "Eins. Zwei. Drei. Vier.")], "doc_id long, text string"), 100_000, 0.1)
    return found.select("idx", "first", "last", "text")


@add("c5_window_coverage", "SELECT id AS doc_id, 0::BIGINT AS first, 0::BIGINT AS gaps FROM chunks WHERE trim(text) <> ''")
def _(s: SparkSession, d: str) -> DataFrame:
    """The windows of a text begin at its first segment and leave no segment out."""
    from pyspark.sql import Window

    found = C.window_table(table(s, d, "chunks"), 60, 0.2, key="id")
    w = Window.partitionBy("id").orderBy("idx")
    gap = (F.col("first") > F.lag("last").over(w) + 1).cast("long")
    return found.withColumn("gap", F.coalesce(gap, F.lit(0))).groupBy(F.col("id").alias("doc_id")).agg(F.min("first").alias("first"), F.sum("gap").alias("gaps"))


@add("c1_chunk_sentences")
def _(s: SparkSession, d: str) -> DataFrame:
    """The sentences of every chunk."""

    @F.pandas_udf("array<struct<start long, end long, sentence string>>")
    def cut_all(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield texts.map(lambda t: [{"start": a, "end": b, "sentence": x} for a, b, x in C.sentences(t)] if t else [])

    return table(s, d, "chunks").select("id", F.posexplode(cut_all("text")).alias("idx", "s")).select("id", "idx", "s.*")


@add("c2_chunk_segments")
def _(s: SparkSession, d: str) -> DataFrame:
    """The segments of every chunk."""
    return C.segment_table(table(s, d, "chunks"), key="id")


@add("c4_chunk_windows")
def _(s: SparkSession, d: str) -> DataFrame:
    """The windows of every chunk with their texts."""
    return C.window_table(table(s, d, "chunks"), 60, 0.2, key="id")


_BODY = "A eins. B zwei. C drei. D vier. E fuenf."
_ASSEMBLED = [
    ("two", 0, 0, 15, "A eins.\nB zwei.", None),
    ("two", 1, 16, 40, "C drei.\nD vier.\nE fuenf.", None),
    ("one", 0, 0, 40, "A eins.\nB zwei.\nC drei.\nD vier.\nE fuenf.", None),
    ("left", 0, 0, 40, "A eins.\nC drei.\nD vier.\nE fuenf.", None),
    ("heading", 0, 0, 15, "A eins.\nB zwei.", "§1"),
    ("heading", 1, 16, 40, "C drei.\nD vier.\nE fuenf.", "§1"),
]
_ANSWERS = {"two": '{"starts": [0, 2]}', "one": '{"starts": []}', "left": '{"starts": [0], "leave_out": [1]}', "heading": '{"starts": [{"i": 0, "section": "§1"}, {"index": 2}]}'}


@add("c6_assembled", values_sql(["name", "chunk_index", "char_start", "char_end", "text", "section"], _ASSEMBLED))
def _(s: SparkSession, d: str) -> DataFrame:
    rows = [(k, c["chunk_index"], c["char_start"], c["char_end"], c["text"], c["section"]) for k, a in _ANSWERS.items() for c in C.assemble(_BODY, [C.read_response(a)])]
    return s.createDataFrame(rows, "name string, chunk_index long, char_start long, char_end long, text string, section string")


_LONG = "Das Institut hat den Bericht vorzulegen und die Frist zu wahren. " * 4
_STRUCTURAL = [
    ("gap", 0, "Art. 1", "Begriffsbestimmungen"),
    ("heading", 0, "", ""),
    ("heading", 1, "Art. 1", "Begriffsbestimmungen"),
    ("plain", 0, "", ""),
    ("tail", 0, "", ""),
]


@add("c7_structural", values_sql(["name", "chunk_index", "section", "title"], _STRUCTURAL))
def _(s: SparkSession, d: str) -> DataFrame:
    """No gap gives one chunk; a heading begins one, unless nothing stands before it; a short tail joins the chunk before."""
    head = "Art. 1 Begriffsbestimmungen"
    cases = {
        "plain": [(_LONG, 10.0, 100), (_LONG, 10.0, 220)],
        "heading": [(_LONG, 10.0, 100), (head, 10.0, 400), (_LONG, 10.0, 520)],
        "gap": [(head, 10.0, 100), (_LONG, 10.0, 220)],
        "tail": [(_LONG, 10.0, 100), ("Inhalt ........ 3", 10.0, 220), ("7 kurzer Schluss.", 10.0, 600)],
    }
    rows = [(i, 0, y, n, t, size, False) for i, c in enumerate(cases.values()) for n, (t, size, y) in enumerate(c)]
    lines = s.createDataFrame(rows, "doc_id long, page long, y long, line_no long, text string, size double, bold boolean")
    names = s.createDataFrame(list(enumerate(cases)), "doc_id long, name string")
    # Numbered paragraphs of the last case are no headings under a profile of trigger words.
    profile = C.LineProfile.from_triggers("Art., §", "bezeichnet", "Amtsblatt", 1500)
    return C.structural_table(lines, profile).join(names, "doc_id").select("name", "chunk_index", "section", "title")


_TRIGGERS = [("§ 5 Meldung", "heading_l1"), ("im Sinne dieses Gesetzes", "definition"), ("Amtsblatt der Union", "ignore"), ("Ein Satz.", "")]


@add("c9_trigger_words", values_sql(["text", "role"], _TRIGGERS))
def _(s: SparkSession, d: str) -> DataFrame:
    compiled = C.LineProfile.from_triggers("§, Art.", "im Sinne, bezeichnet", "Amtsblatt", 1000).compiled()
    rows = [(t, next((r for r, p in compiled if p.search(t)), "")) for t, _ in _TRIGGERS]
    return s.createDataFrame(rows, "text string, role string")
