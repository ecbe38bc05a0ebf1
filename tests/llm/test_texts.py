from __future__ import annotations

import base64
import re
import time
from collections import Counter
from datetime import datetime as D

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from normlake.llm import bpe, near_copies, packing, pairs, spam
from normlake.llm.components import connected_components
from normlake.llm.conversations import conversations, unfit_sessions
from tests.conftest import rows

# Encoding


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, bpe.vocabulary("byte_bpe_50k").splitlines())}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.PrefixEncoder(bpe.vocabulary("byte_bpe_50k"))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_equal_the_reference(encoder, reference, text):
    got = [int(i) for ids in encoder.encode_block([text])[0] for i in ids]
    assert got == reference.encode_ordinary(text)


def test_encoding_edge_cases(spark, reference):
    texts = [None, "", "   ", "<|endoftext|> Prüfung", "a" * 5000, "Wort " * 3000, "Wort"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(6, "Wort", "x")], "doc_id long, text string, ids string")
    got = bpe.encode(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.ids == reference.encode_ordinary(texts[r.doc_id] or "")
    counts = {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()}
    assert counts[0] == 0 and counts[4] == len(reference.encode_ordinary(texts[4]))


# Packing


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 300), max_size=25))
def test_plans_are_feasible(counts):
    intervals, n = packing.plan(counts, 100, groups=6)
    fill = Counter()
    placed = Counter()
    for size, first, container, length in intervals:
        placed[size] += length
        for i in range(length):
            fill[container + i] += size
    assert placed == Counter(counts)
    assert all(f <= 100 for f in fill.values())
    assert len(fill) == n
    # Never worse than twice the bound, and near it for many items.
    total = sum(s * c for s, c in counts.items())
    assert n <= 2 * total / 100 + 1


def test_packing_of_odd_rows(spark):
    sizes = spark.createDataFrame([(1, 0), (2, None), (3, 10), (4, 25), (5, 10), (5, 10), (6, 3)], "doc_id long, n_tokens long")
    got = packing.pack(sizes, 10).collect()
    assert Counter(r.doc_id for r in got) == Counter({1: 1, 2: 1, 3: 1, 4: 3, 5: 2, 6: 1})
    fill = Counter()
    for r in got:
        fill[r.container] += r.n_tokens
    assert max(fill.values()) <= 10 and sum(fill.values()) == 58
    assert [(r.start, r.n_tokens) for r in sorted(got, key=lambda r: r.piece) if r.doc_id == 4] == [(0, 10), (10, 10), (20, 5)]
    assert packing.pack(sizes.where("false"), 10).count() == 0


def test_packing_fills_containers(spark):
    rng = np.random.default_rng(0)
    data = [(i, int(x)) for i, x in enumerate(np.clip(rng.lognormal(5.3, 0.8, 4000), 1, 2048))]
    got = packing.pack(spark.createDataFrame(data, "doc_id long, n_tokens long"), 2048).toPandas()
    fill = got.groupby("container")["n_tokens"].sum()
    assert fill.max() <= 2048 and len(fill) <= 1.01 * fill.sum() / 2048 + 1


# Components


def test_components_against_union_find(spark):
    rng = np.random.default_rng(1)
    shapes = [[(i, i + 1) for i in range(200)], [(0, i) for i in range(1, 200)], [(i, (i + 1) % 50) for i in range(50)], [tuple(map(int, p)) for p in rng.integers(0, 150, (400, 2))], [(5, 5), (1, None), (None, 2)]]
    for pairs_ in shapes:
        up: dict[int, int] = {}

        def root(v: int, up: dict[int, int] = up) -> int:
            up.setdefault(v, v)
            while up[v] != v:
                v = up[v]
            return v

        for a, b in pairs_:
            if a is not None and b is not None and a != b:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
        df = spark.createDataFrame([*pairs_, *[(b, a) for a, b in pairs_[:3]]], "a long, b long")
        assert rows(connected_components(df)) == {(v, root(v)) for v in list(up)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Conversations

T = [D(2024, 1, 1, 0, 0, i) for i in range(10)]
CHAT = "id long, session_id long, role string, content string, tool_calls_json string, created_at timestamp, turn string"


def chat(*messages):
    return [(i, *m, "extra") for i, m in enumerate(messages)]


@pytest.mark.parametrize("hot", [1, 10**6])
def test_sessions(spark, hot):
    data = chat(
        (1, "user", "q", None, T[0]), (1, " Model", "a", None, T[1]), (1, "ASSISTANT", "a", None, T[1]),
        (2, "user", "q", None, T[0]), (2, "user", "q2", None, T[1]), (2, "ai", "a", None, T[2]),
        (3, "assistant", "a", None, T[0]), (4, "user", "  ", None, T[0]), (4, "system", "s", None, T[1]),
        (5, "user", "q", None, T[0]), (5, "???", "x", None, T[1]), (5, "ai", "a", None, T[2]),
        (6, "user", "q", None, T[0]), (6, "ai", "", "[]", T[1]), (6, "tool", "r", None, T[2]), (6, "ai", "a", None, T[3]),
        (7, "user", "q", None, T[1]), (7, "ai", "a", None, T[1]), (7, "ai", "b", None, T[2]),
        (None, "user", "q", None, T[0]), (8, None, None, None, None), (9, "user", "q", None, T[0]),
    )
    df = spark.createDataFrame(data, CHAT)
    assert rows(unfit_sessions(df, hot)) == {(2, "no_reply"), (3, "broken"), (4, "empty"), (5, "broken"), (7, "broken"), (8, "empty"), (9, "no_reply")}
    assert rows(conversations(df, hot)) == {(1, 1, "user", 0), (1, 2, "assistant", 1), (6, 1, "user", 12), (6, 2, "assistant", 15)}
    assert rows(unfit_sessions(df.where("false"), hot)) == set()


def test_log_of_edits_and_deletes(spark):
    """(message, version, kind, session, role, content, time): the last version of each message counts, deleted ones are gone."""
    log = [
        ("a", 1, "create", 1, "user", "q", T[0]), ("b", 1, "create", 1, "ai", "x", T[1]), ("b", 2, "edit", 1, "ai", "y", T[5]), ("b", 2, "retry", 1, "ai", "x", T[6]), ("b", None, "create", 1, "ai", "old", T[1]),
        ("c", 1, "create", 2, "user", "q", T[0]), ("d", 1, "create", 2, "ai", "a", T[1]), ("e", 1, "create", 2, "ai", "b", T[2]), ("e", 2, "delete", 2, "ai", "b", T[3]), ("e", 3, "retry", 2, "ai", "b", T[4]),
        ("f", 1, "create", 3, "user", "q", T[0]), ("g", 1, "create", 3, "ai", "a", T[1]), ("g", 2, "delete", 3, None, None, T[2]),
        ("h", 1, "create", 4, "user", "q", T[0]), ("h", 2, "delete", 4, "user", None, T[1]),
        ("i", 1, "create", 5, "user", "q", T[0]), ("j", 1, "create", 5, "ai", "a", T[1]), ("j", 2, "delete", 5, "ai", None, T[2]), ("j", 3, "edit", 5, "ai", "again", T[3]),
        ("k", 1, "CREATE", 6, "user", "q", T[0]), ("l", 3, "edit", 6, "ai", "", T[1]), ("l", 2, "create", 6, "ai", "a", T[1]),
        ("m", 1, "retry", 7, "user", "q", T[0]), ("n", 1, "retry", 7, "ai", "a", T[1]), ("o", 1, "create", 7, "ai", "a", T[1]),
    ]
    df = spark.createDataFrame([(*r, None) for r in log], "id string, revision long, event string, session_id long, role string, content string, created_at timestamp, tool_calls_json string")
    names = {"kind": "event", "version": "revision"}
    for hot in (1, 10**6):
        assert rows(unfit_sessions(df, hot, **names)) == {(3, "no_reply"), (6, "no_reply")}
        got = rows(conversations(df, hot, **names))
        assert got == {(1, 1, "user", "a"), (1, 2, "assistant", "b"), (2, 1, "user", "c"), (2, 2, "assistant", "d"), (5, 1, "user", "i"), (5, 2, "assistant", "j"), (7, 1, "user", "m"), (7, 2, "assistant", "n")}


def test_many_messages_of_one_time(spark):
    """One session, one timestamp: its pieces are cut between ids."""
    data = chat(*[(1, "user" if i % 2 == 0 else "ai", f"m{i}", None, T[0]) for i in range(60)])
    df = spark.createDataFrame(data, CHAT)
    assert rows(unfit_sessions(df, 7)) == set()
    assert rows(conversations(df, 7).select("turn", "message_id")) == {(i + 1, i) for i in range(60)}


# Pairs

P = "Welche Frist gilt für die Meldung des Kontos?"


@pytest.mark.parametrize(
    ("response", "error", "want"),
    [
        (None, None, "empty"), ("", "HTTP 502", "empty"), ("​", None, "empty"), ("<p></p>", None, "empty"), ("{}", None, "empty"), ("**Antwort:**\n\n", None, "empty"),
        ("Nach 5 Tagen", None, None), ("Ja", None, None), ("§ 5 Abs. 2 ABCD", None, None), ("Im Abschnitt findet sich hierzu keine Regelung.", None, None),
        (P + "\nDie Meldung ist binnen 5 Tagen abzugeben.", None, None), (P.upper(), None, "copy"), ("„" + P + "“", None, "copy"),
        ("Es tut mir leid, das darf ich nicht beantworten.", None, "refusal"), ('{"answer": "I cannot help with that.", "refs": []}', None, "refusal"),
        ("Die Bank kann dies nicht verweigern, da § 4 es nicht gestattet.", None, None),
        ("The report is to be handed in within the period by the firm.", None, "other_language"),
        ("Die Meldung ist abzugeben. Das Konto ist nach der", None, "truncated"), ('{"answer": "Die Meldung ist', None, "truncated"), ("Das Konto umfasst:\n- den Bericht\n- ", None, "truncated"),
        ("Die Meldung ist abzugeben. Für das konsolidierte Währung", None, "truncated"), ("Die Meldung ist abzugeben. Bei der Förder", None, "truncated"),
        ("Ja, mit Ausnahme von § 77 Satz 1 Nr. 10 VERG", None, None),
        ("Die Meldung ist abzugeben. ", "finish_reason=length", "truncated"), ("```\nDie Meldung ist abzugeben.\n```", None, None), ("Satz. " * 5000, None, None),
    ],
)
def test_defects(response, error, want):
    assert pairs.defect(P, response, "done", error) == want


def test_defects_of_rows(spark):
    data = [(1, P, None, "done", None, "x"), (1, P, None, "done", None, "x"), (2, P, None, "queued", None, "x"), (3, None, "Ja", "done", None, "x"), (4, None, None, None, None, None)]
    df = spark.createDataFrame(data, "id long, prompt string, response string, status string, error string, defect string")
    assert rows(pairs.find_broken_pairs(df)) == {(1, "empty")}
    assert rows(pairs.find_broken_pairs(df.where("false"))) == set()
    assert pairs.defect("Antworte auf Englisch: " + P, "The report is due within the period.", "done", None) is None


@pytest.mark.parametrize(
    ("prompt", "response", "want"),
    [
        (P, "Dazu äußere ich mich nicht.", "refusal"), (P, "Dazu gebe ich keine Auskunft.", "refusal"), (P, "Diese Anfrage liegt außerhalb dessen, was ich bearbeite.", "refusal"),
        (P, "No comment.", "refusal"), (P, "Bank powinien przedstawić sprawozdanie i nie może go odrzucić.", "other_language"), (P, "Банк обязан представить отчёт.", "other_language"),
        (P, "La banca deve presentare la relazione alla fine del mese.", "other_language"), (P, "Die Bank gibt dem Kunden auf Antrag Auskunft.", None), (P, "Das Institut äußert sich binnen 5 Tagen zu dem Bericht.", None),
        ("Which period applies to the account?", "That is not a matter I will speak about.", "refusal"), ("Which period applies to the account?", "The bank will not answer for losses.", None),
    ],
)
def test_wordings_that_are_not_in_the_sample(prompt, response, want):
    assert pairs.defect(prompt, response, "done", None) == want


def test_held_out_clauses():
    """Fitted without every fourth labelled clause, and measured on responses made of those alone."""
    texts, _ = pairs.labelled_clauses()
    held = set(texts[::4])
    model = pairs.Tagger.fit(usable=set(texts) - held)
    sample = pairs.composed(99, 1200, held)
    got = model.defects([(p, r, "done", e) for p, r, e, _ in sample])

    def truth(prompt: str, response: str, error: str | None, letters: str) -> str | None:
        parts, _ = pairs.describe(prompt, response, error)
        if len(parts) != len(letters):
            return "?"
        size = Counter()
        for p_, l in zip(parts, letters, strict=True):
            size[l] += len(p_) / sum(map(len, parts))
        return "truncated" if letters[-1] == "u" else "refusal" if size["r"] > 0.5 else "copy" if size["e"] >= 0.9 else "other_language" if size["f"] > 0.5 else None

    wanted = [truth(*s) for s in sample]
    both = Counter((w, g) for w, g in zip(wanted, got, strict=True) if w != "?")
    for kind in ("truncated", "refusal", "copy", "other_language"):
        hit = both[kind, kind]
        # A third of the refusals in wordings it has never seen look like statements to it.
        assert hit >= 0.7 * sum(n for (w, _), n in both.items() if w == kind), (kind, both)
        assert hit >= 0.9 * sum(n for (_, g), n in both.items() if g == kind), (kind, both)


# Near copies


def similarity(a: str, b: str) -> float:
    x, y = (Counter(re.findall(r"[^\W_]+", t.lower())) for t in (a, b))
    shared = sum((x & y).values())
    return shared / (sum(x.values()) + sum(y.values()) - shared)


def test_near_copies_against_brute_force(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(600)]
    texts = [" ".join(rng.choice(vocabulary, int(rng.integers(12, 60)))) for _ in range(150)]
    for i in range(60):
        words = texts[i].split()
        for _ in range(int(rng.integers(0, 6))):
            words[int(rng.integers(len(words)))] = "neu"
        texts.append(" ".join(rng.permutation(words)))
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if similarity(texts[a], texts[b]) >= 0.75}
    df = spark.createDataFrame([(0, i, t, "x") for i, t in enumerate(texts)], "kind int, id long, text string, content string")
    got = rows(near_copies.near_copies(df).select("id_a", "id_b"))
    assert got <= want and len(got) >= 0.95 * len(want)


def test_groups_of_copies_stay_linear(spark):
    same = "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf"
    near = same.replace("zwölf", "dreizehn")
    data = [(0, i, same) for i in range(40)] + [(0, 0, same), (0, 50, near), (0, 51, None), (0, 52, ""), (0, 53, "zu kurz"), (1, 60, same), (1, 61, same.upper())]
    got = rows(near_copies.near_copies(spark.createDataFrame(data, "kind int, id long, text string")).select("kind", "id_a", "id_b"))
    assert got == {(0, 0, i) for i in range(1, 40)} | {(0, 0, 50), (1, 60, 61)}
    assert near_copies.near_copies(spark.createDataFrame([], "kind int, id long, text string")).count() == 0


def test_different_texts_of_a_large_class(spark):
    """Copies hang on the first row of their text; texts that only have the same words stand in all pairs."""
    same = "eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf"
    other, third = same.upper(), " ".join(same.split()[::-1])
    near = same.replace("zwölf", "dreizehn")
    data = [(0, i, same) for i in range(20)] + [(0, 20 + i, other) for i in range(3)] + [(0, 30, third), (0, 40, near)]
    got = rows(near_copies.near_copies(spark.createDataFrame(data, "kind int, id long, text string")).select("id_a", "id_b"))
    stars = {(0, i) for i in range(1, 20)} | {(20, 21), (20, 22)}
    assert got == stars | {(0, 20), (0, 30), (20, 30)} | {(0, 40), (20, 40), (30, 40)}


def test_variants_in_blocks(spark, monkeypatch):
    """A variant of more texts than a block is compared in pairs of blocks, and nothing is lost."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(40)]
    texts = []
    for i in range(60):
        words = list(base)
        words[int(rng.integers(40))] = f"x{i}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "kind int, id long, text string")
    want = rows(near_copies.near_copies(df).select("id_a", "id_b"))
    # The words of the group, which is all of the corpus, keep their weight.
    assert len(want) >= 0.98 * (60 * 59 // 2)
    tokens = near_copies.tokenise(df)
    packed = near_copies.signed(tokens, near_copies.word_weights(tokens), 2)
    assert rows(near_copies.candidates(packed, 2, block=7).distinct()) == rows(near_copies.candidates(packed, 2).distinct())


def test_passes_leave_no_shuffle_behind(spark, monkeypatch):
    """Segments in passes find the same pairs, and what a pass shuffled is gone when the pairs are known."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(600)]
    texts = [" ".join(rng.choice(vocabulary, 30)) for _ in range(300)]
    texts += [t.replace(t.split()[3], "neu", 1) for t in texts[:150]]
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "kind int, id long, text string")
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    kept = lambda: {f for f in disk.getAllFiles().mkString("\n").split("\n") if f.endswith(".data")}
    tokens = near_copies.tokenise(df).cache()
    weights = near_copies.word_weights(tokens)
    members = near_copies.text_keys(tokens, weights).cache()
    rows_ = members.count()
    found = []
    for variants in (10**9, 10_000):
        monkeypatch.setattr(near_copies, "PASS_VARIANTS", variants)
        before = kept()
        links = near_copies.settled(near_copies.similar_contents(tokens, members, weights, rows_))
        # Files are dropped by another thread.
        for _ in range(50):
            if kept() <= before:
                break
            time.sleep(0.2)
        assert kept() <= before
        found.append(rows(links.distinct()))
    assert len(found[0]) >= 145 and found[0] == found[1]


# Spam pages

LAW = "Die Bank muss den Bericht nach § 5 der Verordnung bis zum 7. Werktag prüfen und der Stelle in der Stadt vorlegen. "


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (LAW * 6, False),
        ("Inhalt\n" + "\n".join(f"{i}. der Bericht Nummer {i} ........ {i + 3}" for i in range(1, 30)), False),
        ("\n".join(f"{2000 + i} | 20,{i} | 4{i}76" for i in range(30)), False),
        (LAW * 3 + "\nKeywords: bericht, bank, prüfung", False),
        ("Depotplan", False),
        ("\n".join(f"https://go.stelle{i}.example/plan/{i}" for i in range(20)), True),
        (" ".join(f"<a href='https://a{i}.example/x'>Plan {i}</a> |" for i in range(20)), True),
        (", ".join(["Depotplan", "Depotplan kaufen", "Zinsplan günstig"] * 15), True),
        ("Tags: " + ", ".join(f"#wort{chr(97 + i % 26)}{chr(97 + i // 26)}plan" for i in range(40)), True),
        ("Unser Depotplan ist das beste Depotplan für Depotplan Kunden. Depotplan kaufen, Depotplan mieten, Depotplan testen! " * 6, True),
        (LAW + ("Depotplan Basic | Art. 12 | 3,10 EUR | online | zinsplan, berichtsplan\n" * 12), True),
        (LAW * 20 + "https://a.example/x " * 3, False),
    ],
)
def test_spam(spark, text, want):
    # The thresholds are calibrated on the corpus: give it a plain one.
    data = [(i, LAW * (2 + i % 5), "de", "x") for i in range(40)] + [(99, text, None, "x"), (100, None, None, None), (101, "", "fr", "x")]
    found = rows(spam.find_spam_pages(spark.createDataFrame(data, "doc_id long, text string, lang string, windows string")))
    assert found == ({(99,)} if want else set())


PROSE = {
    "pl": "Bank powinien przedstawić sprawozdanie najpóźniej siódmego dnia roboczego, a organ nadzoru sprawdza je w ciągu miesiąca. Jeżeli umowa zostanie rozwiązana, klient otrzymuje pisemne potwierdzenie wraz z wyjaśnieniem przyczyn. ",
    "es": "El banco debe presentar el informe a más tardar el séptimo día hábil y la autoridad lo revisa en el plazo de un mes. Si se rescinde el contrato, el cliente recibe una confirmación por escrito con los motivos. ",
    "ru": "Банк обязан представить отчёт не позднее седьмого рабочего дня, а орган надзора проверяет его в течение месяца. Если договор расторгнут, клиент получает письменное подтверждение с объяснением причин. ",
    "ja": "銀行は第七営業日までに報告書を提出しなければならず、監督機関は一か月以内にそれを審査する。契約が解除された場合、顧客は理由を記した書面による確認を受け取る。",
    "sv": "Banken ska lämna rapporten senast den sjunde arbetsdagen och tillsynsmyndigheten granskar den inom en månad. Om avtalet sägs upp får kunden en skriftlig bekräftelse med skälen. ",
}
LAWS = [" ".join(w) for w in (LAW.split(), ("Der Ausschuss hat die Meldung der Filiale " + LAW).split(), ("Wenn die Frist für das Konto nicht gilt, ist es von der Stelle zu sperren. " + LAW).split())]


@pytest.mark.parametrize("named", [True, False])
def test_prose_of_other_languages_is_no_spam(spark, named):
    """With and without its name, few pages or many; keywords of such a language are found once it has pages."""
    plain = [(i, (LAWS[i % 3] + " ") * (2 + i % 5), "de") for i in range(60)]
    few = [(100 + i, t * 4, l if named else None) for i, (l, t) in enumerate(PROSE.items())]
    schema = "doc_id long, text string, lang string"
    assert rows(spam.find_spam_pages(spark.createDataFrame(plain + few, schema))) == set()
    many = [(1000 + 50 * i + j, " ".join(np.random.default_rng(j).permutation(t.split(". "))) * 3, l if named else None) for i, (l, t) in enumerate(PROSE.items()) for j in range(40)]
    stuffed = [(9000, "сберплан, кредитплан, сберплан дёшево, кредитплан онлайн, вкладплан выгодно, " * 8, "ru" if named else None)]
    assert rows(spam.find_spam_pages(spark.createDataFrame(plain + many + stuffed, schema))) == {(9000,)}


def test_any_number_of_languages(spark):
    """Eighty languages of their own words: those of fewest pages have function words, too."""
    rng = np.random.default_rng(6)
    data, listed = [], {}
    for k in range(80):
        name = chr(97 + k // 26) + chr(97 + k % 26)
        if name in spam.FUNCTION_WORDS:
            continue
        word = lambda i, name=name: f"{name}{chr(97 + i // 26)}{chr(97 + i % 26)}"
        listed[name] = {word(i) for i in range(6)}
        for page in range(30 if k < 75 else 22):
            sentences = [" ".join(word(int(i)) for x in rng.integers(6, 600, 6) for i in (rng.integers(6), x)) + "." for _ in range(8)]
            data.append((len(data), " ".join(s.capitalize() for s in sentences), name))
    stuffed = [(10_000 + i, " ".join(f"{n}{chr(97 + j // 26)}{chr(97 + j % 26)}" for j in rng.permutation(np.arange(6, 600))[:60]), n) for i, n in enumerate(("cb", "cx"))]
    stuffed = [x for x in stuffed if x[2] in listed]
    df = spark.createDataFrame(data + stuffed, "doc_id long, text string, lang string")
    known = spam.corpus_languages(df)
    for name, words in listed.items():
        assert words <= known.function[known.place[name]], name
    assert rows(spam.find_spam_pages(df)) == {(x[0],) for x in stuffed}


def test_pages_of_repeated_lines(spark):
    plain = [(i, (LAWS[i % 3] + " ") * (2 + i % 5), "de") for i in range(60)]
    again = [(100, "Jetzt den günstigen Plan für die ganze Familie sichern und mit der Bank sparen.\n" * 12, "de"), (101, "\n".join(LAWS), "de"), (102, None, "de"), (103, "\n\t ", None)]
    assert rows(spam.find_spam_pages(spark.createDataFrame(plain + again, "doc_id long, text string, lang string"))) == {(100,)}


def test_spam_of_an_empty_table(spark):
    assert spam.find_spam_pages(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_windows_hold_the_whole_text():
    text = spam.normalise((LAW + "\n- kurz\n- kürzer\n") * 50)
    assert "".join("".join(spam.windows(text)).split()) == "".join(text.split())
