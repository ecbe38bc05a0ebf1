"""Broken prompt and response pairs.

A response is taken out of its wrapping (code fence, JSON, heading), cut into
clauses, and each clause is tagged as answer, refusal, echo, foreign or
unfinished by a conditional random field, whose transitions settle clauses that
say little alone (courtesies go with what stands beside them). The share of the
response that each tag covers makes the defect of the pair.

What a clause does is told by its letters: weights of hashed letter sequences
and word pairs, fitted to the labelled clauses of pair_examples. Everything else
the field sees is form: overlap with the prompt, language and script beside the
prompt's, place, length, marks and the last word. All weights are fitted; no
feature stands for a tag.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from normlake.llm.crf import LinearChainCRF
from normlake.llm.pair_examples import CLAUSES, ITEMS, KINDS, LOOSE_ENDS, OTHERS, PROMPTS, RESPONSES, SHORT

LABELS = ("answer", "refusal", "echo", "foreign", "unfinished")
#: Statuses of finished rows, and errors that say that an answer was cut off. Fixed values.
FINISHED = ("done", "error")
CUT_OFF = re.compile(r"finish_reason=length|max_tokens|stream closed|truncat", re.I)
#: Share of a response that must be refused, repeated or foreign.
REFUSED, REPEATED, FOREIGN = 0.5, 0.9, 0.5
#: Buckets of letter sequences and word pairs.
BUCKETS = 1 << 16
#: Responses put together from the labelled clauses to fit the field: a bounded sample.
COMPOSED = 1500

#: Frequent words that tell the languages apart. The first three go before the others on a tie.
WORDS = {
    "de": "der die das den dem des ein eine einen einem einer und oder ist sind wird werden hat haben nicht von zu mit nach für auf im am bei als auch bis so soweit wenn dass ich sie es wer wie muss kann darf dürfen zum zur über unter sowie keine kein gilt ja nein prozent werktagen werktag artikel satz abs nr welche frage antwort erst sein mir meinen dazu diese dieser diesem gern leider bitte".split(),
    "en": "the a an of and or is are was were be been has have had not by to with for from in on at as that which who this these if it its i you shall must may can only also under within between where when yes no per cent section article working days what any than no such after does".split(),
    "fr": "le la les l un une des du de d et ou est sont était être a ont pas par pour avec dans sur au aux ce cette ces il elle je vous ne que qui se son sa ses leur doit peut selon lorsque sans ainsi entre après oui non pour jours délai si article plus quel quelles quels sauf cas moins tous mois".split(),
    "es": "el los las una del que en los por con para se su como más pero debe puede según cuando sin entre después sí días plazo mes si artículo este esta son está ha al lo y".split(),
    "it": "il lo gli una del della dei delle che di per con non si come più ma deve può secondo quando senza tra dopo giorni termine mese se articolo questo questa sono è ha al alla nel entro ed".split(),
    "nl": "het een van en niet dat zijn wordt worden aan met voor op door naar ook maar moet kan mag volgens wanneer zonder tussen na dagen termijn maand artikel deze dit heeft bij te er".split(),
    "pl": "w i z na do nie się jest oraz że od po przez dla może musi powinien lub jeżeli gdy bez dni termin miesiąc artykuł ten ta są ma go jego jej ich za".split(),
    "sv": "och att det som en ett är inte på av för med till den de om har ska kan får enligt när utan mellan efter dagar månad artikel denna detta vid från".split(),
}
_FIRST = ("de", "en", "fr")
_OF_WORD: dict[str, tuple[int, ...]] = {}
_NAMES = tuple(WORDS)
for _i, _listed in enumerate(WORDS.values()):
    for _w in _listed:
        _OF_WORD[_w] = (*_OF_WORD.get(_w, ()), _i)
#: Names of the languages in a request to answer in one of them.
ASKED = {"deutsch": "de", "german": "de", "allemand": "de", "englisch": "en", "english": "en", "anglais": "en", "französisch": "fr", "french": "fr", "français": "fr"}
_ASKED = re.compile(rf"\b(?:auf|in|en) ({'|'.join(ASKED)})\b", re.I)
HEADING = re.compile(r"^[\s*_#>`„“”\"'«»]*(?:antwort|answer|response|réponse|frage|question)\s*:?[\s*_:]*", re.I)
#: Words after which a sentence goes on.
GOES_ON = frozenset("der die das den dem des ein eine einen einem einer und oder sowie von zu mit nach für auf im in an bei als bis wenn dass weil wobei insbesondere gemäß nicht the a an of and or by to with for from in on at as that which under because when where if including accordance le la les un une des du de et ou par pour avec dans sur au aux que qui selon car parce lorsque si notamment ainsi".split())
_ABBREVIATED = re.compile(r"(?:\b(?:Abs|Nr|Art|Sec|No|al|vgl|ca|bzw|z|B|S)\.|(?:^|\s)\d{1,3}\.)$")
_ENDS = re.compile(r"[.!?…][\"'”“»«)\]*`]*$")
#: Words that a bare citation, with or without a yes or no, is made of.
CITING = frozenset("art artikel article section abs satz nr l ja nein yes no oui non mit ausnahme von except for under with the exception of sauf dans le cas de prévu par".split())
_SPLIT = re.compile(r"(?<=[.!?…])(?<!\b[Aa]bs\.)(?<!\b[Nn]r\.)(?<!\b[Aa]rt\.)(?<!\b\d\.)(?<!\b\d\d\.)(?<!\b\d\d\d\.)[\"'”“»]*\s+|\n+")
_WORD = re.compile(r"[^\W_]+")
_ITEM = re.compile(r"^\s*(?:[-*•·–]|\d+[.)]|[a-z]\))(?:\s+|$)|^\s*\|")
_NOTHING = re.compile(r"^(?:null|none|nan|n/?a|undefined)$", re.I)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def language(tokens: list[str]) -> str | None:
    """The language with most frequent words among the tokens; None if they say nothing or the first three tie."""
    count = [0] * len(_NAMES)
    for listed in map(_OF_WORD.get, tokens):
        if listed:
            for i in listed:
                count[i] += 1
    most = max(count)
    if not most:
        return None
    first = [i for i, n in enumerate(count[: len(_FIRST)]) if n == most]
    if first:
        return _NAMES[first[0]] if len(first) == 1 else None
    return _NAMES[count.index(most)]


_FIGURE = re.compile(r"[\d§]")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]{3}")


@lru_cache(maxsize=4096)
def _script_of(letter: str) -> str:
    return unicodedata.name(letter, "?").split(" ")[0].split("-")[0]


def script(text: str) -> str | None:
    """LATIN for a text that begins with some Latin word, else the script of its first letter; None without letters."""
    if _LATIN.search(text[:40]):
        return "LATIN"
    found = next((c for c in text if c.isalpha()), None)
    return _script_of(found) if found else None


def unwrap(response: str) -> tuple[str, bool]:
    """The answer inside its wrapping, and whether the wrapping is broken off."""
    text, broken = response.strip().lstrip("﻿​").strip(), False
    if text.startswith("```"):
        body = re.sub(r"^```[\w-]*[ \t]*\n?", "", text)
        broken = not body.rstrip().endswith("```")
        text = body.rstrip().removesuffix("```").strip()
    if text[:1] in ("{", "[") and not re.match(r"\[\d+\]", text):
        try:
            found = json.loads(text)
            parts: list[str] = []

            def walk(x: object) -> None:
                if isinstance(x, str):
                    parts.append(x)
                elif isinstance(x, dict):
                    for k, v in x.items():
                        if str(k).lower() not in ("refs", "references", "sources"):
                            walk(v)
                elif isinstance(x, list):
                    for v in x:
                        walk(v)
                elif x is not None:
                    parts.append(str(x))

            walk(found)
            text = "\n".join(parts)
        except ValueError:
            if text[0] == "{":
                broken = True
                m = re.search(r':\s*"((?:[^"\\]|\\.)*)', text)
                text = m.group(1).replace("\\n", "\n").replace('\\"', '"') if m else text
    elif text[:1] == text[-1:] == '"' and len(text) > 1:
        text = text[1:-1]
    if "<" in text:
        text = re.sub(r"<[^<>]{1,40}>", " ", text)
    # Of what is printable only the plain space is to be joined.
    if "  " in text or not text.replace("\n", "").isprintable():
        text = re.sub(r"[ \t\xa0​﻿]+", " ", text)
    return text.strip(), broken


def _citation(text: str) -> bool:
    """Whether a text is a citation and nothing else: numbers, words of CITING, acts in capitals."""
    return all(w[0].isdigit() or w.lower() in CITING or (3 <= len(w) <= 5 and w.isupper()) for w in _WORD.findall(text))


def _unclosed(bare: str) -> bool:
    """Whether a bracket or quotation mark is left open."""
    for a, b in ("()", "[]", "„“", "«»"):
        if a in bare and bare.count(a) > bare.count(b) + (bare.count("”") + bare.count('"') if a == "„" else 0):
            return True
    return False


FEATURES = (
    "bias", "declines", "polite", "overlap", "half overlap", "covers", "overlap covers", "own language", "other language", "no language", "other script",
    "first", "last", "last broken", "last unmarked", "last unmarked citation", "last unmarked long", "last unmarked after text", "last open mark", "last unclosed",
    "last goes on", "last bare item", "last item", "last item small end", "last row open", "item", "number", "short", "long", "last of repeated", "only",
)


def describe(prompt: str, response: str, error: str | None) -> tuple[list[str], list[tuple]]:
    """The clauses of a response and their forms (FEATURES from the fourth on), empty if nothing is said."""
    text, broken = unwrap(response)
    question = prompt.strip().split("\n")[-1]
    asked, whole = words(question), words(prompt)
    own = language(asked) or language(whole)
    wanted = {own, *(ASKED[m.lower()] for m in _ASKED.findall(prompt))}
    pairs = set(zip(whole, whole[1:], strict=False))
    bare = HEADING.sub("", text)
    parts, tokens, bodies = [], [], []
    for c in map(str.strip, _SPLIT.split(bare)):
        w, item = words(c), _ITEM.match(c)
        if w or item:
            parts.append(c)
            tokens.append(w)
            bodies.append(c[item.end() :].strip() if item and c[0] != "|" else c)
    if _NOTHING.match(bare.strip("\"'. ")) or not any(w and (b is c or words(b)) for c, w, b in zip(parts, tokens, bodies, strict=True)):
        return [], []
    letters = script(prompt)
    cut = broken or bool(error and CUT_OFF.search(error))
    rows = []
    n = len(parts)
    for i, c in enumerate(parts):
        w, last, item = tokens[i], i == n - 1, bodies[i] is not c or c[0] == "|"
        lang, shown = language(w), script(c)
        overlap = len([1 for p in zip(w, w[1:], strict=False) if p in pairs]) / (len(w) - 1) if len(w) > 1 else 0.0
        high, covers = overlap >= 0.8, len(w) >= 0.6 * len(asked)
        other = lang is not None and own is not None and lang not in wanted
        form = [overlap if high else 0.0, 0.4 <= overlap < 0.8, covers, high and covers, lang is not None and not other, other, lang is None]
        form += [shown is not None and letters is not None and shown != letters and lang is None, i == 0, last]
        end = [0] * 12
        if last:
            row = c.startswith("|")
            body = bodies[i]
            inner = words(body) if body is not c else w
            unmarked = not _ENDS.search(c)
            after = i > 0 and bodies[i - 1] is parts[i - 1] and parts[i - 1][0] != "|"
            final = inner[-1] if inner else ""
            plain = unmarked and not row and not high
            end = [
                cut, plain and not item, plain and not item and _citation(c), plain and not item and len(inner) > 5 and not _citation(c), plain and not item and after and not _citation(c),
                not row and not high and (c[-1:] in ",;:-–(„«[/&" or bool(_ABBREVIATED.search(c))), not row and not high and _unclosed(c),
                plain and final in GOES_ON, item and not inner, plain and item, plain and item and lang == "de" and len(inner) > 1 and body.split()[-1][:1].islower(), row and not c.endswith("|"),
            ]
        rows.append((*form, *end, item, _FIGURE.search(c) is not None, len(w) <= 2, len(w) > 12, last and n > 1 and c == parts[i - 1], n == 1))
    return parts, rows


def _hashed(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter sequences of lengths four and five, of words and of word pairs with a gap of up to one, and the text of each."""
    plain = [" " + " ".join(words(t)) + " " for t in texts]
    c = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(p) for p in plain])
    owner = np.repeat(np.arange(len(texts)), sizes)
    found, of = [], []
    h = np.zeros(len(c), dtype=np.uint32)
    for k in range(5):
        n = len(c) - k
        if n <= 0:
            break
        h = (h[:n] * np.uint32(16777619)) ^ (c[k:] * np.uint32(2654435761) + np.uint32(k))
        if k >= 3:
            same = owner[:n] == owner[k:]
            found.append(_bucket(h[same]))
            of.append(owner[:n][same])
    # Words: the sum of their letters' hashes from gap to gap.
    if len(c):
        gap = c == 32
        place = np.cumsum(gap)
        mixed = c * np.uint32(2246822519)
        mixed ^= mixed >> np.uint32(13)
        inside = np.arange(len(c)) - np.maximum.accumulate(np.where(gap, np.arange(len(c)), 0))
        total = np.bincount(place[~gap], (mixed * (np.uint32(2) * inside.astype(np.uint32) + np.uint32(1)))[~gap].astype(np.float64), minlength=int(place[-1]) + 1)
        seen = np.bincount(place[~gap], minlength=int(place[-1]) + 1) > 0
        word = (total[seen].astype(np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        at = np.zeros(int(place[-1]) + 1, dtype=np.int64)
        at[place[~gap]] = owner[~gap]
        at = at[seen]
        found.append(_bucket(word ^ np.uint32(0x9E3779B9)))
        of.append(at)
        for gap_ in (1, 2):
            same = at[:-gap_] == at[gap_:]
            found.append(_bucket((word[:-gap_] * np.uint32(31) ^ word[gap_:] * np.uint32(2654435761))[same]))
            of.append(at[:-gap_][same])
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(found), np.concatenate(of)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(2246822519)
    return ((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int64)


class ClauseKinds:
    """What clauses do, from their letters: a softmax over hashed sequences."""

    def __init__(self) -> None:
        self.weights = np.zeros((BUCKETS, len(KINDS)), dtype=np.float32)

    def fit(self, texts: Sequence[str], kinds: np.ndarray, rounds: int = 60, rate: float = 0.5, l2: float = 1e-4) -> ClauseKinds:
        bucket, owner = _hashed(texts)
        n = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        used, bucket = np.unique(bucket, return_inverse=True)
        w = np.zeros((len(used), len(KINDS)))
        squares = np.full_like(w, 1e-6)
        size = 1 / np.sqrt(n)
        goal = np.eye(len(KINDS))[kinds]
        for _ in range(rounds):
            score = np.stack([np.bincount(owner, w[bucket, k], len(texts)) for k in range(len(KINDS))], 1) * size[:, None]
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            off = (goal - p) * size[:, None]
            g = np.stack([np.bincount(bucket, off[owner, k], len(used)) for k in range(len(KINDS))], 1) - l2 * len(texts) * w
            squares += g**2
            w += rate * g / np.sqrt(squares) * 0.2
        self.weights[used] = w
        return self

    def scores(self, texts: Sequence[str]) -> np.ndarray:
        """(n x 2): how much more the letters speak for declining, and for being polite, than for stating; bounded."""
        if not len(texts):
            return np.zeros((0, 2))
        bucket, owner = _hashed(texts)
        n = np.sqrt(np.maximum(np.bincount(owner, minlength=len(texts)), 1))
        s = np.stack([np.bincount(owner, self.weights[bucket, k], len(texts)) / n for k in range(len(KINDS))], 1)
        return np.clip(s[:, 1:] - s[:, :1], -4, 4)


def labelled_clauses() -> tuple[list[str], np.ndarray]:
    """All clauses of the sample with their kinds, in order."""
    texts = [(t, k) for by in CLAUSES.values() for k, kind in enumerate(KINDS) for t in by[kind]]
    return [t for t, _ in texts], np.array([k for _, k in texts])


def composed(seed: int, count: int, usable: set[str]) -> list[tuple[str, str, str | None, str]]:
    """Responses put together from labelled clauses, with one letter a clause, in the form of RESPONSES."""
    rng = np.random.default_rng(seed)
    pools = {(l, k): [c for c in CLAUSES[l][k] if c in usable] for l in CLAUSES for k in KINDS}
    pick = lambda lang, kind: pools[lang, kind][int(rng.integers(len(pools[lang, kind])))]
    ended = lambda lang: next(c for c in iter(lambda: pick(lang, "statement"), None) if c.endswith("."))
    out = []
    for _ in range(count):
        lang = ("de", "en", "fr")[int(rng.choice(3, p=[0.45, 0.4, 0.15]))]
        prompt = PROMPTS[lang][int(rng.integers(len(PROMPTS[lang])))]
        question = prompt.split("\n")[-1]
        case = rng.random()
        parts: list[tuple[str, str]] = []
        error = None
        if case < 0.12:
            # A list, whole or broken off.
            intro = ended(lang)[:-1] + ":"
            mark = (lambda i: "- ") if rng.random() < 0.6 else (lambda i: f"{i + 1}. ")
            items = [mark(i) + ITEMS[lang][int(rng.integers(len(ITEMS[lang])))] for i in range(int(rng.integers(2, 5)))]
            listed = [(intro, "a"), *((x, "a") for x in items)]
            end = rng.random()
            if end < 0.15:
                listed.append((mark(len(items)).strip(), "u"))
            elif end < 0.4:
                listed.append((mark(len(items)) + LOOSE_ENDS[lang][int(rng.integers(len(LOOSE_ENDS[lang])))], "u"))
            elif end < 0.5:
                whole = items[-1] + " " + LOOSE_ENDS[lang][int(rng.integers(len(LOOSE_ENDS[lang])))]
                listed[-1] = (whole, "u")
            out.append((prompt, "\n".join(c for c, _ in listed), None, "".join(l for _, l in listed)))
            continue
        if case < 0.17:
            parts = [(question, "e")] * (rng.random() < 0.2) + [(SHORT[lang][int(rng.integers(len(SHORT[lang])))], "a")]
        elif case < 0.4:
            before = [(pick(lang, "courtesy"), "a")] if rng.random() < 0.2 else []
            parts = before + [(ended(lang), "a") for _ in range(int(rng.integers(1, 4)))] + ([(pick(lang, "courtesy"), "a")] if rng.random() < 0.15 else [])
            if rng.random() < 0.1:
                parts = [(pick(lang, "statement"), "a")]
        elif case < 0.62:
            spoken = lang if rng.random() < 0.85 else ("de", "en", "fr")[int(rng.integers(3))]
            parts = [(pick(spoken, "courtesy"), "r")] if rng.random() < 0.5 else []
            declined = pick(spoken, "refusal")
            if rng.random() < 0.2:
                declined = declined.rstrip(".") + "!"
            if parts and parts[-1][0].endswith((",", ":", "Leider")):
                # The opening and the refusal are one clause.
                declined, parts = f"{parts[-1][0]} {declined[:1].lower() + declined[1:]}", []
            parts += [(declined, "r")] + ([(pick(spoken, "courtesy"), "r")] if rng.random() < 0.5 else [])
        elif case < 0.72:
            said = question if rng.random() < 0.6 else question.upper() if rng.random() < 0.5 else "„" + question + "“"
            parts = [(said, "e")] * (2 if rng.random() < 0.15 else 1) + ([(ended(lang), "a")] if rng.random() < 0.4 else [])
        elif case < 0.84:
            other = [x for x in CLAUSES if x != lang]
            spoken = other[int(rng.integers(len(other)))]
            strange = rng.random() < 0.25
            foreign = lambda: OTHERS[int(rng.integers(len(OTHERS)))] if strange else ended(spoken)  # noqa: B023, E731
            parts = ([(ended(lang), "a")] if rng.random() < 0.3 else []) + [(foreign(), "f") for _ in range(int(rng.integers(1, 4)))]
        else:
            parts = [(ended(lang), "a") for _ in range(int(rng.integers(0, 3)))]
            whole = ended(lang)
            if rng.random() < 0.15:
                # A remark in brackets that is never closed.
                whole = whole[:-1] + " (" + ITEMS[lang][int(rng.integers(len(ITEMS[lang])))] + ")."
            at = int(rng.integers(len(whole) // 3 + 1, max(len(whole) // 3 + 2, len(whole) - 4)))
            if rng.random() < 0.8:
                piece = whole[:at].rstrip() if rng.random() < 0.6 else whole[: whole.rfind(" ", 0, at)]
                if rng.random() < 0.2:
                    piece = piece.rstrip(",") + ",:–("[int(rng.integers(4))]
                if parts or len(words(piece)) > 5 or piece[-1] in ",:–(":
                    parts.append((piece, "u"))
                else:
                    parts.append((whole, "a"))
            else:
                error = "max_tokens reached"
                parts.append((whole, "u"))
        text = ("\n" if rng.random() < 0.15 else " ").join(c for c, _ in parts)
        out.append((prompt, text, error, "".join(l for _, l in parts)))
    return out


@dataclass
class Tagger:
    """The clause kinds and the field over them."""

    kinds: ClauseKinds
    field: LinearChainCRF

    @classmethod
    def fit(cls, usable: set[str] | None = None, seed: int = 4) -> Tagger:
        """From the labelled clauses (those in `usable`) and the responses made of them.

        The field sees each clause with the score of a model that was fitted
        without it, as it will see clauses it does not know.
        """
        texts, kinds = labelled_clauses()
        if usable is not None:
            kept = [i for i, t in enumerate(texts) if t in usable]
            texts, kinds = [texts[i] for i in kept], kinds[kept]
        scored: dict[str, np.ndarray] = {}
        for fold in range(4):
            out = np.arange(len(texts)) % 4 == fold
            part = ClauseKinds().fit([t for t, o in zip(texts, out, strict=True) if not o], kinds[~out])
            held = [t for t, o in zip(texts, out, strict=True) if o]
            scored |= dict(zip(held, part.scores(held), strict=True))
        whole = ClauseKinds().fit(texts, kinds)
        rows, tags = [], []
        for prompt, response, error, letters in (*RESPONSES, *composed(seed, COMPOSED, set(texts))):
            parts, form = describe(prompt, response, error)
            if len(parts) == len(letters):
                known = [scored[c] if c in scored else whole.scores([c])[0] for c in parts]
                known = [np.zeros(2) if f[FEATURES.index("other script") - 3] else k for k, f in zip(known, form, strict=True)]
                rows.append(np.array([(1, *k, *f) for k, f in zip(known, form, strict=True)], dtype=float))
                tags.append(["arefu".index(t) for t in letters])
        most = max(map(len, rows))
        x, y = np.zeros((len(rows), most, len(FEATURES))), np.zeros((len(rows), most), dtype=int)
        for i, (r, t) in enumerate(zip(rows, tags, strict=True)):
            x[i, : len(r)], y[i, : len(t)] = r, t
        return cls(whole, LinearChainCRF(len(LABELS), len(FEATURES)).fit(x, y, np.array(list(map(len, rows)))))

    def defects(self, rows: Sequence[tuple[str | None, str | None, str | None, str | None]]) -> list[str | None]:
        """The defect of each (prompt, response, status, error), or None. See find_broken_pairs."""
        out: list[str | None] = [None] * len(rows)
        clauses: list[str] = []
        forms: list[tuple] = []
        of, sizes = [], []
        for i, (prompt, response, status, error) in enumerate(rows):
            if status not in FINISHED:
                continue
            parts, form = describe(prompt or "", response or "", error)
            if not parts:
                out[i] = "empty"
                continue
            clauses += parts
            forms += form
            of.append(i)
            sizes.append(len(parts))
        if not of:
            return out
        x = np.empty((len(clauses), len(FEATURES)))
        x[:, 0] = 1
        x[:, 3:] = np.array(forms, dtype=float)
        # In another script the letters say nothing.
        x[:, 1:3] = self.kinds.scores(clauses) * (1 - x[:, FEATURES.index("other script"), None])
        count = np.array(sizes)
        tags = self.field.tag(x, count)
        weight = np.array(list(map(len, clauses)), dtype=float)
        owner = np.repeat(np.arange(len(of)), count)
        share = np.bincount(owner * len(LABELS) + tags, weight, len(of) * len(LABELS)).reshape(-1, len(LABELS))
        share /= share.sum(1, keepdims=True)
        final = tags[np.cumsum(count) - 1]
        for k, i in enumerate(of):
            a, refused, repeated, foreign, _ = share[k]
            out[i] = "truncated" if final[k] == 4 else "refusal" if refused > REFUSED else "copy" if repeated >= REPEATED else "other_language" if foreign > FOREIGN else None
        return out


@lru_cache(maxsize=1)
def tagger() -> Tagger:
    """The tagger fitted to the whole sample, whatever the data."""
    return Tagger.fit()


def defect(prompt: str | None, response: str | None, status: str | None, error: str | None) -> str | None:
    """The defect of one pair, or None."""
    return tagger().defects([(prompt, response, status, error)])[0]


def find_broken_pairs(rows: DataFrame) -> DataFrame:
    """(id, defect) of the defective rows among finished ones, each id once.

    Rows with another status, or none, are no cases. A null, empty or blank
    response, or one of wrapping alone, is `empty`; a null prompt is an empty
    one. Repeated rows come out once; of rows with one id and different contents
    the alphabetically first defect. Texts are read whole; other columns are ignored.
    """
    shared = rows.sparkSession.sparkContext.broadcast(tagger())

    @F.pandas_udf("string")
    def judge(it: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fitted = shared.value
        for columns in it:
            yield pd.Series(fitted.defects(list(zip(*[c.where(c.notna(), None) for c in columns], strict=True))), dtype=object)

    cases = rows.where(F.col("status").isin(*FINISHED))
    found = cases.select("id", judge("prompt", "response", "status", "error").alias("defect")).where("defect is not null")
    return found.groupBy("id").agg(F.min("defect").alias("defect"))
