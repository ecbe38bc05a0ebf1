"""Keyword-stuffed and link-list pages.

A text is cut into windows: sentences, runs of short lines, and slices of long
unpunctuated lines. One pass measures each window: missing function words,
density of the page's leading words and repeated word pairs, share of link text,
separators, repeated lines. The thresholds are calibrated per language from
quantiles over all documents, and a page is found if the windows beyond them
hold more than half of its characters.

A page's language is told by its function words, by the name it carries, or by
its letter triples, and where it carries no such name the letters must bear it out. Three languages have a list of function words; those of any
other named language, or of a script that has pages without a name, are the most
widespread words of its pages. Where none of this tells the language, nothing is
concluded from missing function words.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from normlake.plans.runtime import stored

#: Share of the characters in spam windows from which a page is found.
SHARE = 0.5
#: Characters in spam windows that a page has at least; less is a short fragment.
LEAST_CHARS = 200
#: Function-word share of a spam window, as a part of the language's median share.
FUNCTION_PART = 0.3
#: A page is stuffed from this many times its language's median share of the most frequent word.
TOP_TIMES = 3.2
#: Density of the page's leading words in a stuffed window, and share of repeated word pairs in a repeated one.
DENSITY, PAIRED = 0.12, 0.5
#: Share of a page's lines that say again what another line of it says, from which its repeated windows count.
DUPLICATED = 0.6
#: Share of link text in a window of links.
LINK_SHARE = 0.4
#: Share of separators in a window that is a run of words in any language; prose has a fifth of it.
SEPARATED = 0.08
#: Words of a slice of a long line, and characters where words are not set apart.
SLICE, SLICE_CHARS = 25, 150
#: Words of a page from which it counts for the medians.
LEAST_WORDS = 40
#: Pages that a language has at least to get function words of its own, and what part of the widest word's
#: share of pages its function words have.
LEAST_PAGES, WIDESPREAD = 20, 0.5
#: Languages whose letter triples a worker holds, or measures a page against, at once; bears on memory only.
LANGUAGE_BLOCK = 64
#: Buckets of letter triples. A page without a name is of no language if it fits the best one worse than the median
#: page by MISFIT times what separates the median from the worst twentieth.
TRIPLE_BITS, MISFIT = 15, 4
#: Words a worker remembers; bears on speed only.
MAX_REMEMBERED = 300_000

#: Function words that tell sentences from lists.
FUNCTION_WORDS = {
    "de": "der die das den dem des ein eine einen einem einer eines und oder ist sind war wird werden wurde hat haben nicht von vom zu zum zur mit nach für auf im in am an bei als auch aus bis so soweit wenn dass sie es wer wie muss kann darf dürfen über unter durch sowie keine kein gilt erst sein beim um ob vor".split(),
    "en": "the a an of and or is are was were be been has have had not by to with for from in on at as that which who this these if it its shall must may can under within between where when no such after does about than any all each".split(),
    "fr": "le la les l un une des du de d et ou est sont était être a ont pas par pour avec dans sur au aux ce cette ces il elle ne que qui se son sa ses doit selon lorsque sans ainsi entre après si sauf moins tous faut".split(),
}
#: How a page says that it names no language.
UNNAMED = ("", "un", "mu", "zx")
#: Letters of scripts that set no space between words; each counts as a word.
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿"
_WORD = re.compile(rf"[{_UNSPACED}]|[^\W\d_{_UNSPACED}]+")
_LINK = re.compile(
    r"<a\b[^>]*>.*?</a>|<[^<>]{0,300}>|\[[^\]\n]{0,200}\]\([^)\n]{0,300}\)|(?:https?://|ftp://|www\.)\S+|\(?\b[\w-]+(?:\.[\w-]+)*\.(?:[a-z]{2,}\b)(?:/[\w\-./%#?=&]*)?\)?",
    re.I | re.S,
)
_DOTTED = re.compile(r"\.[A-Za-z]{2}")
_SEPARATOR = re.compile(r"[|»«›‹>·•+#,;/=*~–—]")
_LEADER = re.compile(r"\.{4,}|(?:\. ){4,}|…{2,}|_{4,}")
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[^\W\d_])|(?<=[。！？])")
_INVISIBLE = re.compile("[­​‌‍⁠﻿]")
_SPACE = re.compile(r"[^\S\n]+")
#: What _ENDS can end with: a cheap test before it.
_LAST = frozenset(".!?;。！？\"'”“»«)]」")
_ENDS = re.compile(r"[.!?;。！？][\"'”“»«)\]」]*$")


def _may_link(text: str) -> bool:
    """A cheap test that spares most windows the pattern of links: what any link holds."""
    return "<" in text or "[" in text or "://" in text or "ww." in text or "WW." in text or "wW." in text or "Ww." in text or _DOTTED.search(text) is not None


def normalise(text: str) -> str:
    """Composed characters, no invisible ones, single spaces; lines stay."""
    plain = text if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    if "\r" in plain or "\f" in plain:
        plain = plain.replace("\r\n", "\n").replace("\r", "\n").replace("\f", "\n")
    # Of what is printable only the plain space is white.
    return plain if "  " not in plain and plain.replace("\n", "").isprintable() else _SPACE.sub(" ", plain)


def windows(text: str) -> list[str]:
    """Sentences, runs of short unpunctuated lines, and slices of long lines; together the whole text."""
    out: list[str] = []
    run: list[str] = []

    def close() -> None:
        if run:
            step = 12
            out.extend("\n".join(run[i : i + step]) for i in range(0, len(run), step))
            run.clear()

    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        n = line.count(" ") + 1
        if n <= 14 and len(line) <= SLICE_CHARS and not (line[-1] in _LAST and _ENDS.search(line)):
            run.append(line)
            continue
        close()
        for sentence in _SENTENCE.split(line):
            parts = sentence.split(" ")
            if len(sentence) > 2 * SLICE_CHARS and len(parts) <= len(sentence) // 30:
                out.extend(sentence[i : i + SLICE_CHARS] for i in range(0, len(sentence), SLICE_CHARS))
            elif len(parts) <= 2 * SLICE:
                out.append(sentence)
            else:
                out.extend(" ".join(parts[i : i + SLICE]) for i in range(0, len(parts), SLICE))
    close()
    return [w for w in out if w]


def script(text: str) -> str:
    """The script of the first letters, by the first word of their Unicode names."""
    letters = [c for c in text[:400] if c.isalpha()]
    names = Counter(unicodedata.name(c, "?").split(" ")[0].split("-")[0] for c in letters)
    return names.most_common(1)[0][0].lower() if names else ""


def named_language(name: str | None) -> str | None:
    """Two letters of the name a page carries, or None."""
    short = (name or "").strip().lower()[:2]
    return None if short in UNNAMED else short


def _triples(text: str) -> np.ndarray:
    """Buckets of the letter triples of a text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(c) < 3:
        return np.zeros(0, dtype=np.int64)
    h = c[:-2] * np.uint32(2654435761) ^ c[1:-1] * np.uint32(2246822519) ^ c[2:] * np.uint32(3266489917)
    h = (h ^ (h >> np.uint32(15))) * np.uint32(2654435769)
    return (h >> np.uint32(32 - TRIPLE_BITS)).astype(np.int64)


@dataclass
class Languages:
    """Names, function words and letter-triple profiles (log shares, one row a language) of the languages of a corpus, of any number."""

    names: list[str]
    function: list[frozenset[str]]
    profiles: np.ndarray

    def __post_init__(self) -> None:
        self.place = {n: i for i, n in enumerate(self.names)}
        self.listed: dict[str, list[int]] = {}
        for i, words in enumerate(self.function):
            for w in words:
                self.listed.setdefault(w, []).append(i)

    def nearest(self, triples: np.ndarray) -> int:
        """The language that letter triples fit best, or -1 without any."""
        if not len(triples):
            return -1
        return int(np.concatenate([self.profiles[i : i + LANGUAGE_BLOCK, triples].mean(1) for i in range(0, len(self.names), LANGUAGE_BLOCK)]).argmax())


def corpus_languages(documents: DataFrame) -> Languages:
    """The languages of documents(text, lang).

    Counted are, by named language or else by script, pages, letter triples, and
    for groups without a list the pages of each word. Every group of LEAST_PAGES
    pages is a language, however many there are; names have two letters. To the driver
    come at most 2 ** TRIPLE_BITS rows a language and the widespread words of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pages: Counter[str] = Counter()
        triples: dict[str, np.ndarray] = {}
        words: Counter[tuple[str, str]] = Counter()
        schema = ["language", "word", "n"]

        def listed() -> pa.RecordBatch:
            rows = [(g, w, n) for (g, w), n in words.items()]
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([], [], []), (pa.string(), pa.string(), pa.int64()), strict=True)], names=schema)

        def spread() -> Iterator[pa.RecordBatch]:
            for group, found in triples.items():
                at = np.nonzero(found)[0]
                yield pa.RecordBatch.from_arrays([pa.array([group] * len(at), pa.string()), pa.array([f"\0{i}" for i in at], pa.string()), pa.array(found[at])], names=schema)
            triples.clear()

        for batch in batches:
            own: dict[str, list[np.ndarray]] = {}
            for text, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                plain = normalise(text)
                group = named_language(name) or ":" + script(plain)
                pages[group] += 1
                if group[0] != ":":
                    own.setdefault(group, []).append(_triples(plain))
                if group not in FUNCTION_WORDS and group != ":latin":
                    words.update((group, w) for w in set(_WORD.findall(plain.lower())))
            for group, parts in own.items():
                found = np.bincount(np.concatenate(parts), minlength=1 << TRIPLE_BITS)
                triples[group] = triples[group] + found if group in triples else found
                if len(triples) >= LANGUAGE_BLOCK:
                    yield from spread()
            if len(words) > MAX_REMEMBERED:
                yield listed()
        yield from spread()
        words.update({(g, "\0"): n for g, n in pages.items()})
        yield listed()

    counts = stored(documents.where(F.length(F.trim("text")) > 0).select("text", F.col("lang").cast("string")).mapInArrow(run, "language string, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n")))
    # Two-letter names and scripts, each of LEAST_PAGES pages or with a list.
    sizes = {r["language"]: r["n"] for r in counts.where("word = '\0'").where((F.col("n") >= LEAST_PAGES) | F.col("language").isin(list(FUNCTION_WORDS))).collect()}
    names = sorted({*FUNCTION_WORDS, *(g for g, n in sizes.items() if n >= LEAST_PAGES and g != ":latin")})
    kept = counts.where(F.col("language").isin(names))
    widest = kept.where(F.substring("word", 1, 1) != "\0").groupBy("language").agg(F.max("n").alias("most"))
    wide = kept.join(F.broadcast(widest), "language").where((F.substring("word", 1, 1) != "\0") & (F.col("n") >= WIDESPREAD * F.col("most")))
    own: dict[str, set[str]] = {}
    # Few words are on half as many pages as the widest one.
    for r in wide.select("language", "word").collect():
        own.setdefault(r["language"], set()).add(r["word"])
    place = {n: i for i, n in enumerate(names)}
    profiles = np.ones((len(names), 1 << TRIPLE_BITS))
    for r in kept.where("word like '\0_%'").groupBy("word").agg(F.collect_list(F.struct("language", "n")).alias("by")).toLocalIterator():
        for x in r["by"]:
            profiles[place[x["language"]], int(r["word"][1:])] += x["n"]
    profiles /= profiles.sum(1, keepdims=True)
    profiles = np.log(profiles, out=profiles).astype(np.float32)
    # A language without named pages is never told by its letters.
    profiles[[i for i, n in enumerate(names) if n not in sizes or n[0] == ":"]] = -99
    return Languages(names, [frozenset(FUNCTION_WORDS.get(n, ())) or frozenset(own.get(n, ())) for n in names], profiles)


class _Words(dict):
    """Numbers of words, and of each word its length and the languages whose function word it is: where they start in a list, and how many they are."""

    def __init__(self, listed: dict[str, list[int]]) -> None:
        super().__init__()
        self.listed, self.starts, self.counts, self.languages, self.lengths = listed, [], [], [], []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        own = self.listed.get(word, ())
        self.starts.append(len(self.languages))
        self.counts.append(len(own))
        self.languages.extend(own)
        self.lengths.append(len(word))
        return n


_WINDOW = "struct<chars int, n int, function double, leading double, paired double, link double, separators double, letters double, leader boolean, repeated boolean>"
_MEASURES = f"doc_id long, language string, told boolean, fit double, n_words int, function_share double, top_share double, duplicated double, windows array<{_WINDOW}>"


def _sums(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of values by run; 0 for empty runs."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[starts + sizes] - total[starts]


def measure_pages(texts: list[str], names: list[str | None], known: Languages, vocabulary: _Words) -> dict[str, np.ndarray | list]:
    """Measures of pages and of their windows, flat, with the number of windows of each page."""
    flat: list[int] = []
    n_words, n_windows, chars, link, separators, leader, repeated, duplicated, plains = [], [], [], [], [], [], [], [], []
    number = vocabulary.__getitem__
    for text in texts:
        plain = normalise(text)
        plains.append(plain)
        parts = windows(plain)
        n_windows.append(len(parts))
        keys = []
        linked = _may_link(plain)
        for p in parts:
            held = 0
            bare = p
            if linked and _may_link(p):
                held = sum(m.end() - m.start() for m in _LINK.finditer(p))
                if held:
                    bare = _LINK.sub(" ", p)
            ids = list(map(number, _WORD.findall(bare.lower())))
            flat += ids
            n_words.append(len(ids))
            chars.append(len(p))
            link.append(held)
            separators.append(len(_SEPARATOR.findall(p)))
            leader.append(("..." in p or ". ." in p or "…" in p or "___" in p) and bool(_LEADER.search(p)))
            keys.append(tuple(ids) if ids else len(keys))
        seen = Counter(keys)
        repeated += [seen[k] > 1 for k in keys]
        lines = [x for x in map(str.strip, plain.split("\n")) if x]
        once = set(lines)
        whole = sum(map(len, lines))
        duplicated.append((whole - sum(map(len, once))) / whole if len(once) < len(lines) else 0.0)
    ids = np.array(flat, dtype=np.int64)
    # How many languages have each word, and for each word and language one entry.
    counts = np.array(vocabulary.counts, dtype=np.int64)[ids] if len(ids) else np.zeros(0, dtype=np.int64)
    at = np.repeat(np.arange(len(ids)), counts)
    entry = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
    of = np.array(vocabulary.languages, dtype=np.int64)[np.array(vocabulary.starts, dtype=np.int64)[ids[at]] + entry] if len(at) else np.zeros(0, dtype=np.int64)
    lengths = np.array(vocabulary.lengths, dtype=np.int64)[ids] if len(ids) else np.zeros(0, dtype=np.int64)
    w_size, p_windows = np.array(n_words, dtype=np.int64), np.array(n_windows, dtype=np.int64)
    w_start = np.cumsum(w_size) - w_size
    w_page = np.repeat(np.arange(len(texts)), p_windows)
    p_size = np.bincount(w_page, w_size, len(texts)).astype(np.int64)
    p_start = np.cumsum(p_size) - p_size
    page = np.repeat(np.arange(len(texts)), p_size)
    window = np.repeat(np.arange(len(w_size)), w_size)

    # Languages: most function words, if they are many; the page's own name; the letters.
    share = np.bincount(of * len(texts) + page[at], minlength=len(known.names) * len(texts)).reshape(len(known.names), -1) / np.maximum(p_size, 1)
    best = share.argmax(0)
    language = np.full(len(texts), -1)
    told = np.zeros(len(texts), dtype=bool)
    fit = np.zeros(len(texts))
    for i, plain in enumerate(plains):
        name = named_language(names[i])
        stated = known.place.get(name, -1) if name else known.place.get(":" + script(plain), -1)
        top = best[i]
        second = np.partition(share[:, i], -2)[-2] if len(share) > 1 else 0.0
        if share[top, i] >= 0.2 and share[top, i] > second and (name is None or stated >= 0 or share[top, i] >= 0.3):
            language[i] = top
        elif stated >= 0:
            language[i] = stated
        elif name is None:
            language[i] = known.nearest(_triples(plain))
        if language[i] >= 0:
            t = known.profiles[language[i], _triples(plain)]
            fit[i] = t.mean() if len(t) else -99.0
            told[i] = language[i] == stated
    is_function = np.zeros(len(ids))
    is_function[at[of == language[page[at]]]] = 1

    # The most frequent words of each page that are no function words.
    content = np.nonzero((counts == 0) & (lengths > 2))[0]
    key, count = np.unique(page[content] << 32 | ids[content], return_counts=True)
    key_page = key >> 32
    order = np.lexsort((key, -count, key_page))
    place = np.arange(len(order)) - np.searchsorted(key_page[order], key_page[order])
    leads = np.sort(key[order[(place < 2) & (count[order] >= 4)]])
    most = np.zeros(len(texts))
    first = order[place == 0]
    most[key_page[first]] = count[first]
    is_leading = np.isin(page << 32 | ids, leads)

    # Pairs of words next to each other in a page, five times or more.
    next_ = np.nonzero(page[1:] == page[:-1])[0]
    pair = page[next_] << 52 ^ ids[next_] << 26 ^ ids[next_ + 1]
    _, inverse, times = np.unique(pair, return_inverse=True, return_counts=True)
    paired = np.zeros(len(ids))
    inside = window[next_] == window[next_ + 1]
    paired[next_[inside]] = times[inverse][inside] >= 5

    w_chars = np.array(chars, dtype=np.int64)
    one = np.maximum(w_size, 1)
    return {
        "language": [known.names[i] if i >= 0 else None for i in language],
        "told": told,
        "fit": fit,
        "n_words": p_size,
        "function_share": _sums(is_function, p_start, p_size) / np.maximum(p_size, 1),
        "top_share": most / np.maximum(p_size, 1),
        "duplicated": np.array(duplicated),
        "n_windows": p_windows,
        "chars": w_chars,
        "n": w_size,
        "function": _sums(is_function, w_start, w_size) / one,
        "leading": _sums(is_leading, w_start, w_size) / one,
        "paired": _sums(paired, w_start, w_size) / np.maximum(w_size - 1, 1),
        "link": np.minimum(1.0, np.array(link) / w_chars) if len(link) else np.zeros(0),
        "separators": np.array(separators) / w_chars if len(link) else np.zeros(0),
        "letters": _sums(lengths, w_start, w_size) / w_chars if len(link) else np.zeros(0),
        "leader": np.array(leader, dtype=bool),
        "repeated": np.array(repeated, dtype=bool),
    }


def page_measures(documents: DataFrame, known: Languages) -> DataFrame:
    """(doc_id, language, told, fit, n_words, function_share, top_share, duplicated, windows) of each page with text."""
    shared = documents.sparkSession.sparkContext.broadcast(known)
    names = [f.split()[0] for f in _WINDOW[7:-1].split(", ")]
    kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 6, pa.bool_(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _Words(shared.value.listed)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                if len(vocabulary) > MAX_REMEMBERED:
                    vocabulary = _Words(shared.value.listed)
                m = measure_pages(part.column(1).to_pylist(), part.column(2).to_pylist(), shared.value, vocabulary)
                flat = pa.StructArray.from_arrays([pa.array(m[n], t) for n, t in zip(names, kinds, strict=True)], names)
                offsets = pa.array(np.concatenate([[0], np.cumsum(m["n_windows"])]).astype(np.int32))
                columns = [part.column(0), pa.array(m["language"], pa.string()), pa.array(m["told"]), pa.array(m["fit"]), pa.array(m["n_words"], pa.int32()), *[pa.array(m[x]) for x in ("function_share", "top_share", "duplicated")], pa.ListArray.from_arrays(offsets, flat)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "language", "told", "fit", "n_words", "function_share", "top_share", "duplicated", "windows"])

    texts = documents.where(F.length(F.trim("text")) > 0).select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"))
    return texts.mapInArrow(run, _MEASURES)


def calibrate(measures: DataFrame) -> DataFrame:
    """Thresholds by language, from quantiles over all pages of LEAST_WORDS words or more: one row a language with LEAST_PAGES of them."""
    quantiles = (
        measures.where(F.col("n_words") >= LEAST_WORDS)
        .groupBy("language")
        .agg(
            F.percentile_approx("function_share", 0.5, 10_000).alias("f"),
            F.percentile_approx("top_share", 0.5, 10_000).alias("t"),
            F.percentile_approx(F.when(F.col("told"), F.col("fit")), F.array(F.lit(0.05), F.lit(0.5)), 10_000).alias("fits"),
            F.count(F.lit(1)).alias("pages"),
        )
        .where((F.col("pages") >= LEAST_PAGES) & F.col("language").isNotNull())
    )
    least_fit = F.col("fits")[1] - MISFIT * (F.col("fits")[1] - F.col("fits")[0])
    return quantiles.select("language", (FUNCTION_PART * F.col("f")).alias("least_function"), (TOP_TIMES * F.col("t")).alias("most_top"), least_fit.alias("least_fit"))


def spam_window(w: Column, least_function: Column, stuffed_page: Column, doubled_page: Column) -> Column:
    """Whether a window is a list of links, a run of words without sentence, a stuffed sentence or one said again and again."""
    links = w["link"] >= LINK_SHARE
    # Numbers of a table and dotted leaders of a contents page are no run of words.
    listed = ~w["leader"] & (w["letters"] >= 0.45) & (w["n"] >= 3) & (w["function"] < least_function)
    part_links = (w["link"] >= LINK_SHARE / 2) & (w["function"] < 2 * least_function)
    rows = ~w["leader"] & (w["separators"] >= 0.03) & (w["letters"] >= 0.3) & (w["n"] >= 4) & (w["function"] < least_function)
    # In a language that is not told, a run of words is one that separators set apart.
    rows = rows | ((least_function == 0) & ~w["leader"] & (w["separators"] >= SEPARATED) & (w["letters"] >= 0.45) & (w["n"] >= 4))
    stuffed = stuffed_page & ~w["leader"] & (w["leading"] >= DENSITY)
    again = (stuffed_page & w["repeated"] & (w["paired"] >= PAIRED)) | (doubled_page & ~w["leader"] & (w["n"] >= 3) & (w["paired"] >= PAIRED))
    return links | listed | part_links | rows | stuffed | again


def find_spam_pages(documents: DataFrame) -> DataFrame:
    """(doc_id) of pages of which spam windows hold more than half of the characters.

    Null, empty and blank texts are no case; whole texts are read, of any length.
    The language is told from the text; lang decides only where that says
    little, and may be null. A page whose language is not told, or has too few pages
    to calibrate, is judged without function words and by the medians of all pages. Repeated rows come out once; other columns are ignored. An
    empty table gives no rows.
    """
    known = corpus_languages(documents)
    measures = stored(page_measures(documents, known))
    by_language = calibrate(measures)
    # One row a language, and one of all pages.
    overall = measures.where(F.col("n_words") >= LEAST_WORDS).agg((TOP_TIMES * F.percentile_approx("top_share", 0.5, 10_000)).alias("any_top"))
    fits = F.col("told") | F.coalesce(F.col("fit") >= F.col("least_fit"), F.lit(False))
    # Without a language no share of function words is too small.
    least = F.when(fits, F.coalesce("least_function", F.lit(0.0))).otherwise(0.0)
    stuffed = F.coalesce(F.col("top_share") >= F.coalesce("most_top", "any_top"), F.lit(False))
    judged = measures.join(F.broadcast(by_language), "language", "left").crossJoin(F.broadcast(overall))
    judged = judged.withColumn("bad", F.filter("windows", lambda w: spam_window(w, least, stuffed, F.col("duplicated") >= DUPLICATED)))
    add = lambda ws, field: F.aggregate(ws, F.lit(0), lambda a, w: a + w[field])
    held = add(F.col("bad"), "chars")
    found = judged.where((held >= LEAST_CHARS) & (held > SHARE * add(F.col("windows"), "chars")))
    return found.select("doc_id").distinct()
