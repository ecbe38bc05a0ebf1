"""Norm references in German and EU legal texts.

Places where a citation can begin are found by a short pattern. From there a
reader goes on token by token (signs, numbers, words) and takes what fits: norms
and ranges, sub-parts by a table of their words, then what names the act. Only
what names an act is a reference.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Abbreviations of acts, and their written-out names.
ACTS = "kwg cra crr crd wphg kagb vag zag bsig gwg sag hgb bgb aktg gmbhg stgb ao dsgvo bdsg dora mifid emir".split()
ACT_NAMES = {
    "kwg": "Kreditwesengesetz",
    "vag": "Versicherungsaufsichtsgesetz",
    "zag": "Zahlungsdiensteaufsichtsgesetz",
    "kagb": "Kapitalanlagegesetzbuch",
    "gwg": "Geldwäschegesetz",
    "hgb": "Handelsgesetzbuch",
    "bgb": "Bürgerliches Gesetzbuch",
    "aktg": "Aktiengesetz",
    "sag": "Sanierungs- und Abwicklungsgesetz",
    "wphg": "Wertpapierhandelsgesetz",
}
#: Acts that are one with an EU regulation; they bind article keys only.
ALIASES = {"CRR": "EU:2013/575", "DORA": "EU:2022/2554"}
#: A range of more norms than this gives its two ends only.
LONGEST_RANGE = 30

#: Words of sub-parts, by what they are parts of; a dot may follow, or must where it stands here.
PARTS_OF_PARAGRAPH = frozenset("Abs Absatz Satz Nr Nummer S.".split())
PARTS_OF_ARTICLE = frozenset("Abs Absatz Unterabs Unterabsatz UAbs Satz Halbsatz Nr Nummer Buchstabe Buchst".split())
#: Words and signs of a range, of a list, of a list of sub-parts, and the articles before an act.
RANGE = frozenset(("bis", "-", "–"))
LISTED, LISTED_PARTS = frozenset((",", "und")), frozenset((",", "und", "oder", "bis"))
BEFORE_NAME, BEFORE_REGULATION = frozenset(("der", "des")), frozenset(("der", "des", "die", "den"))
#: How the article is written, and the modules of the supervisory circular.
ARTICLE_WORDS = frozenset("Art Artikel Artikels Artikeln".split())
MODULES = frozenset("AT BTO BTR BT".split())
#: Letters of an act's abbreviation, at most.
LONGEST_ACT, LONGEST_ACT_OF_ARTICLE = 15, 25

_BEGINS = re.compile(r"§+|\bArt(?:ikel[sn]?)?\b|\b(?:AT|BTO|BTR|BT)(?=\s*\d)|(?i:Verordnung)")
_NAME = re.compile(r"\s*([^\W\d_](?:[^\W\d_]|-)*(?:\s+(?:[^\W\d_]|-)+)*)")
_TOKEN = re.compile(r"\s*(?:(\d+)|([^\W\d_]+)|(\S))")


def _plain(name: str) -> str:
    return " ".join(name.split()).lower()


@dataclass(frozen=True)
class Lexicon:
    """Abbreviations of acts (lower case) and written-out names (lower case) with their abbreviation."""

    acts: frozenset[str] = frozenset(ACTS)
    names: dict[str, str] = field(default_factory=lambda: {_plain(n): k.upper() for k, n in ACT_NAMES.items()})

    @classmethod
    def of(cls, rows: Sequence[tuple[str, Sequence[str], bool]]) -> Lexicon:
        """From rows (abbreviation, names, enabled); with none enabled the built-in one."""
        used = [(k.strip(), names) for k, names, enabled in rows if enabled]
        if not used:
            return cls()
        return cls(frozenset(k.lower() for k, _ in used), {_plain(n): k.upper() for k, names in reversed(used) for n in names})

    def named(self, name: str) -> str | None:
        """The act of a written-out name, also in the genitive."""
        plain = _plain(name)
        bare = plain[:-2] if plain.endswith("es") else plain[:-1] if plain.endswith("s") else plain
        return self.names.get(plain) or self.names.get(bare)


def regulation_number(a: str, b: str) -> str:
    """Year first, where one of the two has four digits."""
    return f"{b}/{a}" if len(b) == 4 != len(a) else f"{a}/{b}"


#: A norm is its number and letter: (25, "a").
Norm = tuple[int, str]


def between(first: Norm, last: Norm | None = None) -> list[str]:
    """The norms from one to another: letters where the number is the same, else whole numbers.

    A range that goes back is its first norm. One of more than LONGEST_RANGE
    numbers is its two ends.
    """
    written = ["{}{}".format(*first)]
    if last is None or last[0] < first[0]:
        return written
    (low, letter), (high, end) = first, last
    if low < high:
        numbers = range(low, high + 1)
        return [str(n) for n in (numbers if len(numbers) <= LONGEST_RANGE else (low, high))]
    # 'a' follows no letter.
    before = letter or chr(ord("a") - 1)
    return (written + [f"{low}{chr(c)}" for c in range(ord(before) + 1, ord(end or before) + 1)])[:LONGEST_RANGE]


class _Reader:
    """Takes one token after the other; what does not fit is left where it is."""

    def __init__(self, text: str, at: int) -> None:
        self.text, self.at = text, at

    def next(self) -> tuple[str, int]:
        """The next token and its end; an empty one at the end of the text."""
        m = _TOKEN.match(self.text, self.at)
        return (m[0].lstrip(), m.end()) if m else ("", self.at)

    def take(self, wanted: frozenset[str] | set[str]) -> str | None:
        """The next token, if it is one of these."""
        token, end = self.next()
        if token not in wanted:
            return None
        self.at = end
        return token

    def number(self) -> str | None:
        token, end = self.next()
        if not token.isdecimal():
            return None
        self.at = end
        return token

    def norm(self) -> Norm | None:
        """A number with, at most, one small letter that ends there."""
        digits = self.number()
        if digits is None:
            return None
        letter, after = self.text[self.at : self.at + 1], self.text[self.at + 1 : self.at + 2]
        if "a" <= letter <= "z" and not after.isalnum():
            self.at += 1
            return int(digits), letter
        return int(digits), ""

    def norms(self) -> list[str]:
        """A norm or a range; nothing if there is none."""
        first = self.norm()
        if first is None:
            return []
        back = self.at
        last = self.norm() if self.take(RANGE) else None
        if last is None:
            self.at = back
        return between(first, last)

    def listed_norms(self) -> list[str]:
        """Norms and ranges, joined by LISTED."""
        found = self.norms()
        while found:
            back = self.at
            more = self.norms() if self.take(LISTED) else []
            if not more:
                self.at = back
                break
            found += more
        return found

    def part_value(self) -> bool:
        """The number or letter of a sub-part, perhaps with a bracket."""
        if self.norm() is None:
            token, end = self.next()
            if not (len(token) == 1 and "a" <= token <= "z"):
                return False
            self.at = end
        self.take({")"})
        return True

    def sub_parts(self, words: frozenset[str], several: bool) -> None:
        """All sub-parts that follow, each perhaps after a comma."""
        while True:
            back = self.at
            self.take({","})
            word = self.take(words | {w[:-1] for w in words if w.endswith(".")})
            dotted = self.take({"."}) is not None
            if word is None or not (word in words or dotted) or not self.part_value():
                self.at = back
                return
            while several:
                back = self.at
                if not (self.take(LISTED_PARTS) and self.part_value()):
                    self.at = back
                    break

    def capital(self) -> str | None:
        """The next token, if it is a word that begins with a capital."""
        token, end = self.next()
        if not token[:1].isupper():
            return None
        self.at = end
        return token

    def name(self) -> str | None:
        """A written-out name after its article: all words from a capital on, hyphens included."""
        if not self.take(BEFORE_NAME):
            return None
        m = _NAME.match(self.text, self.at)
        return m[1] if m and m[1][0].isupper() else None

    def regulation(self) -> str | None:
        """The number of 'Verordnung (EU) Nr. 575/2013', after the word itself."""
        if not self.take({"("}) or self.next()[0].upper() != "EU":
            return None
        self.at = self.next()[1]
        if not self.take({")"}):
            return None
        if self.next()[0].lower() == "nr":
            self.at = self.next()[1]
            self.take({"."})
        a = self.number()
        b = self.number() if a and self.take({"/"}) else None
        return regulation_number(a, b) if b and 2 <= len(a) <= 4 and 2 <= len(b) <= 4 else None


def spread(item: str) -> list[str]:
    """The norms of '13', '13a', '13 bis 13c' or '13 bis 15'."""
    return _Reader(item, 0).norms()


def _paragraph(r: _Reader, lexicon: Lexicon) -> list[str]:
    norms = r.listed_norms()
    if not norms:
        return []
    r.sub_parts(PARTS_OF_PARAGRAPH, several=False)
    back = r.at
    word = r.capital()
    if word is None:
        act = lexicon.named(name) if (name := r.name()) else None
    else:
        act = word.upper() if len(word) <= LONGEST_ACT and word.lower() in lexicon.acts else None
    if act is None:
        r.at = back
    return [f"{act}:§{n}" for n in norms] if act else []


def _article(r: _Reader, lexicon: Lexicon) -> list[str]:
    r.take({"."})
    norms = r.norms()
    if not norms:
        return []
    r.sub_parts(PARTS_OF_ARTICLE, several=True)
    word = r.capital()
    act = None
    if word is not None:
        # What a hyphen or a dot makes part of a longer word is no act.
        joined = r.text[r.at : r.at + 1] in ("-", ".") and r.text[r.at + 1 : r.at + 2].isalpha()
        act = word.upper() if not joined and len(word) <= LONGEST_ACT_OF_ARTICLE and word.lower() in lexicon.acts else None
    elif r.take(BEFORE_REGULATION):
        r.take({"Delegierten"})
        number = r.regulation() if r.take({"Verordnung"}) else None
        act = f"EU:{number}" if number else None
    return [f"{act}:Art.{n}" for n in norms] if act else []


def _module(r: _Reader, word: str) -> list[str]:
    places: list[str] = []
    while True:
        back = r.at
        number = r.number() if not places or (r.text[r.at : r.at + 1] == "." and r.text[r.at + 1 : r.at + 2].isdecimal() and r.take({"."})) else None
        if number is None:
            r.at = back
            break
        after = r.text[r.at : r.at + 1]
        if after.isalpha() or after == "_":
            # A letter belongs to the number: what stands before it is the module.
            r.at = back
            break
        places.append(number)
    return [f"MARISK:{word}{'.'.join(places)}"] if places else []


def references(text: str | None, lexicon: Lexicon | None = None) -> list[tuple[str, str, int, int]]:
    """(key, kind, start, end) of each norm named in a text, each key once, in order of appearance."""
    if not text:
        return []
    lexicon = lexicon or Lexicon()
    found: dict[str, tuple[str, int, int]] = {}
    for m in _BEGINS.finditer(text):
        r, word = _Reader(text, m.end()), m[0]
        if word[0] == "§":
            kind, keys = "paragraph", _paragraph(r, lexicon)
        elif word in ARTICLE_WORDS:
            kind, keys = "article", _article(r, lexicon)
        elif word in MODULES:
            kind, keys = "module", _module(r, word)
        else:
            number = r.regulation()
            kind, keys = "regulation", [f"EU:{number}"] if number else []
        for key in keys:
            found.setdefault(key, (kind, m.start(), r.at))
    return [(k, *v) for k, v in found.items()]


def equivalent(key: str) -> list[str]:
    """The key, and for an article of an act that is an EU regulation its other name."""
    act, mark, number = key.partition(":Art.")
    if not mark:
        return [key]
    other = ALIASES.get(act) or {v: k for k, v in ALIASES.items()}.get(act)
    return [key, f"{other}:Art.{number}"] if other else [key]


def extract(chunks: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(chunk_id, context_id, ref_key, kind, start, end) of chunks(id, context_id, text, is_omitted); omitted ones have none.

    A cheap native test keeps texts without any sign of a citation out of Python.
    """
    lexicon = lexicon or Lexicon()

    @F.pandas_udf("array<struct<ref_key string, kind string, start int, end int>>")
    def parse(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in it:
            yield texts.map(lambda t: [dict(zip(("ref_key", "kind", "start", "end"), r, strict=True)) for r in references(t, lexicon)])

    likely = F.col("text").rlike(r"§|Art|(?i:Verordnung)|\b(?:AT|BT|BTO|BTR)\s*\d")
    used = chunks.where(~F.coalesce("is_omitted", F.lit(False)) & likely)
    return used.select(F.col("id").alias("chunk_id"), "context_id", F.explode(parse("text")).alias("r")).select("chunk_id", "context_id", "r.*")


# Resolution of a key to the chunk that defines it.


def article_of_regulation(key: str) -> tuple[str, str] | None:
    """('EU:2013/575', '395') of 'EU:2013/575:Art.395'."""
    m = re.fullmatch(r"(EU:[^:]+):Art\.(.+)", key)
    return (m[1], m[2]) if m else None


def surfaces(key: str) -> list[str]:
    """How the norm of a key is written where it is defined."""
    act, _, norm = key.partition(":")
    if article := article_of_regulation(key):
        return [f"Artikel {article[1]}", f"Art. {article[1]}"]
    if norm.startswith("§"):
        return [f"§ {norm[1:]}", f"§{norm[1:]}"]
    if norm.startswith("Art."):
        return [f"Artikel {norm[4:]}", f"Art. {norm[4:]}"]
    if act == "MARISK" and (m := re.match(r"([A-Z]+)(.*)", norm)):
        return [f"{m[1]} {m[2]}"]
    if act == "EU":
        year, _, number = norm.partition("/")
        return [f"{year}/{number}", f"{number}/{year}"]
    return [norm]


def bounded(surface: str) -> str:
    """Pattern of a surface that does not go on: '§ 25' but not '§ 25a', 'AT 4.3' but not 'AT 4.3.2'."""
    return re.escape(" ".join(surface.lower().split())) + r"(?![0-9a-z])(?![./-][0-9a-z])"


def names_other_act(text: str, surface: str, own: str, lexicon: Lexicon | None = None) -> bool:
    """Whether every place of the surface is followed by another act's abbreviation."""
    lexicon = lexicon or Lexicon()
    plain = " ".join(text.split())
    others = mine = 0
    for m in re.finditer(bounded(surface), plain.lower()):
        word = re.match(r"\W*(?:(?:Abs|Satz|Nr)\.?\s*\d+\w?\W*)*(\w+)", plain[m.end() :], re.I)
        act = word[1].lower() if word else ""
        if act in lexicon.acts and act != own.lower():
            others += 1
        else:
            mine += 1
    return others > 0 and mine == 0


def defines(key: str, text: str | None, headings: Sequence[str | None] = (), lexicon: Lexicon | None = None) -> bool:
    """Whether a chunk defines a norm: its text begins with it, or a heading (signature, section) names it, and no other act is meant."""
    act = key.partition(":")[0]
    body = " ".join((text or "").split())
    for surface in surfaces(key):
        pattern = re.compile(bounded(surface))
        if pattern.match(body.lower()) and not names_other_act(body, surface, act, lexicon):
            return True
        for h in headings:
            if h and pattern.search(" ".join(h.lower().split())) and not names_other_act(h, surface, act, lexicon):
                return True
    return False


def resolve(keys: DataFrame, chunks: DataFrame, refs: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """(ref_key, chunk_id): the chunk that each key of keys(ref_key) points to.

    Candidates are the chunks that carry the key and, for an article of an EU
    regulation, the chunks of documents that cite the regulation in one of their
    first three chunks and name the article; if any of these defines it, it goes
    before the citing ones. The earliest defining chunk wins; without one the
    chunk with most references, then the earliest. chunks(id, document_id,
    chunk_index, text, signature, metadata, is_omitted); omitted ones are out.
    The choice is one grouping by key, so a key cited by any number of chunks
    needs no more than a row a task.
    """
    lexicon = lexicon or Lexicon()

    @F.pandas_udf("boolean")
    def is_site(it: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for key, text, signature, section in it:
            yield pd.Series([defines(k, t, (a, b), lexicon) for k, t, a, b in zip(key, text, signature, section, strict=True)], dtype=bool)

    section = F.get_json_object("metadata", "$.section")
    kept = chunks.where(~F.coalesce("is_omitted", F.lit(False))).select("id", "document_id", "chunk_index", "text", "signature", section.alias("section"))
    asked = keys.select("ref_key").distinct()
    used = refs.where("chunk_id is not null").select(F.col("chunk_id").alias("id"), "ref_key").distinct()
    density = used.groupBy("id").agg(F.count(F.lit(1)).alias("density"))
    citing = used.join(asked, "ref_key", "left_semi").join(kept, "id").withColumn("own", F.lit(False))
    # Articles of regulations: documents that cite the regulation early.
    parts = asked.select("ref_key", F.regexp_extract("ref_key", r"^(EU:[^:]+):Art\.(.+)$", 1).alias("act"), F.regexp_extract("ref_key", r"^(EU:[^:]+):Art\.(.+)$", 2).alias("art")).where("act <> ''")
    early = used.withColumnRenamed("ref_key", "act").join(kept.where("chunk_index <= 2").select("id", "document_id"), "id").select("act", "document_id").distinct()
    inside = parts.join(early, "act").join(kept, "document_id")
    named = F.concat_ws(" ", F.col("text"), F.col("signature"), F.col("section")).contains(F.col("art"))
    of_regulation = inside.where(named).select("id", "ref_key", "document_id", "chunk_index", "text", "signature", "section", F.lit(True).alias("own"))
    both = citing.select(*of_regulation.columns).unionByName(of_regulation)
    judged = both.withColumn("site", is_site("ref_key", "text", "signature", "section")).where("site or not own").join(density, "id", "left")
    first = F.struct(
        (~F.col("own")).alias("a"), (~F.col("site")).alias("b"), F.when(F.col("site"), F.lit(0)).otherwise(-F.coalesce("density", F.lit(0))).alias("c"), "document_id", "chunk_index", "id"
    )
    return judged.groupBy("ref_key").agg(F.min_by("id", first).alias("chunk_id"))


def expand_hits(primary: Sequence[int], targets: Sequence[Sequence[int]], k: int) -> list[tuple[int, int]]:
    """(chunk, rank of the hit) of referenced chunks to add: one a hit, at most half of k rounded up, none twice."""
    taken, out = set(primary), []
    for rank, options in enumerate(targets, 1):
        if len(out) >= -(-k // 2):
            break
        fresh = next((t for t in options if t not in taken), None)
        if fresh is not None:
            taken.add(fresh)
            out.append((fresh, rank))
    return out


def expand_all(hits: DataFrame, k: int) -> DataFrame:
    """(query_id, chunk_id, via_rank) for hits(query_id, rank, chunk_id, targets): expand_hits for every query."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        found = expand_hits(rows["chunk_id"].tolist(), [list(t) for t in rows["targets"]], k)
        return pd.DataFrame({"query_id": rows["query_id"].iloc[0], "chunk_id": [c for c, _ in found], "via_rank": [r for _, r in found]})

    return hits.groupBy("query_id").applyInPandas(one, "query_id long, chunk_id long, via_rank long")
