"""Corpus encoding with a public byte-level BPE vocabulary.

The distinct words of a block of texts are walked in sorted order, which is a
depth-first traversal of their trie: the states of a shared prefix are computed
once. The state of a prefix is the last token of its encoding. A token t ending
at position i is that last token exactly if it may follow the last token of the
prefix before it, which holds if the two alone encode to themselves. A word's
ids are read off by stepping back through the states.
"""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Folder of the public vocabulary files; a parameter everywhere below.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words and pairs a worker remembers before it starts anew; they bear on speed only.
MAX_REMEMBERED = 150_000
#: Words longer than this are not remembered.
LONGEST_REMEMBERED = 64
#: Characters of text handled at once.
BLOCK_CHARS = 4_000_000


def vocabulary(name: str, folder: str = TOKENIZERS) -> bytes:
    """The rank file of a vocabulary (under 2 MB, so it may be broadcast)."""
    path = Path(folder, f"{name}.tiktoken")
    if not path.exists() and (spec := importlib.util.find_spec("public_tokenizers")):
        path = Path(spec.origin).parent / f"{name}.tiktoken"
    return path.read_bytes()


class PrefixEncoder:
    """Encoder of many words that shares the work on common prefixes."""

    def __init__(self, rank_file: bytes) -> None:
        pairs = (line.split() for line in rank_file.splitlines() if line)
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.split = regex.compile(PATTERN).findall
        self._fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, np.ndarray] = {}

    def merge(self, text: bytes) -> list[int]:
        """Plain BPE: merge the pair of lowest rank, leftmost first, until none is left."""
        parts = [text[i : i + 1] for i in range(len(text))]
        ranks = self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, encode to themselves. left -1: the start."""
        key = (left, right)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 4 * MAX_REMEMBERED:
                self._fits.clear()
            if left < 0:
                known = self.merge(self.bytes_of[right]) == [right]
            else:
                known = self.merge(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
            self._fits[key] = known
        return known

    def encode_sorted(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Ids of each word. Sorted words share the states of their common prefixes."""
        ranks, longest, fits = self.ranks, self.longest, self.may_follow
        last: list[int] = [-1]  # last token of each prefix of the current word
        size: list[int] = [0]
        before = b""
        for word in words:
            shared = 0
            for x, y in zip(before, word, strict=False):
                if x != y:
                    break
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for i in range(shared + 1, len(word) + 1):
                for n in range(min(i, longest), 0, -1):
                    t = ranks.get(word[i - n : i])
                    if t is not None and fits(last[i - n], t):
                        last.append(t)
                        size.append(n)
                        break
            out, i = [], len(word)
            while i:
                out.append(last[i])
                i -= size[i]
            out.reverse()
            yield out
            before = word

    def encode_block(self, texts: list[str | None]) -> list[list[np.ndarray]]:
        """The encoded words of each text; null and empty texts have none."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.words) > MAX_REMEMBERED:
            self.words.clear()
        known = self.words
        new = {w for ws in split for w in ws if w not in known}
        pairs = sorted((w.encode("utf-8"), w) for w in new)
        fresh = {w: np.asarray(ids, dtype=np.int32) for (_, w), ids in zip(pairs, self.encode_sorted(b for b, _ in pairs), strict=True)}
        out = [[known[w] if w in known else fresh[w] for w in ws] for ws in split]
        known.update((w, ids) for w, ids in fresh.items() if len(w) <= LONGEST_REMEMBERED)
        return out


_encoders: dict[int, PrefixEncoder] = {}


def _encoder(rank_file: bytes) -> PrefixEncoder:
    """One encoder a worker process."""
    key = hash(rank_file)
    if key not in _encoders:
        _encoders[key] = PrefixEncoder(rank_file)
    return _encoders[key]


def _blocks(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive texts of together about BLOCK_CHARS characters, with the place of the first."""
    block: list[str | None] = []
    start = chars = 0
    for i, value in enumerate(texts):
        t = value.as_py()
        block.append(t)
        chars += len(t or "")
        if chars >= BLOCK_CHARS:
            yield start, block
            block, start, chars = [], i + 1, 0
    if block:
        yield start, block


def encode(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of each row, without special tokens, in one pass without a shuffle.

    Null and empty texts give an empty list. Strings that look like special
    tokens are ordinary text. Repeated rows come out as often as they are there;
    other columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for start, texts in _blocks(batch.column(1)):
                words = encoder.encode_block(texts)
                flat = [a for ws in words for a in ws]
                lengths = [sum(map(len, ws)) for ws in words]
                offsets = np.zeros(len(texts) + 1, dtype=np.int32)
                np.cumsum(lengths, out=offsets[1:])
                values = np.concatenate(flat) if flat else np.empty(0, dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), ids], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<int>")


def count_tokens(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) of each row, as encode but without the ids."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary(tokenizer, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared.value)
        for batch in batches:
            for start, texts in _blocks(batch.column(1)):
                n = [sum(map(len, ws)) for ws in encoder.encode_block(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(n, pa.int64())], names=[key, "n_tokens"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long")
