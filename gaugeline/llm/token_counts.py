"""Token counts by rank-synchronous merging of arrays (operator 7).

The words of a batch are held as one flat array of symbols with the word of each symbol
beside it. In every round each word's lowest-ranked pair is found for all words at once and
all its places are merged at once; words without a pair that merges leave the arrays. What
is left of a word is its number of tokens. A word is merged once per worker while its count
is remembered; a text's count is the sum over its words.

Strings of special tokens inside a text count as one token each, as the vocabulary's library
does by default. Null texts are empty: no tokens. Nothing is cut off or padded.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeline.llm.common import only

#: Words whose counts are remembered in a worker.
MAX_WORDS = 400_000
#: Symbols merged together at most, unless one word is longer.
MAX_SYMBOLS = 2_000_000
_NONE = np.int64(1) << 40

COUNT_SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from U+0100."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    taken, names = set(plain), []
    for byte in range(256):
        names.append(chr(byte) if byte in taken else chr(0x100 + sum(b not in taken for b in range(byte))))
    return names


class WordCounter:
    """Merges of a vocabulary file with a suffix at word ends."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        parts = [step["pattern"]["Regex"] for step in spec["pre_tokenizer"]["pretokenizers"] if step["type"] == "Split"]
        self.words = regex.compile(parts[0])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        names = byte_symbols()
        self.inner = np.array([vocab[n] for n in names], dtype=np.int64)
        self.last = np.array([vocab[n + suffix] for n in names], dtype=np.int64)
        left = np.array([vocab[a] for a, _ in model["merges"]], dtype=np.int64)
        right = np.array([vocab[b] for _, b in model["merges"]], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in model["merges"]], dtype=np.int64)
        self.width = np.int64(max(vocab.values()) + 1)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        self.known: dict[str, int] = {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        pair = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        return np.where(self.keys[at] == pair, self.ranks[at], _NONE)

    def merge(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each word."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        counts = lengths.copy()
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        owner = np.repeat(np.arange(len(words)), lengths)
        while len(symbols) > 1:
            rank = np.full(len(symbols), _NONE)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inside] = self.rank_of(symbols[inside], symbols[inside + 1])
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(symbols)])
            live = lowest < _NONE
            if not live.all():
                done = np.flatnonzero(~live)
                counts[owner[first[done]]] = size[done]
                keep = np.repeat(live, size)
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                lowest, size = lowest[live], size[live]
                if not len(symbols):
                    break
            hit = rank == np.repeat(lowest, size)
            # Of places that overlap (a a a) every second one from the left merges.
            at = np.flatnonzero(hit)
            new_run = np.r_[True, at[1:] != at[:-1] + 1]
            begin = at[np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))]
            at = at[(at - begin) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols):
            counts[owner[0]] = len(symbols)
        return counts

    def pieces(self, text: str) -> tuple[int, list[str]]:
        """Special tokens in a text, and the words of the rest."""
        if self.special is None or not self.special.search(text):
            return 0, self.words.findall(self.normal(text))
        parts = self.special.split(text)
        return len(parts) - 1, [w for part in parts for w in self.words.findall(self.normal(part))]

    @staticmethod
    def normal(text: str) -> str:
        # Lower-casing goes letter by letter: a capital sigma has one small form wherever it stands.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def learn(self, words: Iterable[str]) -> None:
        block: list[str] = []
        size = 0
        for word in words:
            block.append(word)
            size += len(word)
            if size >= MAX_SYMBOLS:
                self._learn_block(block)
                block, size = [], 0
        if block:
            self._learn_block(block)

    def _learn_block(self, block: list[str]) -> None:
        counts = self.merge([w.encode("utf-8", "surrogatepass") for w in block])
        self.known.update(zip(block, counts.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pieces(t) for t in texts]
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        known = self.known
        self.learn(dict.fromkeys(w for _, words in split for w in words if w not in known))
        get = known.__getitem__
        return [n + sum(map(get, words)) for n, words in split]


_COUNTERS: dict[str, WordCounter] = {}


def counter(path: str) -> WordCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = WordCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, UTF-8 bytes, tokens, and whether the tokens exceed ``limit``: one row per row of ``docs``."""

    def count(batches):
        own = counter(path)
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                texts, size = [], 0
                while start + len(texts) < batch.num_rows and size < MAX_SYMBOLS:
                    texts.append(batch.column(1)[start + len(texts)].as_py() or "")
                    size += len(texts[-1])
                tokens = own.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([n > limit for n in tokens], pa.bool_()),
                    ],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )
                start += len(texts)

    return only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(count, COUNT_SCHEMA)
