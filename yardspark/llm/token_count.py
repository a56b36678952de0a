"""Exact token counts of a word-level BPE vocabulary by prefix dynamic programming.

For every prefix of a word the last token of its encoding is the only one that forms a valid pair with the last token
of the prefix before it, so one table per word gives the exact count at each prefix. Words are encoded apart from each
other, so a text's count at each word's end is a running sum, which answers truncation and budget questions without
encoding again. Vocabulary files are read on the driver from the given path and sent as they are (a few MB).

A null or empty text has 0 tokens. Special strings inside a text count as one token each. Each row is counted alone,
also where its id repeats or is null. An empty table gives an empty one; columns named like an output are replaced.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from yardspark.llm._words import pieces

#: Entries in each half of a task's memory of words.
MEMORY = 200_000
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_ODD = re.compile("[\x1c-\x1f]")


class Memory:
    """A bounded dictionary: when the new half is full it becomes the old one, whose entries move up when used."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        if (found := self.new.get(key)) is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            old, self.old = self.old, dict(self.new)
            old.clear()
            self.new.clear()
        self.new[key] = value


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class PrefixCounter:
    """Counts for one vocabulary file of kind BPE with a mark at word ends."""

    def __init__(self, text: str):
        file = json.loads(text)
        model = file["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.tokens = set(model["vocab"])
        self.longest = max(len(t) for t in self.tokens)
        self.letters = byte_letters()
        special = sorted((t["content"] for t in file["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        split = next(x for x in file["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves = {a + b: (a, b) for a, b in self.rank}
        self.edges: tuple[dict, dict] = ({}, {})
        self.own: dict[str, bool] = {}
        self.words, self.pieces = Memory(MEMORY), Memory(MEMORY)

    def encode(self, symbols: list[str]) -> list[str]:
        """Plain ranked merging; used for the short texts that decide whether a pair is valid."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 60))
            if (symbols[best], symbols[best + 1]) not in self.rank:
                break
            a, b, out, i = symbols[best], symbols[best + 1], [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and symbols[i] == a and symbols[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _symbols(self, token: str, last: bool) -> list[str]:
        if last and self.end:
            return [*token[: -len(self.end) - 1], token[-len(self.end) - 1 :]]
        return list(token)

    def valid(self, a: str, b: str) -> bool:
        """Whether no merge crosses the border of a and b before both are whole.

        Only the right edge of a and the left edge of b can meet. Two such parts merge when their rank comes before
        the ranks at which either is taken into a larger part; the leftmost of equal pairs goes first.
        """
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > MEMORY:
                self.pairs.clear()
            rank, left = self.rank, self.edge(b, 0)
            known = True
            for r, until in self.edge(a, 1):
                for x, most in left:
                    if (m := rank.get((r, x))) is not None and m < until and m <= most:
                        known = False
            self.pairs[a, b] = known
        return known

    def edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The token's parts at its left (0) or right (1) edge, each with the rank of the merge that takes it up."""
        if (known := self.edges[side].get(token)) is None:
            known, part, until = [(token, float("inf"))], token, 0
            while part in self.halves:
                until, part = self.rank[self.halves[part]], self.halves[part][side]
                known.append((part, until))
            self.edges[side][token] = known
        return known

    def whole(self, token: str) -> bool:
        """Whether a token's own symbols merge into it."""
        if (known := self.own.get(token)) is None:
            last = bool(self.end) and token.endswith(self.end)
            known = self.own[token] = self.encode(self._symbols(token, last)) == [token]
        return known

    def _last(self, word: str, i: int, inner: list[str], end: str) -> int:
        """Where the last token of word[:i] + end begins."""
        tokens, pairs = self.tokens, self.pairs
        for j in range(i - self.longest if i > self.longest else 0, i):
            if (t := word[j:i] + end) in tokens:
                if not j:
                    good = self.whole(t)
                elif (good := pairs.get((inner[j], t))) is None:
                    good = self.valid(inner[j], t)
                if good:
                    return j
        raise ValueError("the vocabulary lacks a byte")

    def _table(self, word: str) -> tuple[list[str], list[int]]:
        """The last token and the count of every prefix while the word goes on."""
        inner, size = [""], [0]
        for i in range(1, len(word) + 1):
            j = self._last(word, i, inner, "")
            inner.append(word[j:i])
            size.append(size[j] + 1)
        return inner, size

    def prefix_counts(self, piece: str) -> list[int]:
        """counts[i]: tokens of the first i bytes of the piece, taken as a word of their own; counts[0] is 0."""
        word = "".join(self.letters[b] for b in piece.encode())
        inner, size = self._table(word)
        return [0] + [size[self._last(word, i, inner, self.end)] + 1 for i in range(1, len(word) + 1)]

    def count(self, piece: str) -> int:
        word = "".join(map(self.letters.__getitem__, piece.encode()))
        if (t := word + self.end) in self.tokens and self.whole(t):
            return 1
        inner, size = self._table(word[:-1])
        return size[self._last(word, len(word), inner, self.end)] + 1

    def piece(self, text: str) -> int:
        if (n := self.pieces.get(text)) is None:
            self.pieces.put(text, n := self.count(text))
        return n

    def word(self, text: str) -> int:
        """Tokens of a run without white space, already normalised."""
        if (n := self.words.get(text)) is None:
            n = sum(map(self.piece, self.pattern.findall(text)))
            if len(text) < 64:
                self.words.put(text, n)
        return n

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def running(self, text: str) -> list[int]:
        """The tokens of each run without white space (a special string is one such run) in order."""
        at, out = 0, []
        for m in self.special.finditer(text) if self.special else ():
            out += self._plain(text[at : m.start()])
            out.append(1)
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[int]:
        text = self.normal(text)
        runs = [x for x in _SPACES.split(text) if x] if _ODD.search(text) else text.split()
        known = self.words.new  # looked up here without a call; older entries are found by word()
        return [n if (n := known.get(x)) is not None else self.word(x) for x in runs]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens, over_limit and n_fit (runs without white space, from the start, that fit the limit)."""
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    docs = docs.drop("n_bytes", "n_tokens", "over_limit", "n_fit")
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType()), T.StructField("n_fit", T.LongType())]
    schema = T.StructType([*docs.schema.fields, *added])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = PrefixCounter(sent.value)  # of this task alone, so that idle workers hold nothing
        for batch in pieces(batches):
            size, total, fit = [], [], []
            for x in batch.column(at).to_pylist():
                each = count.running(x or "")
                size.append(len((x or "").encode()))
                total.append(n := sum(each))
                if n > limit:
                    left, i = limit, 0
                    while each[i] <= left:
                        left -= each[i]
                        i += 1
                    fit.append(i)
                else:
                    fit.append(len(each))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array([n > limit for n in total], pa.bool_()), pa.array(fit, pa.int64())], names=schema.names)

    return docs.mapInArrow(run, schema)
