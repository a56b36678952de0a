"""Split of texts into independent chunks, their pretokens, and tables of values by chunk, for byte-level vocabularies."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import regex

from yardspark.llm._words import SLICE_BYTES, codes, mix

# white space as Unicode's property has it (the regex classes of Python's re take four control characters more)
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: At most one white-space character and the run of others that follows; other white space stands alone. No match of
#: the pretoken pattern spans the border of two chunks, so chunks can be looked up and encoded apart.
chunks = re.compile(f"[{_WHITE}]?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+").findall


#: White space beyond ASCII in UTF-8; texts that hold some are cut by the pattern, others by their bytes.
_ODD = re.compile(b"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80").search
_BORDER = re.compile(rb"[^\t-\r ] (?![\t-\r ])").search
_LETTER = np.array([b < 128 and chr(b).isalpha() for b in range(256)])
_SIGN = np.array([32 < b < 127 and not chr(b).isalnum() and b != 39 for b in range(256)])
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


#: Whether a chunk (UTF-8) is a run of Latin letters, with or without a blank in front: then it is one pretoken of any
#: pattern that takes a run of letters as one. Others may be too, but have to be split.
letters = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def segments(text: bytes, most: int = SLICE_BYTES) -> list[bytes]:
    """A text in parts of about `most` bytes, cut at borders of chunks; whole where it is short, or odd."""
    if len(text) <= most or _ODD(text):
        return [text]
    out, at = [], 0
    while len(text) - at > most and (found := _BORDER(text, at + most)):
        out.append(text[at : found.start() + 1])
        at = found.start() + 1
    return [*out, text[at:]]


def _eights(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number from the first and the last eight bytes of each run."""
    out = []
    for at in (start[:, None] + np.arange(8), end[:, None] - np.arange(8, 0, -1)):
        inside = (at >= start[:, None]) & (at < end[:, None])
        out.append(np.where(inside, raw[np.clip(at, 0, max(0, len(raw) - 1))], 0).astype(np.uint8).view(np.uint64).ravel() if len(start) else np.empty(0, np.uint64))
    return mix(out[0]) ^ out[1]


class Chunks:
    """The distinct chunks of some texts (UTF-8), in order of their first places.

    number: the number of each chunk of the texts among these, in text order; per_text: chunks of each text; code and
    check: a 64-bit hash of each distinct chunk, and a number from its first and last eight bytes. Chunks of the texts
    at hand are told apart by the hash.
    """

    def __init__(self, texts: list[bytes]):
        joined = b"".join(texts)
        if _ODD(joined):
            cut = [chunks(t.decode()) for t in texts]
            found: dict[str, int] = {}  # a dict, as pandas takes strings as equal that differ behind a NUL
            self.number = np.array([found.setdefault(c, len(found)) for x in cut for c in x], np.int64)
            self.per_text = np.array([len(x) for x in cut], np.int64)
            self._set(b"".join(e := [c.encode() for c in found]), np.cumsum([0] + [len(c) for c in e]))
            return
        raw = np.frombuffer(joined, np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        first = (np.cumsum(size) - size)[size > 0]
        blank = _SPACE[raw]
        # chunks begin at texts, at runs of blanks, at the last blank before a word, and at a sign behind a letter (but for
        # an apostrophe), where every pattern ends a pretoken
        begins = np.zeros(len(raw) + 1, bool)
        inner = np.ones(len(raw), bool)
        inner[first] = False
        begins[1:-1] |= blank[1:] & ~blank[:-1]
        begins[:-2] |= blank[:-1] & ~blank[1:] & inner[1:]
        begins[1:-1] |= _SIGN[raw[1:]] & _LETTER[raw[:-1]]
        begins[first] = True
        start = np.flatnonzero(begins[:-1])
        end = np.append(start[1:], len(raw)) if len(start) else start
        code = codes(raw, start, end)
        self.number = pd.factorize(code)[0].astype(np.int64) if len(start) else np.empty(0, np.int64)
        one = np.empty(int(self.number.max()) + 1 if len(start) else 0, np.int64)
        one[self.number[::-1]] = np.arange(len(start))[::-1]  # the first place of each
        self.per_text = np.diff(np.searchsorted(start, np.append(np.cumsum(size) - size, len(raw))))
        self.joined, self.start, self.end, self.code = joined, start[one], end[one], code[one]
        self.check = _eights(raw, self.start, self.end)

    def _set(self, joined: bytes, edges: np.ndarray) -> None:
        raw = np.frombuffer(joined, np.uint8)
        self.joined, self.start, self.end = joined, edges[:-1].astype(np.int64), edges[1:].astype(np.int64)
        self.code, self.check = codes(raw, self.start, self.end), _eights(raw, self.start, self.end)

    @classmethod
    def of(cls, found: list[bytes]) -> Chunks:
        """Given distinct chunks."""
        self = cls.__new__(cls)
        self._set(b"".join(found), np.cumsum([0] + [len(c) for c in found]))
        return self

    def __getitem__(self, i: int) -> bytes:
        return self.joined[self.start[i] : self.end[i]]

    def take(self, at: np.ndarray) -> list[bytes]:
        joined = self.joined
        return [joined[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs flat[start : start + size] one after another."""
    return flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


class Table:
    """Values (runs of numbers in one flat array) of chunks, found by their hash and check."""

    def __init__(self, code: np.ndarray, check: np.ndarray, size: np.ndarray, flat: np.ndarray):
        order = np.argsort(code, kind="stable")
        again = np.zeros(len(code), bool)
        again[1:] = code[order][1:] == code[order][:-1]
        order = order[~again]  # the other of two chunks of one hash is as if it were not there
        self.code, self.check, self.size, self.start, self.flat = code[order], check[order], size[order], (np.cumsum(size) - size)[order], flat

    @classmethod
    def empty(cls) -> Table:
        return cls(np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, "<u4"))

    def find(self, code: np.ndarray, check: np.ndarray) -> np.ndarray:
        """The place of each chunk, -1 where it is not known."""
        if not len(self.code):
            return np.full(len(code), -1)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where((self.code[at] == code) & (self.check[at] == check), at, -1)

    def with_more(self, code: np.ndarray, check: np.ndarray, size: np.ndarray, flat: np.ndarray) -> Table:
        """A table that also holds other chunks."""
        out = Table.__new__(Table)
        order = np.argsort(code, kind="stable")
        at = np.searchsorted(self.code, code[order])
        put = lambda old, new: np.insert(old, at, new[order])
        out.code, out.check, out.size = put(self.code, code), put(self.check, check), put(self.size, size)
        out.start, out.flat = put(self.start, len(self.flat) + np.cumsum(size) - size), np.concatenate((self.flat, flat))
        return out


def splitter(pattern: str):
    """The function that gives a chunk's pretokens."""
    return regex.compile(pattern).findall
