"""Subword ids of whole texts, one look-up per word.

A tokenizer that splits at and drops white space gives each white-space
delimited word the same ids wherever it stands, so a worker encodes each
different word once and assembles texts from the results with numpy.  The
memory of words is a cache: it is emptied when full and nothing depends on it.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np

from .shingles import word_bounds, word_hashes

CACHE_WORDS = 1_200_000
#: the split of the public word tokenizer: letters and punctuation never share a subword
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MARKS = b".,;:!?"


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Numbered(dict):
    """Word -> number; a new word gets the next number and is noted."""

    __slots__ = ("fresh",)

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class _Grown:
    """A growing numpy column."""

    def __init__(self, dtype):
        self.a, self.n = np.zeros(1 << 16, dtype), 0

    def add(self, x: np.ndarray) -> None:
        need = self.n + len(x)
        if need > len(self.a):
            bigger = np.zeros(max(need, len(self.a) * 3 // 2), self.a.dtype)
            bigger[: self.n] = self.a[: self.n]
            self.a = bigger
        self.a[self.n : need] = x
        self.n = need


class WordEncoder:
    """Encodes documents to subword ids with a public tokenizer file."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.limit = limit
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        steps = conf.get("normalizer") or {}
        self.lower = "Lowercase" in [x.get("type") for x in steps.get("normalizers", [steps])]
        splits = conf.get("pre_tokenizer") or {}
        self.closes = np.zeros(self.tok.get_vocab_size(), bool)
        for piece, i in self.tok.get_vocab().items():
            self.closes[i] = piece.endswith("</w>")
        self.marks = self.lower and any(x.get("pattern") == {"Regex": _SPLIT} for x in splits.get("pretokenizers", [splits]))
        self._clear()

    def _clear(self) -> None:
        self.known = _Numbered()
        self.start, self.size, self.ids = _Grown(np.int64), _Grown(np.int32), _Grown(np.uint32 if self.tok.get_vocab_size() > 65536 else np.uint16)

    def _learn(self) -> None:
        """Ids of the new words.  A letter before closing marks parts them: such words are put together."""
        fresh, self.known.fresh = self.known.fresh, []
        begun = self.start.n
        whole, joined = [], []
        for n, w in enumerate(fresh, begun):
            stem = w.rstrip(_MARKS) if self.marks else w
            if len(stem) < len(w) and stem and stem[-1:].isalpha() and stem[-1:].isascii():
                joined.append((n, self.known[stem], self.known[w[len(stem) :]]))
            else:
                whole.append((n, w))
        more, self.known.fresh = self.known.fresh, []
        whole += enumerate(more, begun + len(fresh))
        total = len(fresh) + len(more)
        start, size = np.zeros(total, np.int64), np.zeros(total, np.int32)
        self._encode([w for _, w in whole], np.array([n - begun for n, _ in whole], np.int64), start, size)
        self.start.add(start)
        self.size.add(size)
        if joined:
            n, stem, mark = np.array(joined).T
            a, b = self.size.a[stem].astype(np.int64), self.size.a[mark].astype(np.int64)
            both = a + b
            ends = np.cumsum(both)
            first = np.arange(ends[-1]) - np.repeat(ends - both, both)
            take = np.where(first < np.repeat(a, both), np.repeat(self.start.a[stem], both) + first, np.repeat(self.start.a[mark] - a, both) + first)
            self.start.a[n], self.size.a[n] = self.ids.n + ends - both, both
            self.ids.add(self.ids.a[take])

    def _encode(self, fresh: list[bytes], at: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> None:
        """Words of letters alone are encoded many at a time: each ends with its only closing id."""
        texts = [w.decode("utf-8", "replace") for w in fresh]
        alone = np.array([not (self.marks and t.isalpha() and t.lower().isalpha()) for t in texts], bool)
        for group, many in ((np.flatnonzero(~alone), 256), (np.flatnonzero(alone), 1)):
            for i in range(0, len(group), 64 * 256):
                part = group[i : i + 64 * 256]
                lines = [" ".join([texts[x] for x in part[j : j + many]]) for j in range(0, len(part), many)]
                got = [e.ids for e in self.tok.encode_batch_fast(lines, add_special_tokens=False)]
                flat = np.fromiter(chain.from_iterable(got), self.ids.a.dtype, sum(map(len, got)))
                size = np.fromiter(map(len, got), np.int64, len(got))
                if many > 1:
                    size = np.diff(np.r_[0, np.flatnonzero(self.closes[flat]) + 1])
                    if len(size) != len(part):
                        raise ValueError("a word of letters has several closing ids")
                start[at[part]] = self.ids.n + np.cumsum(size) - size
                sizes[at[part]] = size
                self.ids.add(flat)

    def word_numbers(self, texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words in turn, words of each text)."""
        if len(self.known) > self.limit:
            self._clear()
        split = [t.lower().split() for t in texts] if lower or self.lower else [t.split() for t in texts]
        counts = np.fromiter(map(len, split), np.int64, len(split))
        numbers = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        if self.known.fresh:
            self._learn()
        return numbers, counts

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in turn, offsets of the texts); ``end`` closes each text."""
        numbers, counts = self.word_numbers(texts)
        size = self.size.a[numbers].astype(np.int64)
        upto = np.r_[0, np.cumsum(size)]
        total = int(upto[-1])
        flat = self.ids.a[np.repeat(self.start.a[numbers] - upto[:-1], size) + np.arange(total)]
        self.upto = upto  # ids before each word, for who asks
        word_at = np.r_[0, np.cumsum(counts)]
        off = upto[word_at]
        if end is None:
            return flat, off
        off = off + np.arange(len(off))
        out = np.full(int(off[-1]), end, flat.dtype)
        body = np.ones(len(out), bool)
        body[off[1:] - 1] = False
        out[body] = flat
        return out, off


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: closing marks: those of ASCII but what contractions and the tokenizer's own marks have
_MARK = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&()*+,-./:;=?@[\\]^_`{}~", np.uint8))
#: by their two bytes, letters of Latin 1 and its extensions (U+00C0 to U+024F) that stay one letter in lower case
_LATIN = np.zeros((256, 256), bool)
for _c in range(0xC0, 0x250):
    _LATIN[tuple(chr(_c).encode())] = _c not in (0xD7, 0xF7, 0x130)


class HashedEncoder(WordEncoder):
    """Words told apart by their 64-bit hashes alone: no Python object is kept of any.

    For users who know words by these hashes anyway.  A-Z count as a-z.
    ``spells(words)`` says of words with other letters what is kept in ``plain``.
    """

    def __init__(self, path: str, spells, limit: int = CACHE_WORDS):
        self.spells = spells
        super().__init__(path, limit)
        self.letters = self._of_letters(path)

    def _of_letters(self, path: str):
        """A tokenizer for words of a-z: the same model without the steps that leave them as they are."""
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        steps = [conf.get("normalizer") or {}, conf.get("pre_tokenizer") or {}]
        for key, i in (("normalizers", 0), ("pretokenizers", 1)):
            steps[i] = [x for x in steps[i].get(key, [steps[i]]) if x]
        same = all(x["type"] in ("NFC", "Lowercase") or x == {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "} for x in steps[0])
        split = [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        if not (self.marks and same and steps[1] == split and not conf.get("post_processor")):
            return self.tok
        tok = Tokenizer(self.tok.model)
        tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return tok

    def _clear(self) -> None:
        self.n, self.key, self.number = 0, np.zeros(1 << 17, np.uint64), np.full(1 << 17, -1, np.int32)
        self.start, self.size, self.ids = _Grown(np.int64), _Grown(np.int32), _Grown(np.uint32 if self.tok.get_vocab_size() > 65536 else np.uint16)
        self.hash, self.bytes, self.plain = _Grown(np.uint64), _Grown(np.int64), _Grown(bool)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers of words by hash; -1: not known."""
        mask = np.uint64(len(self.key) - 1)
        at = (h & mask).astype(np.int64)
        got = self.number[at]
        todo = np.flatnonzero((got >= 0) & (self.key[at] != h))
        while len(todo):
            a = at[todo] = (at[todo] + 1) & int(mask)
            got[todo] = self.number[a]
            todo = todo[(got[todo] >= 0) & (self.key[a] != h[todo])]
        return got

    def _add(self, h: np.ndarray) -> None:
        """Different new words get the next numbers."""
        self.hash.add(h)
        self.n += len(h)
        fresh = self.n - len(h)
        if 2 * self.n > len(self.key):
            size = len(self.key)
            while 2 * self.n > size:
                size *= 2
            self.key, self.number, fresh = np.zeros(size, np.uint64), np.full(size, -1, np.int32), 0
        h = self.hash.a[fresh : self.n]
        mask, number = len(self.key) - 1, np.arange(fresh, self.n, dtype=np.int32)
        at, todo = (h & np.uint64(mask)).astype(np.int64), np.arange(len(h))
        while len(todo):
            free = todo[self.number[at[todo]] < 0]
            self.number[at[free]] = number[free]
            won = self.number[at[todo]] == number[todo]
            self.key[at[todo[won]]] = h[todo[won]]
            todo = todo[~won]
            at[todo] = (at[todo] + 1) & mask

    def numbers(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words in turn, words of each text)."""
        if self.n > self.limit:
            self._clear()
        s, e, doc = word_bounds(data, off)
        h = word_hashes(data, s, e)
        got = self.find(h)
        miss = np.flatnonzero(got < 0)
        if len(miss):
            new, at, back = np.unique(h[miss], return_index=True, return_inverse=True)
            o = np.argsort(at)
            rank = np.empty(len(o), np.int64)
            rank[o] = np.arange(len(o))
            got[miss] = self.n + rank[back]
            at = miss[at[o]]
            self._learn_at(data, s[at], e[at], new[o])
        return got, np.bincount(doc, minlength=len(off) - 1)

    def _learn_at(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> None:
        """Ids of new words at these places, which ascend.  A letter before closing marks parts them, as in `_learn`."""
        inside = np.zeros(len(data) + 1, np.int8)  # the words alone, one after the other: most of the texts is known
        inside[s] += 1
        inside[e] -= 1
        data = data[np.cumsum(inside[:-1], dtype=np.int8, out=inside[:-1]).view(bool)]
        n = e - s
        e = np.cumsum(n)
        s = e - n
        begun = self.n
        stop = e
        if self.marks:
            stop = np.where(_MARK[data], 0, np.arange(1, len(data) + 1, dtype=np.int32))
            stop = np.maximum(np.maximum.accumulate(stop)[e - 1], s)
        before = data[stop - 1]
        joined = np.flatnonzero((stop < e) & (stop > s) & (_LETTER[before] | (stop > s + 1) & _LATIN[data[stop - 2], before]))
        self._add(h)
        sides = []
        for x, y in ((s[joined], stop[joined]), (stop[joined], e[joined])):
            side = word_hashes(data, x, y)
            got = self.find(side)
            miss = np.flatnonzero(got < 0)
            if len(miss):
                more, at, back = np.unique(side[miss], return_index=True, return_inverse=True)
                got[miss] = self.n + back
                self._add(more)
                s, e = np.r_[s, x[miss[at]]], np.r_[e, y[miss[at]]]
            sides.append(got)
        whole = np.ones(len(s), bool)
        whole[joined] = False
        low = _LOWER[data].tobytes()
        upto = np.zeros((2, len(data) + 1), np.int32)
        np.cumsum(~_LETTER[data], out=upto[0, 1:])
        np.cumsum(data > 127, out=upto[1, 1:])
        start, size = np.zeros(len(s), np.int64), np.zeros(len(s), np.int32)
        letters = upto[0][e] == upto[0][s]
        fast = np.flatnonzero(whole & letters) if self.marks else np.zeros(0, np.int64)
        whole[fast] = False
        for i in range(0, len(fast), 64 * 256):
            at = fast[i : i + 64 * 256]
            n = e[at] - s[at] + 1  # and a space
            ends = np.cumsum(n)
            text = _LOWER[data[np.minimum(np.repeat(s[at] - (ends - n), n) + np.arange(ends[-1]), len(data) - 1)]]
            text[ends - 1] = 32
            cut = np.r_[0, ends[255::256], ends[-1]]
            text = text.tobytes().decode("ascii")
            got = [x.ids for x in self.letters.encode_batch_fast([text[a:b] for a, b in zip(cut[:-1], cut[1:]) if b > a], add_special_tokens=False)]
            flat = np.fromiter(chain.from_iterable(got), self.ids.a.dtype, sum(map(len, got)))
            n = np.diff(np.r_[0, np.flatnonzero(self.closes[flat]) + 1])
            if len(n) != len(at):
                raise ValueError("a word of letters has several closing ids")
            start[at], size[at] = self.ids.n + np.cumsum(n) - n, n
            self.ids.add(flat)
        rest = np.flatnonzero(whole)
        self._encode([low[a:b] for a, b in zip(s[rest].tolist(), e[rest].tolist())], rest, start, size)
        plain = np.ones(len(s), bool)
        odd = np.flatnonzero(upto[1][e] > upto[1][s])
        if len(odd):
            plain[odd] = self.spells([low[a:b] for a, b in zip(s[odd].tolist(), e[odd].tolist())])
        self.start.add(start)
        self.size.add(size)
        self.bytes.add(e - s)
        self.plain.add(plain)
        if len(joined):
            stem, mark = sides
            a, b = self.size.a[stem].astype(np.int64), self.size.a[mark].astype(np.int64)
            both = a + b
            ends = np.cumsum(both)
            first = np.arange(ends[-1]) - np.repeat(ends - both, both)
            take = np.where(first < np.repeat(a, both), np.repeat(self.start.a[stem], both) + first, np.repeat(self.start.a[mark] - a, both) + first)
            n = begun + joined
            self.start.a[n], self.size.a[n] = self.ids.n + ends - both, both
            self.ids.add(self.ids.a[take])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def hashed_encoder(path: str, spells) -> HashedEncoder:
    """One for each Python worker and file."""
    if f"hashed:{path}" not in _ENCODERS:
        _ENCODERS[f"hashed:{path}"] = HashedEncoder(path, spells)
    return _ENCODERS[f"hashed:{path}"]


def release() -> None:
    """Free the worker's encoders: stages that only read ids need none."""
    _ENCODERS.clear()


def slices(data: np.ndarray, off: np.ndarray, size: int = 2 << 20):
    """Ranges of texts of about ``size`` bytes together."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, side="right")) - 1)
        yield i, j, [data[s:e].tobytes() for s, e in zip(off[i:j], off[i + 1 : j + 1])]
        i = j
