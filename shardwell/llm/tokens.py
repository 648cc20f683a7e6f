"""Token ids of whole texts with the tokenizers library, by distinct words.

The tokenizers handled here drop white space and never join characters across it, so a text's ids are
its words' ids in a row. Each distinct word is encoded once by the library and remembered with its
bytes, up to `REMEMBERED` words of a worker; then the memory starts afresh. Words are found, hashed,
looked up and compared with the bytes of what was found as whole arrays; a word whose hash another word
has is encoded anew.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textkit import U64, flat, same_spans, span_hash

REMEMBERED = 1_200_000
REMEMBERED_BYTES = 24 << 20
#: A control character with an id of its own.
MARK, BETWEEN = b"\x01", b" \x01 "
#: Words in a text that the library gets; longer texts cost it more for each word.
TOGETHER = 128
_loaded: dict[str, WordEncoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def drops_white_space(path: str) -> bool:
    """Whether words can be encoded apart: a Split that removes what lies between its matches, on \\s-free matches."""
    with open(path) as f:
        spec = json.load(f)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [spec.get("pre_tokenizer") or {}]
    return any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and r"[^\s" in (s.get("pattern") or {}).get("Regex", "") for s in steps)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE, _SOLID, _STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SOLID[[*range(48, 58), *range(97, 123)]] = True
_STOP[list(b".,!?;:%$*&#|()+=\"")] = True


class HashTable:
    """Numbers by 64-bit key, with open addressing, for arrays of keys at a time."""

    def __init__(self, bits: int = 16):
        self.bits, self.count = bits, 0
        self.keys, self.values = np.zeros(1 << bits, U64), np.zeros(1 << bits, np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where there is none. Key 0 stands for 1."""
        mask = (1 << self.bits) - 1
        keys = np.maximum(keys, U64(1))
        at = (keys & U64(mask)).astype(np.int64)
        have = self.keys[at]
        out = np.where(have == keys, self.values[at], -1)
        open_ = np.flatnonzero((have != keys) & (have != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            have = self.keys[at[open_]]
            hit = have == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (have != 0)]
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        while 2 * (self.count + len(keys)) > 1 << self.bits:
            full = np.flatnonzero(self.keys)
            old, numbers = self.keys[full], self.values[full]
            self.__init__(self.bits + 1)
            self._put(old, numbers)
        self._put(np.maximum(keys, U64(1)), values)

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        self.count += len(keys)
        at = (keys & U64(mask)).astype(np.int64)
        while len(keys):
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[free]  # of several for one place, one stays
            set_ = self.keys[at] == keys
            self.values[at[set_]] = values[set_]
            keys, values, at = keys[~set_], values[~set_], (at[~set_] + 1) & mask


class WordEncoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        alone = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        self.mark = alone[0] if len(alone) == 1 else -1
        self.by_word = drops_white_space(path) and self.mark >= 0
        # 'A' and 'a' give the same ids, and a letter and a stop after it are never joined
        self.folds = self.by_word and all(self._whole(a) == self._whole(b) for a, b in (("Ab.", "ab ."), ("R2!!", "r2 !!"), ("x,", "X ,")))
        self.forget()

    @classmethod
    def load(cls, path: str) -> WordEncoder:
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.known = HashTable()
        self.ids, self.used = np.zeros(1 << 20, np.uint32), 0
        self.at, self.length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.count, self.bytes, self.bytes_used = 0, np.zeros((1 << 20) + 8, np.uint8), 0
        self.word_at, self.word_size = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)

    def _ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words and how many each has. A mark that stands between words tells them apart, so the library sees few texts; words that hold the mark go alone."""
        if MARK in b" ".join(words):
            lists = [x.ids for x in self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
            return np.array([y for x in lists for y in x], np.uint32), np.array([len(x) for x in lists], np.int64)
        texts = [BETWEEN.join(words[i : i + TOGETHER]).decode() for i in range(0, len(words), TOGETHER)]
        lists = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        got = np.array([y for x in lists for y in (*x, self.mark)][:-1], np.uint32)
        marks = np.flatnonzero(got == self.mark)
        sizes = np.diff(np.concatenate([[-1], marks, [len(got)]])) - 1
        if len(sizes) != len(words):
            raise AssertionError("the mark between words does not tell them apart")
        return got[got != self.mark], sizes

    def _learn(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words that are put in."""
        odd = [i for i, w in enumerate(words) if MARK in w]
        marked = set(odd)
        rest = [i for i in range(len(words)) if i not in marked] if odd else list(range(len(words)))
        out = np.zeros(len(words), np.int32)
        for part in [x[i : i + 2048] for x in (rest, odd) for i in range(0, len(x), 2048)]:
            own = [words[i] for i in part]
            ids, sizes = self._ids(own)
            raw, lengths = np.frombuffer(b"".join(own), np.uint8), np.array([len(w) for w in own])
            k, total = self.count, len(ids)
            while k + len(part) > len(self.at):
                self.at, self.length, self.word_at, self.word_size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length, self.word_at, self.word_size))
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while self.bytes_used + len(raw) + 8 > len(self.bytes):
                self.bytes = np.concatenate([self.bytes, np.zeros_like(self.bytes)])
            self.ids[self.used : self.used + total] = ids
            self.bytes[self.bytes_used : self.bytes_used + len(raw)] = raw
            self.at[k : k + len(part)] = self.used + np.cumsum(sizes) - sizes
            self.length[k : k + len(part)] = sizes
            self.word_at[k : k + len(part)] = self.bytes_used + np.cumsum(lengths) - lengths
            self.word_size[k : k + len(part)] = lengths
            self.used += total
            self.bytes_used += len(raw)
            self.count += len(part)
            out[part] = np.arange(k, k + len(part), dtype=np.int32)
        return out

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (each closed by `end`), and how many each text has. Null counts as empty."""
        texts = pc.fill_null(column, "")
        special = np.asarray(pc.match_substring(texts, "<|"))
        if not self.by_word or special.any():
            return self._apart(texts, special if self.by_word else np.ones(len(texts), bool), end)
        flat_ids, per_text = self._by_word(texts)
        if end is None:
            return flat_ids, per_text
        return np.insert(flat_ids, np.cumsum(per_text), end), per_text + 1

    def _apart(self, texts: pa.Array, whole: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Texts marked `whole` go to the library as they are: a special token may stand in them."""
        ids, per = self._by_word(texts.filter(pa.array(~whole)))
        edge = np.cumsum(per)
        lists = iter(np.split(ids, edge[:-1]) if len(per) else [])
        others = iter(self.tokenizer.encode_batch(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False))
        close = np.array([] if end is None else [end], np.uint32)
        out = [np.concatenate([np.array(next(others).ids, np.uint32) if w else next(lists), close]) for w in whole.tolist()]
        return np.concatenate([np.zeros(0, np.uint32), *out]).astype(np.uint32), np.array([len(x) for x in out], np.int64)

    def _by_word(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, at = flat(texts)
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(at) - 1, np.int64)
        low = _FOLD[data] if self.folds else data
        inside = ~_SPACE[low]
        new = np.zeros(n + 1, bool)  # a word cannot go on to here from the byte before
        new[at] = True
        if self.folds:
            new[1:n] |= _SOLID[low[:-1]] & _STOP[low[1:]]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | new[1:n]
        ends[:-1] &= ~inside[1:] | new[1:n]
        start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        first = np.searchsorted(start, at)
        hashes = span_hash(low, start, stop)
        if self.count > REMEMBERED or self.bytes_used > REMEMBERED_BYTES:
            self.forget()
        codes = self.known.get(hashes)
        raw = low.tobytes()
        spans = lambda at: [raw[i:j] for i, j in zip(start[at].tolist(), stop[at].tolist(), strict=True)]
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            fresh, where = np.unique(np.maximum(hashes[missing], U64(1)), return_index=True)
            self.known.add(fresh, self._learn(spans(missing[where])))
            codes[missing] = self.known.get(hashes[missing])
        length = stop - start
        padded = np.frombuffer(raw + bytes(8), np.uint8)
        other = np.flatnonzero(self.word_size[codes] != length)
        like = np.flatnonzero(self.word_size[codes] == length)
        other = np.concatenate([other, like[~same_spans(padded, start[like], self.bytes, self.word_at[codes[like]], length[like])]])
        if len(other):  # another word has their hash
            codes[other] = self._learn(spans(other))
        size = self.length[codes].astype(np.int64)
        run = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        out = self.ids[np.arange(run[-1]) + np.repeat(self.at[codes] - run[:-1], size)]
        return out, np.diff(run[first])
