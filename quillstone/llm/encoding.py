"""Token ids of whole texts, through a public vocabulary file and the tokenizers library."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from .common import _IS_WORD, SLICE_BYTES, WordHasher, pieces, word_spans

#: Units whose ids a worker remembers before it starts anew; bounds its memory (about 40 bytes each).
CACHE_UNITS = 2_000_000


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# Classes of bytes: 0 white space, 1 letters, 2 digits, 3 symbols, 4 bytes that may join their
# neighbours in other ways (apostrophes, bars of special tokens, most of what isn't ASCII).
_LETTER, _DIGIT, _SYMBOL, _OTHER = 1, 2, 3, 4
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[:128] = _SYMBOL
_CLASS[~_IS_WORD] = 0
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[ord("'"), ord("|")]] = _OTHER
_CLASS[:9] = _CLASS[14:32] = _CLASS[127] = _OTHER


class WordEncoder:
    """Encodes texts unit by unit.

    The vocabulary's normaliser and splitter never join what ASCII white space parts, nor
    letters, digits and ASCII symbols with one another.  So the ids of a text are those of such
    units in turn; the library encodes each distinct unit once.  A word with any byte of which
    this isn't certain is a unit as a whole.  Units of a text are told apart by their first eight
    bytes and length or by 128 bits of hash, and one that shares 64 of them with another is asked
    for by itself.  Long texts are encoded piece by piece, cut at white space.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        suffix = "</w>"
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(suffix)]] = True
        self.hashers = WordHasher(11, fold=False), WordHasher(12, fold=False)
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros(0, np.uint64)
        self.second = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.ids = np.zeros(0, self.dtype)

    def _units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        """The text in lower case, the units' starts and ends, where each text's units begin, which units are odd."""
        starts, ends, _ = word_spans(data, at)
        kind = _CLASS[data]
        # the two-byte letters U+00C0 to U+023F, but for the signs U+00D7 and U+00F7
        # and U+0130, whose lower case is two characters
        lead = np.flatnonzero((data[:-1] >= 0xC3) & (data[:-1] <= 0xC8)) if len(data) else np.zeros(0, np.int64)
        after = data[lead + 1]
        lead = lead[~((data[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7)) | (data[lead] == 0xC4) & (after == 0xB0))]
        kind[lead] = kind[lead + 1] = _LETTER
        odd = np.add.reduceat(kind == _OTHER, starts) > 0 if len(starts) else np.zeros(0, bool)
        whole = np.zeros(len(data) + 1, np.int8)
        whole[starts[odd]] += 1
        whole[ends[odd]] -= 1
        whole = np.cumsum(whole[:-1], dtype=np.int8).astype(bool)
        low = np.where((data >= 65) & (data <= 90) & ~whole, data + 32, data).astype(np.uint8)
        kind[whole] = _OTHER
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        cut[:-1] &= kind > 0
        cut[starts] = True
        begin = np.flatnonzero(cut)
        stop = np.empty_like(begin)
        stop[:-1] = begin[1:]
        if len(begin):
            last = np.searchsorted(starts, begin, "right") - 1
            stop[-1] = ends[-1]
            stop = np.minimum(stop, ends[last])
        return low, begin, stop, np.searchsorted(begin, at), kind[begin] == _OTHER

    def _find(self, key: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = np.searchsorted(self.key, key)
        where[where == len(self.key)] = 0
        if not len(self.key):
            return where, np.zeros(len(key), bool)
        return where, (self.key[where] == key) & (self.second[where] == second)

    def _ask(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], self.dtype), np.fromiter(map(len, ids), np.int64, len(ids))

    def _learn(self, units: list[bytes], odd: np.ndarray, key: np.ndarray, second: np.ndarray) -> None:
        """``odd`` units are asked for one by one; the others end in an id that ends a word, so they go many at once."""
        length = np.zeros(len(units), np.int64)
        ids, length[odd] = self._ask([units[i].decode("utf-8", "replace") for i in np.flatnonzero(odd)])
        first = np.zeros(len(units), np.int64)
        first[odd] = len(self.ids) + np.cumsum(length[odd]) - length[odd]
        plain = [units[i].decode("utf-8", "replace") for i in np.flatnonzero(~odd)]
        more, _ = self._ask([" ".join(plain[i : i + 64]) for i in range(0, len(plain), 64)])
        stop = np.flatnonzero(self.ends_word[more]) + 1
        if len(stop) != len(plain):
            raise ValueError("the vocabulary doesn't mark the ends of words")
        length[~odd] = np.diff(stop, prepend=0)
        first[~odd] = len(self.ids) + len(ids) + stop - length[~odd]
        self.ids = np.concatenate([self.ids, ids, more])
        joined = np.concatenate([self.key, key])
        order = np.argsort(joined, kind="stable")
        self.key = joined[order]
        for name, more in (("second", second), ("first", first), ("length", length)):
            setattr(self, name, np.concatenate([getattr(self, name), more])[order])

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn, and where each text's ids begin (one more for the end)."""
        if len(at) != 2 or len(data) <= 2 * SLICE_BYTES:
            return self._encode(data, at)
        found = [self._encode(data[a:b], np.array([0, b - a]))[0] for a, b in pieces(data, ~_IS_WORD)]
        ids = np.concatenate(found)
        return ids, np.array([0, len(ids)])

    def _encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low, starts, ends, units_at, odd = self._units(data, at)
        if not len(starts):
            return np.zeros(0, self.dtype), np.zeros(len(at), np.int64)
        hashed = self.hashers[0](low, starts, ends)
        seen = pa.array(hashed).dictionary_encode()
        key = seen.dictionary.to_numpy()
        order = np.argsort(key)  # looked up in order, as that is kinder to the processor's caches
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        key, which = key[order], back[seen.indices.to_numpy()]
        example = np.empty(len(key), np.int64)
        example[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        second = self.hashers[1](low, starts[example], ends[example])
        # the first hash holds up to eight bytes of a length without loss; longer units are compared with their example
        size = ends - starts
        long = np.flatnonzero(size > 8)
        other = np.union1d(long[self.hashers[1](low, starts[long], ends[long]) != second[which[long]]], np.flatnonzero(size != size[example][which]))
        if len(self.key) > CACHE_UNITS:
            self._forget()
        where, known = self._find(key, second)
        text = low.tobytes()
        if not known.all():
            new = np.flatnonzero(~known)
            if len(self.key):
                new = new[self.key[where[new]] != key[new]]
            spans = zip(starts[example[new]].tolist(), ends[example[new]].tolist(), strict=True)
            self._learn([text[a:b] for a, b in spans], odd[example[new]], key[new], second[new])
            where, known = self._find(key, second)
        first, length, ids = self.first[where][which], self.length[where][which], self.ids
        clash = np.union1d(other, np.flatnonzero(~known[which])) if len(other) or not known.all() else other
        if len(clash):  # two units of one hash: these are asked for by themselves and not remembered
            more, size = self._ask([text[starts[i] : ends[i]].decode("utf-8", "replace") for i in clash.tolist()])
            length[clash] = size
            first[clash] = len(ids) + np.cumsum(size) - size
            ids = np.concatenate([ids, more])
        ends_at = np.cumsum(length)
        kind = np.int32 if max(len(ids), int(ends_at[-1])) < 1 << 31 else np.int64
        taken = np.repeat((first - (ends_at - length)).astype(kind), length)
        taken += np.arange(len(taken), dtype=kind)
        return ids[taken], np.concatenate([[0], ends_at])[units_at]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
