"""Whole texts to token ids with the tokenizers library, and Arrow helpers."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np

#: Texts in which two runs of white space meet around a space are encoded as they are.
_MEETING = re.compile(r"\s \s")
_MARKS = ".,;:!?"
_EDGE = re.compile(r"\A\s|\s\Z")


class Encoder:
    """A byte-level BPE tokenizer file. Its pre-tokenizer always starts a new part at a single
    space between other characters, so a text's ids are those of its first word and of each
    ' word' after it. Only words that aren't in a bounded cache go to the library, many in one
    string, which is cut again at the ids whose bytes start with a space (one for each word). Words
    of letters only, or letters and one mark, are one or two parts to the pre-tokenizer; they go to
    the library's BPE model directly. The ids equal those of encoding the whole text; tests hold them against that.

    The strings of special tokens in a text become those tokens, as the library does by default;
    with ordinary=True they are encoded like other text."""

    def __init__(self, path: str, cache_words: int = 300_000, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = 1 + max(vocabulary.values())
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.starts = np.zeros(self.size, dtype=bool)
        self.starts[[i for w, i in vocabulary.items() if w.startswith("Ġ")]] = True
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (ordinary and t.special)]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.model, self.code = self.tokenizer.model, "H" if self.dtype.itemsize == 2 else "I"
        self.marks = {c: self.whole(c).tobytes() for c in _MARKS}
        # the byte-level alphabet: printable Latin-1 bytes are themselves, the others follow from U+0100 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.shown = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype)

    def _letters(self, word: str) -> bytes:
        """The ids of a space and a word of letters."""
        shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.shown)
        return array(self.code, [t.id for t in self.model.tokenize("Ġ" + shown)]).tobytes()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        found, rest = {}, []
        for w in words:
            if w.isalpha():
                found[w] = self._letters(w)
            elif w[-1:] in self.marks and w[:-1].isalpha():
                found[w] = (self.cache.get(w[:-1]) or self._letters(w[:-1])) + self.marks[w[-1]]
            elif not w or _EDGE.search(w):
                found[w] = self.whole(f" {w}").tobytes()
            else:
                rest.append(w)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            fast = self.tokenizer.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)  # without offsets
            ids = np.array(fast[0].ids, dtype=self.dtype)
            cuts = np.flatnonzero(self.starts[ids])
            if len(cuts) != len(part):
                raise ValueError("the tokenizer doesn't start a word at each space")
            data, size = ids.tobytes(), self.dtype.itemsize
            ends = [*(cuts[1:] * size).tolist(), len(data)]
            found.update(zip(part, (data[a:b] for a, b in zip((cuts * size).tolist(), ends))))
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, packed as self.dtype; null: none."""
        split = [None if not t or _MEETING.search(t) or (self.added and self.added.search(t)) else t.split(" ") for t in texts]
        get = self.cache.get
        found = [None if words is None else list(map(get, words[1:])) for words in split]
        open_ = [i for i, x in enumerate(found) if x and None in x]
        if open_:
            new = self._learn({w for i in open_ for w, x in zip(split[i][1:], found[i]) if x is None})
            for i in open_:
                found[i] = [new[w] if x is None else x for w, x in zip(split[i][1:], found[i])]
            if len(self.cache) < self.cache_words:
                self.cache.update(new)
        out = []
        for text, words, ids in zip(texts, split, found):
            if not text:
                out.append(b"")
            elif words is None:
                out.append(self.whole(text).tobytes())
            else:
                out.append((self.whole(words[0]).tobytes() if words[0] else b"") + b"".join(ids))
        return out


@lru_cache(maxsize=4)
def encoder(path: str, ordinary: bool = False) -> Encoder:
    """One for each file and Python worker."""
    return Encoder(path, ordinary=ordinary)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(batch, most: int = 256):
    """Parts of an Arrow batch, so that Python objects of few texts exist at a time."""
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)
