"""Toxicity of text as it was meant: a noisy channel is undone before scoring.

Words may be disguised by leetspeak (1d10t), spacing (i d i o t, i.d.i.o.t) and repetition
(idiooot). For a run of characters that may be so disguised, a lattice of what each character can
stand for is built, and Viterbi decoding under a character trigram model of labelled text finds the
likeliest reading. Words that have one reading only are themselves, and so are words without any
letter: numbers aren't read as words. Both the written and the
restored word are looked up among weights learned from labelled rows: a lower bound of the log odds
of whole words and of word beginnings of 4 to 6 letters. A calibrated logistic function of the two
highest words' weights and the number of strong ones is the score; weights for calibration come
from the other half of the rows. Copies and most near copies of a text count once and are in one
half, so that words of a much copied text don't pass for toxic ones.

Learned from every labelled text that isn't held out (train): passes over these texts count the
characters' trigrams, the features of toxic texts, the groups of copies that have each of them, and
the texts of each summary; only such counts leave the tasks. Model does the same on lists of texts.
Defined results: null and empty texts have no words. With no toxic rows to learn from all scores
are 0.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice
from math import log
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..deploy import ship
from .labelled import Constant, Logistic, all_training_rows, class_weights, held_out
from .shared import release, small, written

LEAST, STRONG, THRESHOLD = 4, 3.0, 0.5
#: Entries of the caches; full ones are emptied, as otherwise words that come once would fill them for good.
CACHE_WORDS, CACHE_LETTERS, CACHE_READ, CACHES = 150_000, 64, 40_000, 2
HELD, BATCH = 200_000, 500
RIDGE = 0.1

#: What characters of leetspeak stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
#: Costs (negative logs) of the channel: a letter written as leet, a character put between letters, a letter repeated, a mark inside a word that ends a word after all; a character that no word has.
COST_LEET, COST_GAP, COST_REPEAT, COST_SPLIT, UNSEEN = 1.0, 0.7, 0.7, 4.0, 9.0

_EDGES = re.compile(r"^[^\w@$]+|[^\w]+$")
#: Single characters apart by one blank each, or by the same longer run of blanks each.
_SPACED = re.compile(r"(?<!\S)\S(?:(?:[ \t]\S){2,}|([ \t]{2,})\S(?:\1\S)+)(?!\S)")
_GAPS = frozenset(" .-_*~'\t")
#: Words whose lattice has more than one reading: leet, a character twice in a row, marks between others.
_DISGUISED = re.compile(rf"[{re.escape(''.join(LEET))}]|([^.\-_*~'])\1|[^.\-_*~'][.\-_*~']+[^.\-_*~']")
_DOUBLED = re.compile(r"(.)\1")
_ENDS = frozenset(".,;:?")
_RUNS = re.compile(r"((.)\2*)", re.DOTALL)
_MANY = re.escape("".join(LEET) + "".join(sorted(_GAPS)))
#: From a run of several readings to two characters in a row of one reading each, or to the end.
_STRETCH = re.compile(rf"(?:(?:[{_MANY}]|(?P<a>[^{_MANY}])(?P=a)+)(?:(?P<b>[^{_MANY}])(?!(?P=b)))?)+(?:(?P<c>[^{_MANY}])(?!(?P=c)))?")
_LETTER = re.compile(r"[^\W\d_]")


_caches: dict[tuple[str, str], dict] = {}


def kept(key: str, name: str) -> dict:
    """A cache of this process, so that tasks which it runs in turn share what they looked up. The oldest goes."""
    if (key, name) not in _caches:
        while len(_caches) >= CACHES:
            del _caches[next(iter(_caches))]
        _caches[key, name] = {}
    return _caches[key, name]


def put(cache: dict, key: str, value, most: int) -> None:
    if len(cache) >= most:
        cache.clear()
    cache[key] = value


class Cached:
    """Has caches, named by CACHED, that stay behind when it is sent to a task."""

    CACHED: tuple[str, ...] = ()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in self.CACHED}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        for name in self.CACHED:
            setattr(self, name, kept(self.key, name))


def triples(words: Counter) -> Counter:
    """Trigrams of words with two spaces before and one after."""
    out: Counter = Counter()
    for word, n in words.items():
        s = f"  {word} "
        for i in range(2, len(s)):
            out[s[i - 2 : i + 1]] += n
    return out


def triples_of(words: list[str], n: np.ndarray) -> Iterator[tuple[str, int]]:
    """triples() of many words, the i-th n[i] times; a trigram may come more than once."""
    for at in range(0, len(words), CACHE_WORDS // 4):
        part, times = words[at : at + CACHE_WORDS // 4], n[at : at + CACHE_WORDS // 4]
        text = np.frombuffer(("  " + "   ".join(part) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        of = np.repeat(np.arange(len(part)), np.fromiter(map(len, part), np.int64, len(part)) + 3)
        number = np.zeros(0x110000, dtype=np.int64)
        number[text] = 1
        letters = np.flatnonzero(number)
        number[letters] = np.arange(len(letters))
        text, k = number[text], len(letters)
        inside = of[:-2] == of[2:]
        found = ((text[:-2] * k + text[1:-1]) * k + text[2:])[inside]
        times = times[of[:-2][inside]]
        if k**3 > 1 << 22:
            keys, found = np.unique(found, return_inverse=True)
        else:
            keys = np.arange(k**3)
        sums = np.bincount(found, weights=times, minlength=len(keys))
        for i in np.flatnonzero(sums).tolist():
            rest, c = divmod(int(keys[i]), k)
            a, b = divmod(rest, k)
            yield chr(letters[a]) + chr(letters[b]) + chr(letters[c]), int(sums[i])


class CharacterModel(Cached):
    """Trigrams of letters and the space at both ends of words, from counts of words."""

    CACHED = ("costs", "stretches")

    def __init__(self, words: Counter):
        self._count(triples(words))

    @classmethod
    def of(cls, found: dict[str, int]) -> CharacterModel:
        """From counts of trigrams."""
        self = cls.__new__(cls)
        self._count(found)
        return self

    def _count(self, found: dict[str, int]) -> None:
        pairs, ones, contexts2, contexts1 = Counter(), Counter(), Counter(), Counter()
        for t, n in found.items():
            pairs[t[1:]] += n
            ones[t[2]] += n
            contexts2[t[:2]] += n
            contexts1[t[1]] += n
        total = max(1, sum(ones.values()))
        self.one = {c: n / total for c, n in ones.items()}
        self.two = {t: n / contexts1[t[0]] for t, n in pairs.items()}
        self.three = {t: n / contexts2[t[:2]] for t, n in found.items()}
        self.key, self.costs, self.stretches = uuid.uuid4().hex, {}, {}  # those that were asked for

    def cost(self, before: str, c: str) -> float:
        """-log P(c | the last two characters), interpolated."""
        key = before + c
        if (found := self.costs.get(key)) is None:
            p = 0.7 * self.three.get(key, 0.0) + 0.25 * self.two.get(before[1] + c, 0.0) + 0.05 * self.one.get(c, 0.0)
            found = min(UNSEEN, -log(p)) if p > 0 else UNSEEN
            put(self.costs, key, found, CACHE_READ)
        return found


@lru_cache(maxsize=1 << 16)
def _reads(c: str, n: int) -> list[tuple[str, float]]:
    """Readings of a run of n characters c; all runs of 4 or more have the same ones."""
    if c in _GAPS:
        return [("", COST_GAP), (" ", 0.0 if c in " \t" else COST_SPLIT)]
    reads = [(x, COST_LEET) for x in LEET.get(c, "")] + [(c, 0.0)]
    if n == 1:
        return reads
    return [(x * k, cost + (COST_REPEAT if k < n else 0.0)) for x, cost in reads for k in {1, 2, *((n,) if n < 4 else ())}]


def lattice(text: str) -> list[list[tuple[str, float]]]:
    """For each run of a character in turn: what it can stand for, and the channel's cost."""
    return [_reads(c, min(4, len(run))) for run, c in _RUNS.findall(text)]


def _viterbi(text: str, before: str, end: str, model: CharacterModel) -> str:
    """The likeliest reading after the characters before, by Viterbi over the last two; end follows."""
    states: dict[str, tuple[float, tuple]] = {before: (0.0, ())}
    known = model.costs.get
    for reads in lattice(text):
        after: dict[str, tuple[float, tuple]] = {}
        for last, (cost, path) in states.items():
            for read, own in reads:
                sum_, at = cost + own, last
                for c in read:
                    step = known(at + c)
                    sum_ += model.cost(at, c) if step is None else step
                    at = at[1] + c
                if at not in after or sum_ < after[at][0]:
                    after[at] = (sum_, (path, read))
        states = after
    _, _, path = min(((cost + (model.cost(last, end) if end else 0.0), last, path) for last, (cost, path) in states.items()), key=lambda x: x[:2])
    parts = []
    while path:
        path, read = path
        parts.append(read)
    return "".join(reversed(parts))


def decode(text: str, model: CharacterModel) -> str:
    """The likeliest reading, by Viterbi over the last two characters. Where two characters in a row have one
    reading each, one state is left: what follows doesn't change the best path up to there. So each
    stretch between such places is decoded by itself, and words share those that were decoded before."""
    parts, upto, known = [], 0, model.stretches
    for m in _STRETCH.finditer(text):
        a, b = m.span()
        end = " " if b == len(text) else ""
        before = text[a - 2 : a] if a > 1 else ("  " + text[:a])[-2:]
        key = (before + m[0], end)
        if (found := known.get(key)) is None:
            found = _viterbi(m[0], before, end, model)
            if b - a <= CACHE_LETTERS:
                put(known, key, found, CACHE_READ)
        parts += (text[upto:a], found)
        upto = b
    return ("".join(parts) + text[upto:]).strip()


def _forms(word: str) -> set[str]:
    out = {word + "$"}
    out.update(word[:k] for k in (4, 5, 6) if len(word) > k)
    return out


def _bare(word: str) -> str:
    """A written word without marks at the ends."""
    return word if word.isalpha() else _EDGES.sub("", word)


def _bare_word(word: str) -> str | None:
    """The same, if it is all letters."""
    return w if (w := _bare(word)).isalpha() else None


def spelt(text: str, words: list[str]) -> set[str]:
    """Runs of single characters between spaces; those of one character only are junk. words: text.split()."""
    try:
        if b"\1\1\1" not in bytes(map(len, words)):
            return set()
    except ValueError:  # a word of over 255 characters
        pass
    return {m[0] for m in _SPACED.finditer(text) if len(set(m[0]) - {" ", "\t"}) > 1}


class Reader:
    """Words of texts as features."""

    def __init__(self, model: CharacterModel | None):
        self.model = model

    def readings(self, word: str) -> list[str]:
        """A written word (lower case, no white space) and what it is read as, without marks at the ends."""
        if word.isalpha():
            bare, several = word, _DOUBLED.search(word)
        else:
            bare, several = _EDGES.sub("", word), _DISGUISED.search(word) and _LETTER.search(word)
        out = [bare] if bare else []
        if several and self.model:
            out += [x for read in decode(word, self.model).split(" ") if (x := _bare(read)) and x != bare]
        return out

    def forms(self, word: str) -> set[str]:
        """Features of one written word."""
        return set().union(*map(_forms, self.readings(word)))

    def words(self, runs: Iterable[str]) -> set[str]:
        """Words spelt by runs of single characters."""
        return {read for run in runs for read in decode(run, self.model).split(" ") if len(read) > 2} if self.model else set()

    def spaced(self, text: str) -> set[str]:
        """Words spelt with single characters between spaces."""
        return self.words(spelt(text, text.split()))


class Words(dict):
    """Numbers of words, in the order in which they came."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' words, and how many each text has."""
        n = np.fromiter(map(len, texts), np.int64, len(texts))
        return np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, int(n.sum())), n

    def since(self, n: int) -> list[str]:
        return list(islice(self, n, None))


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by sorting (np.unique hashes, which is slower here)."""
    x = np.sort(x)
    return x[np.flatnonzero(np.diff(x, prepend=x[:1] - 1))]


def collapsed(words: list[str]) -> list[str]:
    """Words (not empty, without line ends) in which a character comes but once in a row."""
    text = np.frombuffer("\n".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return text[np.diff(text, prepend=0x110000) != 0].tobytes().decode("utf-32-le", "surrogatepass").split("\n") if words else []


def _code(word: str) -> int:
    data = word.encode()
    return crc32(data) + (len(data) << 32)


def copy_keys(codes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """copy_key of texts by the codes of all their words (unsigned) and how many each has."""
    ends = np.cumsum(n)
    left = np.repeat(ends, n) - np.arange(len(codes))  # words to the text's end; none follow that
    after = np.concatenate([codes, np.zeros(2, dtype=np.uint64)])
    sums = codes * np.uint64(0x9E3779B97F4A7C15) + np.where(left > 1, after[1:-1], 0) * np.uint64(0xC2B2AE3D27D4EB4F) + np.where(left > 2, after[2:], 0) * np.uint64(0x165667B19E3779F9)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        sums = (sums ^ (sums >> np.uint64(shift))) * np.uint64(times)
    sums[(left < 3) & (left < np.repeat(n, n))] = np.uint64(2**64 - 1)
    out = np.zeros(len(n), dtype=np.uint64)
    if len(codes):
        out[n > 0] = np.minimum.reduceat(sums, (ends - n)[n > 0])
    return out.view(np.int64)


def copy_key(text: str) -> int:
    """Equal for texts of the same words, and mostly for near copies: the least 64-bit hash of three words in a row."""
    words = text.lower().split()
    return int(copy_keys(np.array(list(map(_code, words)), dtype=np.uint64), np.array([len(words)]))[0])


def log_odds(toxic: np.ndarray, clean: np.ndarray, n: tuple[int, int]) -> np.ndarray:
    """The lower bound of each feature's log odds from its numbers of toxic and clean texts, where it is
    clearly positive, else 0."""
    odds = np.log(np.maximum(toxic - np.sqrt(toxic), 1e-9) / max(1, n[1])) - np.log((clean + np.sqrt(clean) + 1) / max(1, n[0]))
    return np.where((toxic >= LEAST) & (odds > 1.5), odds, 0.0)


def summary(words) -> tuple[float, float, float]:
    """The two highest weights of words, and how many are strong (as a logarithm)."""
    top = sorted(words, reverse=True)
    return (top[0] if top else 0.0, top[1] if len(top) > 1 else 0.0, np.log1p(sum(w > STRONG for w in top)))


def best(readings: list[str], weights: dict[str, float]) -> float:
    """The highest weight of a word's features."""
    get, found = weights.get, 0.0
    for bare in readings:
        found = max(found, get(bare + "$", 0.0))
        for k in range(4, min(7, len(bare))):
            found = max(found, get(bare[:k], 0.0))
    return found


class Weighed:
    """Texts by the weights of their words. Words are numbered, and each is weighed when it comes first."""

    def __init__(self, reader: Reader, weights: Iterable[dict[str, float]]):
        self.reader, self.weights = reader, list(weights)
        #: First letters of all features: the last $ of one may be the end of a word or a character of it.
        self.heads = {x[:4] for of in self.weights for f in of for x in (f, f[:-1])}
        self.short = set(collapsed([x for x in self.heads if x]))
        self.lengths = sorted(set(map(len, self.short)))
        self._empty()

    def _empty(self) -> None:
        self.words, self.found = Words(), np.zeros((len(self.weights), 0))

    def _weigh(self, words: list[str]) -> np.ndarray:
        """Of letters (and one mark) only letters in a row are read as fewer or more of the same. So words that
        begin otherwise than all features, when a letter comes but once in a row, have no weight."""
        out = np.zeros((len(self.weights), len(words)))
        heads, short, lengths = self.heads, self.short, self.lengths
        for i, (word, plain) in enumerate(zip(words, collapsed(words))):
            if (word.isalpha() or word[-1] in _ENDS and word[:-1].isalpha()) and not any([plain[:k] in short for k in lengths]):
                continue
            if readings := [x for x in self.reader.readings(word) if x[:4] in heads]:
                out[:, i] = [best(readings, of) for of in self.weights]
        return out

    def summaries(self, texts: list[list[str]], by: np.ndarray) -> np.ndarray:
        """summary() of each text's distinct words; by: by which of the weights."""
        if len(self.words) > CACHE_WORDS:
            self._empty()
        ids, n = self.words.of(texts)
        self.found = np.concatenate([self.found, self._weigh(self.words.since(self.found.shape[1]))], axis=1)
        text = np.repeat(np.arange(len(texts)), n)
        some = np.flatnonzero(self.found.any(axis=0)[ids])
        pairs = distinct(text[some] * max(1, len(self.words)) + ids[some])
        out = np.zeros((len(texts), 3))
        text, ids = np.divmod(pairs, max(1, len(self.words)))
        which, at = np.unique(text, return_index=True)
        for i, own in zip(which.tolist(), np.split(ids, at[1:])):
            out[i] = summary([w for w in self.found[by[i], own].tolist() if w])
        return out


class Model:
    """Training keeps numbers of features only: those that LEAST toxic texts have."""

    def __init__(self, texts: list[list[str]], totals: list[int]):
        self._set(Reader(None), None, None)
        if not texts[0] or not texts[1]:
            self.calibrated = Constant(1.0 if texts[1] else 0.0)
            return
        counted: Counter = Counter()
        for text in (t for c in texts for t in c):
            counted.update({w for x in text.lower().split() if (w := _bare_word(x))})
        self.reader = Reader(CharacterModel(counted))
        del counted
        seen: Counter = Counter()
        for text in texts[1]:
            seen.update(set().union(*map(self.reader.forms, self._words(text))))
        number = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= LEAST))}
        del seen
        docs, y, copy = [], [], []
        for k, c in enumerate(texts):
            for text in c:
                words = [w for x in sorted(self._words(text)) if (w := [number[f] for f in self.reader.forms(x) if f in number])]
                docs.append((np.cumsum([0, *map(len, words)])[:-1], np.array([f for w in words for f in w], dtype=np.int32)))
                y.append(k)
                copy.append(copy_key(text))
        y, copy = np.array(y), np.array(copy)
        half = copy & 1  # copies are in one half

        def learn(rows: np.ndarray) -> np.ndarray:
            counts, n = np.zeros((2, len(number))), []
            for k in (0, 1):
                groups: dict[int, list[np.ndarray]] = {}
                for i in np.flatnonzero(rows & (y == k)):
                    groups.setdefault(int(copy[i]), []).append(docs[i][1])
                for held in groups.values():
                    counts[k, np.unique(np.concatenate(held))] += 1
                n.append(len(groups))
            return log_odds(counts[1], counts[0], (n[0], n[1]))

        x = np.zeros((len(docs), 3))
        for h in (0, 1):
            weights = learn(half != h)
            for i in np.flatnonzero(half == h):
                starts, features = docs[i]
                x[i] = summary([w for w in np.maximum.reduceat(weights[features], starts).tolist() if w] if len(features) else [])
        final = learn(np.full(len(docs), True))
        self.weights = {f: float(final[i]) for f, i in number.items() if final[i]}
        self.calibrated = Logistic(x, y, class_weights(y, totals), ridge=RIDGE)

    @classmethod
    def of(cls, reader: Reader, weights: dict[str, float] | None, calibrated) -> Model:
        self = cls.__new__(cls)
        self._set(reader, weights, calibrated)
        return self

    def _set(self, reader: Reader, weights: dict[str, float] | None, calibrated) -> None:
        self.reader, self.weights, self.calibrated = reader, weights, calibrated

    def _words(self, text: str) -> set[str]:
        return set(self._all_words(text))

    def _all_words(self, text: str) -> list[str]:
        text = text.lower()
        words = text.split()
        return words + list(self.reader.words(runs)) if (runs := spelt(text, words)) else words

    def scores(self, batches: Iterable) -> Iterator[np.ndarray]:
        """The scores of batches of texts."""
        weighed = Weighed(self.reader, [self.weights or {}])
        for texts in batches:
            out = [np.zeros((0, 3))]
            for at in range(0, len(texts), BATCH):
                part = [self._all_words(text or "") if self.weights else [] for text in texts[at : at + BATCH]]
                out.append(weighed.summaries(part, np.zeros(len(part), dtype=np.int64)))
            yield self.calibrated(np.concatenate(out))

    def score(self, texts) -> np.ndarray:
        return next(self.scores([texts]))


def score_udf(model: Model):
    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from map(pd.Series, model.scores(b.tolist() for b in batches))
        release()

    return score


PREPARED = pa.schema([("y", pa.int32()), ("copy", pa.int64()), ("words", pa.string()), ("spelt", pa.list_(pa.string())), ("gram", pa.string()), ("n", pa.int64())])
COUNTED = pa.schema([("y", pa.int32()), ("half", pa.int32()), ("feature", pa.int32()), ("n", pa.int64()), ("copy", pa.int64()), ("features", pa.list_(pa.int32()))])
FORMS = pa.schema([("form", pa.string()), ("n", pa.int64())])
SUMMED = pa.schema([("y", pa.int32()), ("a", pa.float64()), ("b", pa.float64()), ("c", pa.float64()), ("n", pa.int64())])


def _rows(schema: pa.Schema, rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Batches of at most BATCH rows; rows may be short: the rest is null."""
    rows = iter(rows)
    while part := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] if i < len(r) else None for r in part], f.type) for i, f in enumerate(schema)], schema=schema)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[list[list]]:
    """The columns of at most BATCH rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            yield [c.to_pylist() for c in batch.slice(at, BATCH).columns]


def _prepare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text y, the copy key, its distinct words and spelt runs; and counts of trigrams."""
    index, names, codes, bare, texts_with = Words(), [], np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def grams() -> Iterator[pa.RecordBatch]:
        have = np.flatnonzero(texts_with)
        yield from _rows(PREPARED, ((None, None, None, None, t, n) for t, n in triples_of([names[i] for i in have.tolist()], texts_with[have])))

    for y, texts in _slices(batches):
        if len(index) > CACHE_WORDS:
            yield from grams()
            index, names, codes, bare, texts_with = Words(), [], codes[:0], bare[:0], texts_with[:0]
        texts = [text.lower() for text in texts]
        words = [text.split() for text in texts]
        ids, n = index.of(words)
        letters = {w: b for w in index.since(len(names)) if not w.isalpha() and (b := _bare_word(w))}
        for b in letters.values():
            index[b]  # gets a number
        new = index.since(len(names))
        codes = np.concatenate([codes, np.array(list(map(_code, new)), dtype=np.uint64)])
        bare = np.concatenate([bare, np.array([i if w.isalpha() else index[letters[w]] if w in letters else -1 for i, w in enumerate(new, len(names))], dtype=np.int64)])
        texts_with = np.concatenate([texts_with, np.zeros(len(new), dtype=np.int64)])
        names += new
        copies = copy_keys(codes[ids], n)
        text, own = np.divmod(distinct(np.repeat(np.arange(len(texts)), n) * max(1, len(names)) + ids), max(1, len(names)))
        pairs = (text * max(1, len(names)) + bare[own])[bare[own] >= 0]
        texts_with += np.bincount(distinct(pairs) % max(1, len(names)), minlength=len(names))
        cuts, own = np.searchsorted(text, np.arange(len(texts) + 1)).tolist(), list(map(names.__getitem__, own.tolist()))
        yield from _rows(PREPARED, ((y[i], copies[i], " ".join(own[cuts[i] : cuts[i + 1]]), list(spelt(texts[i], words[i]))) for i in range(len(texts))))
    yield from grams()
    release()


def _texts(batches: Iterable[pa.RecordBatch], reader: Reader) -> Iterator[tuple]:
    """Of some prepared texts at a time the columns before words and spelt, and the words of each."""
    for *first, words, runs in _slices(batches):
        yield *first, [ws.split() + list(reader.words(rs)) if rs else ws.split() for ws, rs in zip(words, runs)]


def _count_forms(batches: Iterable[pa.RecordBatch], reader: Reader) -> Iterator[pa.RecordBatch]:
    """In how many texts each feature is, in parts."""
    seen, forms = Counter(), {}
    for (texts,) in _texts(batches, reader):
        for words in texts:
            found: set[str] = set()
            for w in words:
                if (of := forms.get(w)) is None:
                    of = reader.forms(w)
                    put(forms, w, of, CACHE_READ)
                found |= of
            seen.update(found)
        if len(seen) >= HELD:
            yield from _rows(FORMS, seen.items())
            seen.clear()
    yield from _rows(FORMS, seen.items())
    release()


def _numbers(readings: list[str], number: dict[str, int]) -> list[int]:
    """The numbers of a word's features; one may come twice. Where a beginning has none, longer ones have none:
    number has the features of at least so many texts."""
    out, get = [], number.get
    for bare in readings:
        if (of := get(bare + "$")) is not None:
            out.append(of)
        for k in range(4, min(7, len(bare))):
            if (of := get(bare[:k])) is None:
                break
            out.append(of)
    return out


def _count_groups(batches: Iterable[pa.RecordBatch], reader: Reader, number: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Of texts without copies, how many of each class and half have each feature; of others (many), the
    features of each group, which may come more than once."""
    size = max(1, len(number))
    counts = np.zeros(4 * size, dtype=np.int64)
    groups: dict[tuple[int, int], set[int]] = {}
    held = 0
    index, start, many_of, flat = Words(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of_groups() -> Iterator[pa.RecordBatch]:
        return _rows(COUNTED, ((y, copy & 1, None, None, copy, list(features)) for (y, copy), features in groups.items()))

    for y, copy, many, words in _texts(batches, reader):
        if len(index) > CACHE_WORDS:
            index, start, many_of, flat = Words(), start[:0], many_of[:0], flat[:0]
        ids, n = index.of(words)
        new = [_numbers(reader.readings(w), number) for w in index.since(len(start))]
        n_new = np.fromiter(map(len, new), np.int64, len(new))
        start = np.concatenate([start, len(flat) + np.cumsum(n_new) - n_new])
        many_of = np.concatenate([many_of, n_new])
        flat = np.concatenate([flat, np.fromiter(chain.from_iterable(new), np.int64, int(n_new.sum()))])
        each = many_of[ids]
        at = np.arange(int(each.sum())) + np.repeat(start[ids] - (np.cumsum(each) - each), each)
        text, features = np.divmod(distinct(np.repeat(np.repeat(np.arange(len(y)), n), each) * size + flat[at]), size)
        kind = np.array([2 * a + (b & 1) for a, b in zip(y, copy)], dtype=np.int64)
        single = ~np.array(many, dtype=bool)[text]
        np.add.at(counts, kind[text[single]] * size + features[single], 1)
        cuts = np.searchsorted(text, np.arange(len(y) + 1))
        for i in np.flatnonzero(many).tolist():
            group = groups.setdefault((y[i], copy[i]), set())
            held -= len(group)
            group.update(features[cuts[i] : cuts[i + 1]].tolist())
            held += len(group)
        if held >= HELD:
            yield from of_groups()
            groups.clear()
            held = 0
    yield from of_groups()
    yield from _rows(COUNTED, ((k // size // 2, k // size % 2, k % size, int(counts[k])) for k in np.flatnonzero(counts).tolist()))
    release()


def _summarise(batches: Iterable[pa.RecordBatch], reader: Reader, weights: tuple[dict[str, float], dict[str, float]]) -> Iterator[pa.RecordBatch]:
    """How many texts of each class have which summary, by the weights learned from the other half."""
    seen, weighed = Counter(), Weighed(reader, weights)
    for y, copy, words in _texts(batches, reader):
        found = weighed.summaries(words, np.array([1 - (c & 1) for c in copy], dtype=np.int64))
        seen.update((k, *x) for k, x in zip(y, found.tolist()))
        if len(seen) >= HELD:
            yield from _rows(SUMMED, ((*x, n) for x, n in seen.items()))
            seen.clear()
    yield from _rows(SUMMED, ((*x, n) for x, n in seen.items()))
    release()


def _weights(found: list, forms: list[str], toxic: list[str], clean: list[str], n: tuple[int, int]) -> dict[str, float]:
    """Of rows of counts, the weights of features by the sums of some columns."""
    odds = log_odds(*(np.array([sum(r[c] for c in cs) for r in found], dtype=float) for cs in (toxic, clean)), n)
    return {forms[r["feature"]]: float(w) for r, w in zip(found, odds) if w}


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model of every labelled text that isn't held out. To the driver come the trigrams of words, the
    features of at least LEAST toxic texts and counts of those that may have a weight; no text does."""
    ship(docs.sparkSession)
    rows = all_training_rows(docs, labels, "toxic")
    made = written(rows.mapInArrow(_prepare, "y int, copy long, words string, spelt array<string>, gram string, n long"), "toxicity-texts")
    texts = made.where("y IS NOT NULL")
    groups = written(texts.groupBy("y", "copy").agg(F.count("*").alias("texts")), "toxicity-groups")
    n, many, copied = np.zeros((2, 2), dtype=int), 0, np.zeros(2, dtype=int)
    for y, half, own, found in groups.groupBy("y", F.expr("int(copy & 1)")).agg(F.count("*"), F.count_if(F.col("texts") > 1)).collect():
        n[y, half] = own
        many += found
        copied[half] += y * found
    if not n.sum(axis=1).all():
        return Model.of(Reader(None), None, Constant(1.0 if n[1].any() else 0.0))
    reader = Reader(CharacterModel.of(dict(made.where("gram IS NOT NULL").groupBy("gram").agg(F.sum("n")).collect())))

    seen = texts.where("y = 1").select("words", "spelt").mapInArrow(lambda batches: _count_forms(batches, reader), "form string, n long")
    forms = sorted(r.form for r in seen.groupBy("form").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("form").collect())
    number = {f: i for i, f in enumerate(forms)}

    copies = groups.where("texts > 1").select(F.col("y").alias("_y"), F.col("copy").alias("_copy"), F.lit(True).alias("many"))
    flagged = texts.join(small(copies, many, 64), F.expr("y = _y AND copy = _copy"), "left").select("y", "copy", F.expr("many IS NOT NULL").alias("many"), "words", "spelt")
    counted = written(flagged.mapInArrow(lambda batches: _count_groups(batches, reader, number), "y int, half int, feature int, n long, copy long, features array<int>"), "toxicity-counts")
    cells = [(y, h) for y in (0, 1) for h in (0, 1)]
    sums = [F.sum(F.when((F.col("y") == y) & (F.col("half") == h), F.col("n")).otherwise(0)).alias(f"n{y}{h}") for y, h in cells]
    fits = [(["n10"], ["n00"], (n[0, 0], n[1, 0])), (["n11"], ["n01"], (n[0, 1], n[1, 1])), (["n10", "n11"], ["n00", "n01"], (n[0].sum(), n[1].sum()))]

    def may_weigh(more: np.ndarray) -> str:
        """Holds where a feature may have a weight, if up to more toxic groups of each half are added: what
        log_odds gives one is more than 4 times as frequent in toxic groups (e ** 1.5 is 4.48)."""
        return " OR ".join(f"({' + '.join(t)} + {sum(int(more[int(c[2])]) for c in t)}) * {float(of[0])}D > 4 * ({' + '.join(c)}) * {float(of[1])}D" for t, c, of in fits)

    #: Features that the texts without copies show to have no weight aren't looked for in groups of copies.
    single = counted.where("feature IS NOT NULL").select("feature", "y", "half", "n")
    few = single.groupBy("feature").agg(*sums).where(f"NOT ({may_weigh(copied)})").select(F.col("feature").alias("_feature"))
    of_groups = counted.where("features IS NOT NULL").select(F.explode("features").alias("feature"), "y", "half", "copy")
    of_groups = of_groups.join(small(few, len(forms), 32), F.col("feature") == F.col("_feature"), "left_anti").distinct().select("feature", "y", "half", F.lit(1).cast("long").alias("n"))
    found = single.unionByName(of_groups).groupBy("feature").agg(*sums).where(may_weigh(np.zeros(2))).collect()
    first, second, final = (_weights(found, forms, *fit) for fit in fits)

    summed = texts.select("y", "copy", "words", "spelt").mapInArrow(lambda batches: _summarise(batches, reader, (first, second)), "y int, a double, b double, c double, n long")
    summed = written(summed.groupBy("y", "a", "b", "c").agg(F.sum("n").alias("n")), "toxicity-summaries")
    return Model.of(reader, final, Logistic.of(summed, ["a", "b", "c"], ridge=RIDGE))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    score = score_udf(train(docs, labels))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), score(F.col(f"`{text_col}`")).alias("score"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept_rows(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under the threshold."""
    score = score_udf(train(train_docs, labels))
    return docs.where(score(F.col(f"`{text_col}`")) < THRESHOLD)
