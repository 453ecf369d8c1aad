"""Text: trimming, hashing, tokens, and keyword queries."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ValidationError


def strip(c: Column) -> Column:
    """Without white space, as Unicode defines it, at both ends."""
    return F.regexp_replace(c, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def _accents() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the letters they are made of."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)])]
    pairs = [(a, b) for a, b in pairs if a != b and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(c: Column) -> Column:
    """Lower case, without accents. Texts of ASCII only skip the table."""
    low = F.lower(c)
    return F.when(F.octet_length(c) == F.char_length(c), low).otherwise(F.translate(low, *_accents()))


def tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores; null: none."""
    return F.regexp_extract_all(folded(F.coalesce(c, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def fold(text: str) -> str:
    """folded() of a query's word, on the driver."""
    a, b = _accents()
    return text.lower().translate(str.maketrans(a, b))


def snippet(c: Column, n: int = 90) -> Column:
    return F.substring(c, 1, n)


@dataclass(frozen=True)
class Phrase:
    """Words that follow each other; the last is a beginning of a word if prefix."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Op:
    kind: str  # AND, OR, NOT
    left: object
    right: object


_WORD = re.compile(r"[^\W]+", re.UNICODE)
_RAW = re.compile(r'\s*(?:(?P<quoted>"(?:[^"]|"")*")|(?P<mark>[()*])|(?P<word>[^\s()"*]+))')


def _words(text: str) -> tuple[str, ...]:
    return tuple(_WORD.findall(fold(text)))


def parse_query(query: str, strict: bool = False):
    """A keyword query as a tree of Phrase and Op, or None if it has no terms. Plain words are all
    required, each as a beginning. Quotes, parentheses and AND, OR, NOT make it an expression. A word
    with punctuation is a phrase of its parts; strict raises instead where the mark isn't one of
    - + ^ : * or a quote."""
    text = query.strip()
    if not text:
        return None
    if '"' in text or "(" in text or any(f" {op} " in text for op in ("OR", "AND", "NOT")):
        return _Parser(text).whole()
    tree = None
    for term in text.split():
        if strict and re.search(r"[^\w\-+^:*\")(]", term):
            raise ValidationError(f"syntax error in keyword query near {term!r}")
        phrase = Phrase(_words(term), True)
        tree = phrase if tree is None else Op("AND", tree, phrase)
    return tree


class _Parser:
    """expression: term (OR term)*; term: factor ((AND | NOT | nothing) factor)*."""

    def __init__(self, text: str):
        self.items, at = [], 0
        while at < len(text.rstrip()):
            m = _RAW.match(text, at)
            if not m:
                raise ValidationError(f"syntax error in keyword query near {text[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.items[self.at] if self.at < len(self.items) else (None, None)

    def take(self):
        item = self.peek()
        self.at += 1
        return item

    def whole(self):
        tree = self.either()
        if self.peek()[0]:
            raise ValidationError(f"syntax error in keyword query near {self.peek()[1]!r}")
        return tree

    def either(self):
        tree = self.both()
        while self.peek() == ("word", "OR"):
            self.take()
            tree = Op("OR", tree, self.both())
        return tree

    def both(self):
        tree = self.one()
        while True:
            kind, value = self.peek()
            if kind is None or (kind, value) in (("word", "OR"), ("mark", ")")):
                return tree
            op = "AND"
            if kind == "word" and value in ("AND", "NOT"):
                op = self.take()[1]
            tree = Op(op, tree, self.one())

    def one(self):
        kind, value = self.take()
        if (kind, value) == ("mark", "("):
            tree = self.either()
            if self.take() != ("mark", ")"):
                raise ValidationError("a parenthesis isn't closed")
            return tree
        if kind not in ("quoted", "word") or value in ("AND", "OR", "NOT"):
            raise ValidationError(f"syntax error in keyword query near {value!r}")
        words = _words(value)
        prefix = self.peek() == ("mark", "*")
        if prefix:
            self.take()
        return Phrase(words, prefix)


def phrases(tree) -> list[Phrase]:
    if tree is None:
        return []
    return [tree] if isinstance(tree, Phrase) else [*phrases(tree.left), *phrases(tree.right)]


_TOKEN = r"[\p{L}\p{N}_]"


def length(folded_text: Column) -> Column:
    """The number of tokens of a folded text."""
    return F.regexp_count(folded_text, F.lit(_TOKEN + "+"))


def count(folded_text: Column, phrase: Phrase) -> Column:
    """How often a phrase occurs among a folded text's tokens; occurrences may overlap. Counted in the
    text itself, so that no array of tokens is made."""
    if not phrase.words:
        return F.lit(0)
    gap = _TOKEN.replace("[", "[^") + "+"
    inside = gap.join(rf"\Q{w}\E" for w in phrase.words) + ("" if phrase.prefix else f"(?!{_TOKEN})")
    return F.regexp_count(folded_text, F.lit(f"(?<!{_TOKEN})" + (inside if len(phrase.words) == 1 else f"(?={inside})")))


def merge_tags(first: Column, second: Column) -> Column:
    """Both lists, trimmed, without blanks, each name once, first come first."""
    return F.array_distinct(F.filter(F.transform(F.concat(first, second), strip), lambda t: t != ""))
