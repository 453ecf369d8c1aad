"""Entities, tags and co-occurrence from text, by rules."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that open sentences and are no names.
OPENERS = ("The", "A", "An", "This", "That", "These", "Those", "I", "We", "You", "He", "She", "It", "They", "And", "But", "So", "If", "When", "Hello", "Hi", "Hey", "Thanks", "Thank", "Please")
MENTION_CONFIDENCE = 0.3
_ENTITY = "array<struct<name:string,type:string>>"


def wikilinks(text: Column) -> Column:
    """[[Name]] as (Name, wiki) and [[Name|Kind]] as (Name, wiki:Kind)."""
    inner = F.regexp_extract_all(text, F.lit(r"(?s)\[\[(.*?)\]\]"), 1)

    def one(x: Column) -> Column:
        parts = F.split(x, r"\|", 2)
        kind = F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))
        return F.struct(F.trim(F.get(parts, F.lit(0))).alias("name"), F.when(kind == "", F.lit("wiki")).otherwise(F.concat(F.lit("wiki:"), kind)).alias("type"))

    return F.filter(F.transform(inner, one), lambda e: e["name"] != "")


def hashtags(text: Column) -> Column:
    """Tags that start with a letter, where no word character, dot or dash comes before the #."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_.\-])#([A-Za-z][A-Za-z0-9_.\-]*)"), 1))


def capitalised(text: Column) -> Column:
    """Runs of capitalised ASCII words with single spaces between them, as names of kind unknown. Nothing
    follows a run, so it gives nothing back: the repeats are possessive, and a run of any length takes no stack."""
    runs = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9])([A-Z][A-Za-z.']*+(?: [A-Z][A-Za-z.']*+)*+)"), 1)
    names = F.filter(runs, lambda n: (F.char_length(n) >= 2) & ~n.isin(*OPENERS))
    return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit("unknown").alias("type")))


def entities(text: Column) -> Column:
    """Links, then capitalised runs; of one name the first stays."""
    links = wikilinks(text).cast(_ENTITY)
    names = F.array_distinct(F.concat(F.transform(links, lambda e: e["name"]), F.transform(capitalised(text), lambda e: e["name"])))

    def one(s: Column) -> Column:
        def entity(n: Column) -> Column:  # links come first, so a name that has one has the first link's kind
            kind = F.get(F.filter(s["links"], lambda e: e["name"] == n), F.lit(0))["type"]
            return F.struct(n.alias("name"), F.coalesce(kind, F.lit("unknown")).alias("type"))

        return F.transform(s["names"], entity)

    # bound as one variable: in the inner function the patterns would be searched again for each name
    bound = F.array(F.struct(links.alias("links"), names.alias("names")))
    return F.get(F.transform(bound, one), F.lit(0))


@dataclass(frozen=True)
class Extractor:
    """What finds entities (name, type) and tags in a text: functions from a column to a column."""

    entities: Callable[[Column], Column]
    hashtags: Callable[[Column], Column]


#: The rules of this module, and an extractor that finds nothing.
RULES = Extractor(entities, hashtags)
NOTHING = Extractor(lambda text: F.array().cast(_ENTITY), lambda text: F.array().cast("array<string>"))
