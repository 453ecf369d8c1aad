import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestore.errors import ValidationError
from lodestore.functions import extraction, text
from lodestore.operators import retrieval

TEXTS = ["pineapple smoothie recipe", "banana smoothie bowl", "unrelated rust code snippet", "", "Café au lait, naïve résumé", "snake_case and-dashed", "the the the smoothie", "a b a b a b c", "Straße ÀÉÎ", "pine apple", "smooth ride recipes"]
QUERIES = ["pine smooth", "smoothie", "cafe", "snake_case", "the", "a b", '"smoothie bowl"', '"pine" OR banana', "smoothie NOT banana", "(rust OR banana) AND code", "reci*ignored", "and-da", '"a b" c', "resume naive", "zzz", '"a b a"', "straße"]


@pytest.fixture(scope="module")
def golden():
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE t USING fts5(content, tokenize=\"unicode61 remove_diacritics 2 tokenchars '_'\")")
    c.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", list(enumerate(TEXTS, 1)))
    return c


@pytest.fixture(scope="module")
def memory(spark):
    return spark.createDataFrame([(i, f"u{i:02d}", t, "active") for i, t in enumerate(TEXTS, 1)], "id long, uuid string, content string, status string")


def match(query):
    if '"' in query or "(" in query or any(f" {op} " in query for op in ("OR", "AND", "NOT")):
        return query
    return " AND ".join(f'"{t}"*' for t in query.split())


@pytest.mark.parametrize("query", QUERIES)
def test_bm25_equals_fts5(golden, memory, query):
    want = golden.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ? ORDER BY round(bm25(t), 9), rowid", (match(query),)).fetchall()
    found = retrieval.bm25(memory, query, 50).collect()
    assert [(r.id, pytest.approx(r.bm25, abs=1e-9)) for r in sorted(found, key=lambda r: (round(r.bm25, 9), r.id))] == want


def test_keyword_scores_and_status(spark, memory):
    one = retrieval.bm25(memory, "pine smooth", 10).collect()
    assert [(r.id, r.score) for r in one] == [(1, 1.0)]
    assert retrieval.bm25(memory, "  ", 10).count() == 0
    marked = memory.withColumn("status", F.when(F.col("id") == 1, "archived").otherwise("active"))
    n = {s: retrieval.bm25(marked, "smoothie", 10, [s]).count() for s in ("active", "archived")}
    assert n == {"active": 2, "archived": 1} and retrieval.bm25(marked, "smoothie", 10, None).count() == 3
    with pytest.raises(ValidationError):
        retrieval.bm25(marked, "x", 10, [])


@pytest.mark.parametrize("query", ['"open', "(a OR", "a OR OR b", "AND (", "a AND )"])
def test_bad_expressions(query):
    with pytest.raises(ValidationError):
        text.parse_query(query)


def test_strict_terms():
    with pytest.raises(ValidationError):
        text.parse_query("what?", strict=True)
    assert text.parse_query("what?") == text.Phrase(("what",), True)
    assert text.parse_query("") is None and text.parse_query(" \t ") is None


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='ab ()"*ORANDT', max_size=20))
def test_the_parser_ends(query):
    try:
        text.parse_query(query)
    except ValidationError:
        pass


def first(spark, value, expression):
    return spark.createDataFrame([(value,)], "t string").select(expression(F.col("t"))).first()[0]


def test_strip_is_unicode(spark):
    assert first(spark, " \t a b  \n", text.strip) == "a b"


def test_extraction(spark):
    links = [(e.name, e.type) for e in first(spark, "see [[Rust|lang]] and [[Trae]] [[ ]] [[a|b|c]] for details [[open", extraction.wikilinks)]
    assert links == [("Rust", "wiki:lang"), ("Trae", "wiki"), ("a", "wiki:b|c")]
    assert first(spark, "deploy #prod and #k8s-1.30, skip no#match #prod #1x", extraction.hashtags) == ["prod", "k8s-1.30"]
    names = [e.name for e in first(spark, "Alice Smith met Bob Jones at Acme Corp last Tuesday. The end. xYz O'Neil J. R", extraction.entities)]
    assert names == ["Alice Smith", "Bob Jones", "Acme Corp", "Tuesday. The", "O'Neil J. R"]
    both = [(e.name, e.type) for e in first(spark, "Rust and [[Rust|lang]]", extraction.entities)]
    assert both == [("Rust", "wiki:lang")]
    assert first(spark, None, text.tokens) == []
