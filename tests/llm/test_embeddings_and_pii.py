import math
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestore.llm import embeddings, pii

VECTORS = "vec_id long, embedding array<float>, label int, key string, n string"
NAN, INF = float("nan"), float("inf")


def vectors():
    rng = np.random.default_rng(2)
    out, base = [], rng.normal(size=(30, 16))
    for i in range(500):
        v = base[i % 30] + (rng.normal(size=16) * 0.1 if i % 3 else 0)
        out.append((i * 2 + 1, [float(np.float32(x)) for x in v], i % 4 if i % 50 else 0, "x", "y"))
    odd = [None, [], [0.0] * 16, [NAN] * 16, [INF] + [0.0] * 15, [None] * 16, [1.0, 2.0], [2.0, 4.0]]
    out += [(5000 + i, v, 1, None, None) for i, v in enumerate(odd)]
    return [*out, (6000, out[0][1], None, None, None), (6001, [-x for x in out[0][1]], 0, None, None), (6002, [3 * x for x in out[3][1]], out[3][2], None, None)]


def brute(rows, threshold=0.98):
    ok = {i for i, v, label, *_ in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links, parent = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    good = [r for r in rows if r[0] in ok]
    for k, (i, v, a, *_) in enumerate(good):
        for j, w, b, *_ in good[:k]:
            if a == b and len(v) == len(w) and np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], find(i)) for i in links}


@pytest.mark.parametrize("block", [2048, 20])
def test_near_dedup_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embeddings, "BLOCK", block)
    monkeypatch.setattr(embeddings, "TILE", 16)
    rows = vectors()
    found = embeddings.near_dedup(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    want = brute(rows)
    assert len(found) == len(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert sum(n > 0 for n, _ in want.values()) > 100


def test_no_vectors(spark):
    assert embeddings.near_dedup(spark.createDataFrame([], VECTORS)).count() == 0
    only_odd = spark.createDataFrame([(1, None, 1, "", ""), (2, [0.0], 1, "", "")], VECTORS)
    assert sorted(map(tuple, embeddings.near_dedup(only_odd).collect())) == [(1, 0, 1, True), (2, 0, 2, True)]


KEY = b"a key"


@pytest.mark.parametrize("text", ["4111 1111 1111 1111", "378282246310005", "GB82 WEST 1234 5698 7654 32", "123-45-6789", "+1 (988) 555-2485", "(212) 555-0199", "10.0.255.7", "1987-03-14", "14.03.1987", "03/14/1987", "first.last99@mail3.example.com"])
def test_pseudonyms_keep_the_format_and_go_back(text):
    line = f"seen: {text}, twice {text}."
    new, n = pii.pseudonymise(line, KEY)
    assert n == 2 and text not in new
    shape = lambda s: [("9" if c.isdigit() else "a") if c.isalnum() else c for c in s]
    if "10.0" not in text:
        assert shape(new) == shape(line)
    first, second = new[6:].split(", twice ")
    assert first == second[:-1]
    again, n = pii.pseudonymise(new, KEY, back=True)
    assert (again, n) == (line, 2)
    assert pii.pseudonymise(line, b"another")[0] != new


def test_links_hold_across_punctuation():
    a, _ = pii.pseudonymise("4111111111111111", KEY)
    b, _ = pii.pseudonymise("4111-1111-1111-1111", KEY)
    assert a == b.replace("-", "") and pii.luhn(a)
    two, n = pii.pseudonymise("4111111111111111 378282246310005", KEY)
    assert n == 2 and two.split()[0] == a


@pytest.mark.parametrize("text", ["4111111111111112", "999-12-3456", "000-12-3456", "256.1.1.1", "1.2.3.4.5", "2023-02-30", "GB83 WEST 1234 5698 7654 32", "version 1.2.3", "a@b", "12345678", "no numbers", "", None])
def test_what_does_not_validate_stays(text):
    assert pii.pseudonymise(text, KEY) == (text, 0)


@settings(max_examples=200, deadline=None)
@given(st.integers(2, 500), st.integers(2, 500), st.data())
def test_the_network_is_a_permutation(m, n, data):
    f = pii.Feistel(KEY)
    left, right = data.draw(st.integers(0, m - 1)), data.draw(st.integers(0, n - 1))
    there = f.halves("k", left, right, m, n)
    assert 0 <= there[0] < m and 0 <= there[1] < n and f.halves("k", *there, m, n, back=True) == (left, right)


def test_small_domains_by_enumeration():
    f = pii.Feistel(KEY)
    assert sorted(f.below("x", v, 97) for v in range(97)) == list(range(97))
    assert sorted(f.digits("d", f"{v:02d}") for v in range(100)) == [f"{v:02d}" for v in range(100)]
    valid = lambda v: v % 3 == 0
    assert sorted(f.below("x", v, 97, valid) for v in range(0, 97, 3)) == list(range(0, 97, 3))


def test_redact(spark):
    rng = random.Random(1)
    rows = [(i, f"mail me at a.b{i}@x.example.com or {rng.randint(1, 255)}.2.3.4 " * (i % 3), "x") for i in range(50)] + [(None, None, None), (99, "", None), (100, "1 " * 60000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_values string")
    found = {r.doc_id: r for r in pii.redact(docs, KEY).collect()}
    assert len(found) == len(rows)
    for i, text, _ in rows:
        assert (found[i].text, found[i].n_values) == pii.pseudonymise(text, KEY)
    assert pii.redact(docs.where("false"), KEY).count() == 0


@pytest.mark.parametrize("text,n", [("4111 1111 1111 1111 03/27", 1), ("4111-1111-1111-1111 123", 1), ("order 43 4111 1111 1111 1111", 1), ("123 4111 1111 1111 1111", 1), ("GB83 4111 1111 1111 1111", 1), ("12 34 56 78 4111 1111 1111 1111 99", 1), ("4111 1111 1111 1111 212 555 0199", 2), ("10 20 30 40 50 60 70 80 90 212 555 0199", 1)])
def test_cards_beside_other_numbers(text, n):
    new, found = pii.pseudonymise(text, KEY)
    assert found == n and "4111 1111 1111 1111" not in new.replace("-", " ") and "212 555 0199" not in new
    assert [c.isdigit() for c in new] == [c.isdigit() for c in text]
    if "4111" in text:
        card = pii.pseudonymise("4111 1111 1111 1111", KEY)[0]
        assert card in new.replace("-", " ")


@pytest.mark.parametrize("text,value", [("BE68 5390 0754 7034 EUR 500", "BE68 5390 0754 7034"), ("ES91 2100 0418 4502 0005 1332 BIC", "ES91 2100 0418 4502 0005 1332"), ("gb82 west 1234 5698 7654 32 now", "gb82 west 1234 5698 7654 32"), ("AB12 GB82 WEST 1234 5698 7654 32", "GB82 WEST 1234 5698 7654 32"), ("DE89370400440532013000 was paid", "DE89370400440532013000"), ("call +442079460958 now", "+442079460958"), ("+33123456789", "+33123456789")])
def test_values_beside_words(text, value):
    new, n = pii.pseudonymise(text, KEY)
    assert n == 1 and value not in new and len(new) == len(text)
    at = text.index(value)
    assert new[:at] == text[:at] and new[at + len(value) :] == text[at + len(value) :]
    assert pii.pseudonymise(new, KEY, back=True) == (text, 1)


def test_links_hold_for_telephone_numbers_and_ibans():
    a, b = (pii.pseudonymise(t, KEY)[0] for t in ("+44 20 7946 0958", "+442079460958"))
    assert a.replace(" ", "") == b and b.startswith("+44")
    a, b, c = (pii.pseudonymise(t, KEY)[0] for t in ("GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765432", "gb82west12345698765432"))
    assert a.replace(" ", "") == b == c.upper()


def brute_values(text):
    """Spans of valid values by trying every substring of whole words, by plain rules."""
    for m in re.finditer(r"(?<![\w.-])\d+(?:[ -]\d+)*", text):  # cards: any numbers in a row
        pieces = [(m.start() + x.start(), m.start() + x.end()) for x in re.finditer(r"\d+", m[0])]
        for i, (start, _) in enumerate(pieces):
            for _, end in pieces[i:]:
                flat = re.sub(r"[ -]", "", text[start:end])
                double = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(flat))]
                if 13 <= len(flat) <= 19 and flat[0] in "23456" and sum(d // 10 + d % 10 for d in double) % 10 == 0:
                    yield start, end
    words = [(m.start(), m.end()) for m in re.finditer(r"\S+", text)]
    for i, (start, _) in enumerate(words):
        for _, end in words[i : i + 9]:
            s = text[start:end].rstrip(".,;")
            iban = s.replace(" ", "").upper()
            if re.fullmatch(r"[A-Z]{2}\d\d[A-Z0-9]{11,30}", iban) and pii.IBAN_LENGTH.get(iban[:2]) == len(iban) and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1:
                yield start, start + len(s)
            if re.fullmatch(r"\d{3}-\d\d-\d{4}", s) and s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000":
                yield start, start + len(s)
            if m := re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", s):
                if 1900 <= int(m[1]) < 2100 and 1 <= int(m[2]) <= 12 and 1 <= int(m[3]) <= 28:
                    yield start, start + len(s)
            if re.fullmatch(r"\+\d{8,15}", s):
                yield start, start + len(s)


def test_detection_by_brute_force():
    """Every value that some substring is, is replaced; texts without any stay."""
    rng, seen = random.Random(3), 0
    cards = ["4111 1111 1111 1111", "5500005555555559", "3782-822463-10005", "6011000990139424"]
    others = ["GB82 WEST 1234 5698 7654 32", "be68539007547034", "DE89 3704 0044 0532 0130 00", "123-45-6789", "1987-03-14", "+442079460958", "+4930901820"]
    plain = ["paid", "order", "EUR", "BIC", "on", "AB12", "GB82", "7", "42", "x9", "route", "13", "2024", "000-12-3456", "4111111111111112", "v1.2", "the"]
    for _ in range(400):
        parts = [rng.choice(plain) for _ in range(rng.randint(0, 8))]
        for value in rng.sample(cards + others, rng.randint(0, 2)):
            parts.insert(rng.randint(0, len(parts)), value)
        text = " ".join(parts)
        spans = list(brute_values(text))
        new, n = pii.pseudonymise(text, KEY)
        assert len(new) == len(text) and bool(n) == bool(spans), text
        for a, b in spans:
            seen += 1
            assert new[a:b] != text[a:b], (text, text[a:b], new)
        changed = {i for i in range(len(text)) if new[i] != text[i]}
        assert changed <= {i for a, b in spans for i in range(a, b)}, (text, new)
    assert seen > 300


def test_different_vectors_of_one_id(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1), (3, [0.01, 1.0], 1), (4, [0.012, 1.0], 1)]
    docs = spark.createDataFrame([(*r, "", "") for r in rows], VECTORS)
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_dedup(docs).collect())
    assert found == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]
