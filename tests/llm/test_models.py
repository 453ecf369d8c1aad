import random
import re
import zlib

import numpy as np
import pytest

from lodestore.llm import labelled, quality, toxicity

DOCS = "doc_id long, text string, label string, score string, _id string"
LABELS = "doc_id long, quality int, toxic int, text string"
NICE = "river stone garden letter window morning music teacher bridge paper mountain kitchen".split()
BAD = ["vile", "grubby", "wretched", "fiend"]


def corpus(n=900):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(NICE) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(5, 120))]
        toxic, good = int(i % 7 == 0), int(i % 5 != 1)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
        if not good:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), "x", "y", "z"))
        if i % 3:
            labels.append((i, good, toxic, "x"))
    return docs, labels


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    extra = [(5000, None, None, None, None), (5001, "", None, None, None), (5002, "word " * 40000, None, None, None), (None, "no id", None, None, None)]
    wrong = [(None, 1, 0, "x"), (7, None, None, "x"), (10, 0, 1, "x"), (10, 1, 0, "x")]
    return spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels + wrong, LABELS)


@pytest.mark.parametrize("operator,truth,threshold,least", [(quality.quality, lambda i: i % 5 != 1, 0.3, 0.97), (toxicity.toxicity, lambda i: i % 7 == 0, 0.5, 0.97)])
def test_held_out_accuracy(tables, operator, truth, threshold, least):
    docs, labels = tables
    found = operator(docs, labels).collect()
    assert len(found) == docs.count()
    right = [int(r.predicted == truth(r.doc_id)) for r in found if r.held_out and r.doc_id < 900]
    assert len(right) > 100 and np.mean(right) >= least
    for r in found:
        assert r.held_out == (r.doc_id is not None and held(r.doc_id)) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    again = operator(docs.repartition(5), labels).collect()
    assert {(r.doc_id, round(r.score, 9)) for r in found} == {(r.doc_id, round(r.score, 9)) for r in again}


def test_held_out_rows_are_not_learned_from(spark):
    docs, labels = corpus(200)
    texts, totals = labelled.training_rows(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), "toxic", 10)
    by_text = {t: i for i, t, *_ in docs}
    assert all(not held(by_text[t]) for c in texts for t in c) and all(len(c) <= 10 for c in texts)
    assert totals == [sum(not held(i) and t == k for i, _, t, _ in labels) for k in (0, 1)]


@pytest.mark.parametrize("operator", [quality.quality, toxicity.toxicity])
def test_one_class_none_and_no_documents(spark, operator):
    docs, labels = corpus(60)
    docs, labels = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    assert operator(docs, labels.where("false")).count() == 60
    assert operator(docs, labels.where("quality = 1 AND toxic = 0")).count() == 60
    assert operator(docs.where("false"), labels).count() == 0


def test_disguises_are_read(spark):
    docs, labels = corpus()
    model = toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    plain = model.score(["a wretched fiend", "stones by the river"])
    assert plain[0] > 0.5 > plain[1]
    disguised = ["wr3tch3d f1end", "w r e t c h e d  f i e n d", "w.r.e.t.c.h.e.d f-i-e-n-d", "wreeeetched fiiiiend", "WR3TCHED F!END!!"]
    assert (model.score(disguised) > 0.5).all()
    assert (model.score(["5 rivers, 12 stones", "a a a a a a a", "m u s i c", "riverrrr", "1234 5678", None, ""]) < 0.5).all()


def test_viterbi_against_all_paths():
    from collections import Counter
    from itertools import product

    model = toxicity.CharacterModel(Counter({"lost": 5, "list": 3, "its": 4, "toil": 1}))
    for text in ("l1st", "1t5", "l.o.s.t", "t0 1l", "loost"):

        def cost(path):
            sum_, at = sum(c for _, c in path), "  "
            for ch in "".join(r for r, _ in path) + " ":
                sum_ += model.cost(at, ch)
                at = at[1] + ch
            return sum_

        paths = list(product(*toxicity.lattice(text)))
        best = min(paths, key=cost)
        got = toxicity.decode(text, model)
        assert min(cost(p) for p in paths if "".join(r for r, _ in p).strip() == got) == pytest.approx(cost(best))


def test_long_runs_ties_and_copies(spark):
    docs, labels = corpus()
    model = toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert model.score([f"wr{'e' * 100}tched f{'i' * 90}end"])[0] > 0.5
    unseen = toxicity.CharacterModel(toxicity.Counter())
    assert toxicity.decode("1 2 " * 20_000, unseen) == toxicity.decode("1 2 " * 20_000, unseen)
    text = "some words that stand in every copy of one text"
    assert toxicity.copy_key(text) == toxicity.copy_key(text.upper()) != toxicity.copy_key("some other words")
    assert toxicity.copy_key("") == toxicity.copy_key(" ") and toxicity.copy_key("one") != toxicity.copy_key("two")


def test_words_of_a_much_copied_text_are_not_toxic():
    clean = [f"stones by river number {i} and hill {i + 7}" for i in range(200)]
    toxic = [f"such a wretched thing said {i} of {i * 3}" for i in range(40)] + ["the wretched lantern of amber glows"] * 40
    model = toxicity.Model([clean, toxic], [200, 80])
    assert model.weights["wretched$"] > 0 and "lantern$" not in model.weights
    assert model.score(["lantern by river", "wretched river"]).round().tolist() == [0, 1]


def test_kept_rows(spark, tables):
    docs, labels = tables
    kept = toxicity.kept_rows(docs, docs, labels)
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if not p}


def test_every_word_of_several_readings_is_decoded(spark):
    docs, labels = corpus()
    model = toxicity.train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    forms = ["wrretched", "ffiieenndd", "w..r..e..t..c..h..e..d", "f--i--e--n--d", "v.-i.-l.-e"]
    assert (model.score(forms) > 0.5).all()
    assert model.score(["lletter by the riiver", "rivers... (stones)", "m..u..s..i..c", "====", "a a a a"]).max() < 0.5
    for word in ("idiiot", "iddiot", "iiddiioott", "i..d..i..o..t", "i--d--i--o--t", "it's"):
        assert toxicity._DISGUISED.search(word)
    assert not any(map(toxicity._DISGUISED.search, ("idiot", "idiot...", "--idiot", "....")))
    few = toxicity.Reader(toxicity.CharacterModel(toxicity.Counter({"poop": 5, "ass": 5})))
    assert few.spaced("p o o p") == {"poop"} and few.spaced("a\ts s") == {"ass"} and few.spaced("x x x x") == set()
    assert few.spaced("p  o  o  p") == {"poop"} and few.spaced("a\t\ts\t\ts  p  o  o  p") == {"ass", "poop"} and few.spaced("a s s  p o o p") == {"ass", "poop"}
    assert few.spaced("p  o o   p") == set() and few.spaced("poop  a  s") == set()


def test_training_rows_of_a_repeated_id(spark):
    docs = spark.createDataFrame([(1, f"text {9 - i}") for i in range(9)] + [(2, None), (2, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert not held(1) and not held(2)
    assert labelled.training_rows(docs, labels, "toxic", 10) == ([["text 1"], [""]], [1, 1])


def test_pieces_of_training_texts():
    parts = quality._parts(["a" * 2500, "short", "b" * 3, "", "é" * 700])
    assert b"".join(parts) == ("a" * 2500 + "short" + "b" * 3 + "é" * 700).encode() and all(len(p) >= 8 for p in parts)
    assert quality._parts(["abc", "d"]) == [b"abcd"] and quality._parts([]) == [b""]


def sigmoid_of(calibrated, x):
    z = calibrated.w[0] + sum(w * (v - m) / s for w, v, m, s in zip(calibrated.w[1:], x, calibrated.mean, calibrated.scale))
    return 1 / (1 + np.exp(-z))


def test_quality_scores_by_brute_force(tables):
    """Each piece of a text compressed anew with each dictionary; the logistic function by hand."""
    import zstandard

    model = quality.train(*tables)
    texts = [r.text or "" for r in tables[0].where("doc_id >= 5000 OR doc_id < 40 OR doc_id IS NULL").collect()] + ["long enough " * 700]
    for text, score in zip(texts, model.score(texts)):
        data, sizes = text.encode(), []
        for words in (model.good, model.bad):
            pieces = [data[a : a + 1024] for a in range(0, len(data), 1024)] or [b""]
            press = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=False, write_dict_id=False) for _ in pieces]
            sizes.append(sum(len(c.compress(p)) for c, p in zip(press, pieces)))
        d, ratio = (sizes[1] - sizes[0]) / max(sizes), np.log((len(data) + 16) / (sizes[0] + 16))
        assert score == pytest.approx(sigmoid_of(model.calibrated, [d, ratio, d * ratio, ratio**2]), abs=1e-9)


def test_toxicity_scores_by_brute_force(spark):
    """Weights and scores from sets of words, text by text."""
    docs, labels = corpus(500)
    texts, totals = labelled.training_rows(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), "toxic", 3000)
    texts[1][0] += " wr3tch3d f i e n d"
    model = toxicity.Model(texts, totals)

    def written(text):
        text = text.lower()
        return set(text.split()) | {w for m in re.finditer(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)", text) if len(set(m[0]) - {" ", "\t"}) > 1 for w in toxicity.decode(m[0], model.reader.model).split(" ") if len(w) > 2}

    def forms(word):
        out = set()
        for w in {word, *(toxicity.decode(word, model.reader.model).split(" ") if toxicity._DISGUISED.search(word) and re.search(r"[^\W\d_]", word) else [])}:
            if w := re.sub(r"^[^\w@$]+|[^\w]+$", "", w):
                out |= {w + "$", *(w[:k] for k in (4, 5, 6) if len(w) > k)}
        return out

    groups = [{}, {}]
    for k in (0, 1):
        for t in texts[k]:
            groups[k].setdefault(toxicity.copy_key(t), set()).update(*map(forms, written(t)))
    weight = {}
    for f in set().union(*groups[1].values()):
        toxic, clean = (sum(f in g for g in groups[k].values()) for k in (1, 0))
        in_texts = sum(f in set().union(*map(forms, written(t))) for t in texts[1])
        odds = np.log(max(toxic - toxic**0.5, 1e-9) / len(groups[1])) - np.log((clean + clean**0.5 + 1) / len(groups[0]))
        if toxic >= 4 and in_texts >= 4 and odds > 1.5:
            weight[f] = odds
    assert weight and weight.keys() == model.weights.keys() and all(model.weights[f] == pytest.approx(w) for f, w in weight.items())
    some = [t for c in texts for t in c[:30]] + ["", "a f1end", "w r e t c h e d rivers", "viile", "stones 455"]
    for text, score in zip(some, model.score(some)):
        best = sorted((max((weight.get(f, 0.0) for f in forms(w)), default=0.0) for w in written(text)), reverse=True)
        best = [b for b in best if b]
        x = [best[0] if best else 0.0, best[1] if len(best) > 1 else 0.0, np.log(1 + sum(b > 3.0 for b in best))]
        assert score == pytest.approx(sigmoid_of(model.calibrated, x), abs=1e-9)


def test_every_labelled_row_is_learned_from(spark):
    """More texts of each class than any sample held, with copies, near copies, repeated ids and null texts:
    train's passes give the model of all texts in one list."""
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(9600):
        words = [rng.choice(NICE) + rng.choice(["", "s", "ly"]) for _ in range(rng.randint(4, 9))]
        if i % 2:
            words[rng.randrange(len(words))] = rng.choice(["grubby", "gru6by", "f i e n d", "wretched,", rng.choice(NICE) + "ish"])
        docs.append((i, " ".join(words)))
        labels.append((i, 0, i % 2))
    for i in range(0, 9600, 7):
        docs[i] = (i, docs[i % 40][1] + (" and more" if i % 3 else ""))
    labels += [(20, 0, 1), (21, 0, 0), (20001, 0, 1)]
    texts, by_id = [[], []], {i: t for i, t in docs}
    docs += [(33, "a text before all others"), (33, None), (44, "z")]
    by_id |= {33: "", 44: min(by_id[44], "z")}
    for i, t in by_id.items():
        if not held(i) and i not in (20, 21):
            texts[i % 2].append(t)
    assert min(map(len, texts)) > 3000
    want = toxicity.Model(texts, [len(c) for c in texts])
    model = toxicity.train(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.weights and model.weights == want.weights
    assert (model.reader.model.one, model.reader.model.two, model.reader.model.three) == (want.reader.model.one, want.reader.model.two, want.reader.model.three)
    assert model.calibrated.w == pytest.approx(want.calibrated.w, rel=1e-6)
    some = [t for c in texts for t in c[:300]] + ["", "a f1end", "w r e t c h e d rivers"]
    assert model.score(some) == pytest.approx(want.score(some), abs=1e-9)


def test_stretches_and_first_letters_give_what_whole_words_do():
    """Words decoded by stretches, and weighed only where their first letters may begin a feature, against
    Viterbi over each whole word and against all words' features."""
    rng = random.Random(6)
    model = toxicity.CharacterModel(toxicity.Counter({w + e: rng.randint(1, 9) for w in [*NICE, *BAD, "poop", "ass"] for e in ("", "s", "ly")}))
    reader = toxicity.Reader(model)
    words = {"".join(rng.choice("aeiosrtchd" * 3 + "13$@!.-_*'|,;é\0") for _ in range(rng.randint(1, 12))) for _ in range(3000)}
    for w in [*NICE, *BAD]:
        words |= {w, w + ".", w + "!", w[:2] + w[1:], w[:3] + w[2] * 3 + w[3:], w.replace("e", "3"), ".".join(w), w[0] * 3 + w[1:]}
    for text in [*words, "a  s  s", "p o o p", "x"]:
        assert toxicity.decode(text, model) == toxicity._viterbi(text, "  ", " ", model).strip()
    weights = [{f: rng.random() for w in [*NICE[::k], *BAD, "ass", "é"] for f in toxicity._forms(w)} for k in (2, 3)]
    found = toxicity.Weighed(reader, weights)._weigh(list(words))
    for word, *own in zip(words, *found.tolist()):
        assert own == [max((of.get(f, 0.0) for f in reader.forms(word)), default=0.0) for of in weights]


def test_no_trigram_or_reading_is_looked_up_word_by_word():
    """What took most CPU: trigrams of many words are counted in numpy, and words share stretches."""
    words = ["stone", "é", "window", "stone's", "文字", "𝒳y"]
    n = np.array([3, 1, 2, 5, 1, 4])
    got = toxicity.Counter()
    for t, k in toxicity.triples_of(words, n):
        got[t] += k
    assert got == toxicity.triples(toxicity.Counter(dict(zip(words, n.tolist()))))
    model = toxicity.CharacterModel(toxicity.Counter({"letter": 3}))
    for word in ("better", "abetter", "cabetter"):
        toxicity.decode(word, model)
    assert len(model.stretches) == 1
