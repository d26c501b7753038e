from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.llm.features import labelled_sample
from pairloom.llm.toxicity import (
    ADDRESS, COUNTS, FUZZY_STEM, FUZZY_TERM, REPORTING, WINDOW, Halves, Toxicity, Trie, _kinds, fit_lexicon, fit_toxicity, hits, kind_of,
    misspell, remove_toxic, score_toxicity,
)

SF = "/root/testdata/sf0.01"


def edits(a, b):
    """Edit distance with swaps of neighbours (each letter edited once)."""
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i or not j:
                d[i][j] = i + j
                continue
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_dynamic_programming():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    for _ in range(40):
        terms, stems = [word(rng.randint(3, 7)) for _ in range(4)], [word(rng.randint(4, 5)) for _ in range(2)]
        trie = Trie(terms, stems, 0, 0)
        for _ in range(60):
            w = word(rng.randint(0, 9))
            best = min([edits(w, t) for t in terms] + [edits(w[:i], s) for s in stems for i in range(len(w) + 1)])
            for allowed in (0, 1, 2):
                assert trie.distance(w, allowed) == (best if best <= allowed else None)


def test_quick_test_loses_no_hit():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdé") for _ in range(n))
    trie = Trie([word(rng.randint(3, 8)) for _ in range(8)], [word(rng.randint(4, 7)) for _ in range(4)], 4, 5)
    words = [word(rng.randint(1, 10)) for _ in range(20000)]
    assert _kinds(words, trie).tolist() == [kind_of(trie, w) for w in words]
    assert any(Halves(trie).may_hit(w) for w in words)


def count(text, trie=Trie(["moron", "scum", "pathetic"], ["vequ"])):
    return dict(zip(COUNTS, hits(pa.array([text]), trie, "t")[0][0].tolist()))


def test_contexts():
    none = dict.fromkeys(COUNTS, 0.0)
    assert count("A clean text about mormons, veq, vaqu and pathology.") == none
    assert count("some skum") == none | {"misspelled": 1}
    assert count("what a MORON.") == none | {"plain": 1}
    assert count("what a mroon, m0ron, morron, moro") == none | {"misspelled": 4}
    assert count("you are a moron") == none | {"plain": 1, "addressed": 1}
    assert count('she read "what a moron" aloud') == none | {"quoted": 1}
    assert count("the word moron is old") == none | {"reported": 1}
    assert count("she said you moron") == none | {"plain": 1, "addressed": 1}
    assert count("« scum » et scum") == none | {"quoted": 1, "plain": 1}
    assert count('an open " moron\nscum') == none | {"plain": 2}
    assert count("vequaire vequé veque") == none | {"plain": 3}
    far = "said " + "x " * 10 + "moron"
    assert count(far) == none | {"plain": 1}


def test_quotation_scores_less_than_abuse():
    model = Toxicity(["moron"], [])
    trie = Trie(model.terms, model.stems)
    texts = ["you moron", "a moron", "a mroon", 'the word "moron"', "nothing"]
    p = model.probability(hits(pa.array(texts), trie, "q")[0])
    assert list(p) == sorted(p, reverse=True) and p[1] > 0.5 > p[3]


def test_hits_have_places(spark, docs_of):
    model = Toxicity(["moron"], [])
    docs = docs_of(["é é moron, mmoron", None, "", "moron", "moron", "x " * 30000 + "moron"])
    out = score_toxicity(docs.selectExpr("*", "1 as toxic"), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "toxicity", "toxic", "toxic_hits"]
    rows = {r.doc_id: r for r in out.collect()}
    assert [(h["from"], h["to"], h["word"], h["misspelled"]) for h in rows[0].toxic_hits] == [(4, 9, "moron", False), (11, 17, "mmoron", True)]
    assert rows[1].toxicity == rows[2].toxicity < 0.5 < rows[3].toxicity == rows[4].toxicity
    assert rows[5].toxic_hits[0]["from"] == 60000
    left = remove_toxic(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {1, 2}
    assert score_toxicity(docs_of([]), model).count() == 0


def test_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    model = fit_toxicity(docs, labels, ~held)
    again = fit_toxicity(docs.repartition(4), labels.repartition(3), ~held)
    assert (model.terms, model.stems) == (again.terms, again.stems) and np.allclose(model.weights, again.weights)
    rows = score_toxicity(docs, model).join(labels.select("doc_id", F.col("toxic").alias("label"), "quality"), "doc_id")
    rows = [r for r in rows.filter(held & (F.col("quality") == 1)).select("label", "toxic", "lang").collect()]
    english = [r.toxic for r in rows if r.label and r.lang == "en"]
    clean = [r.toxic for r in rows if not r.label]
    assert sum(english) >= 0.9 * len(english) > 0
    assert sum(clean) <= 0.02 * len(clean)


def labelled(spark, toxic, clean=400):
    """Sample rows: the given toxic texts among other words of their own, and clean rows."""
    rows = [(i, f"t{i}a t{i}b {t} t{i}c t{i}d", 1) for i, t in enumerate(toxic)]
    rows += [(10**6 + i, f"c{i}a plain words c{i}b c{i}c", 0) for i in range(clean)]
    return spark.createDataFrame(rows, "key bigint, text string, label int")


def test_misspelled_words_of_a_family_with_a_short_stem(spark):
    sample = labelled(spark, ["moron", "morons", "moronic", "moronity"] * 10)
    terms, stems = fit_lexicon(sample)
    assert "moro" in stems
    trie = Trie(terms, stems)
    assert [kind_of(trie, w) for w in ("morons", "moronesque", "moronity")] == [1, 1, 1]
    assert [kind_of(trie, w) for w in ("mroon", "m0ronic", "mroonic", "morrons", "mronity", "maronic")] == [2] * 6
    assert [kind_of(trie, w) for w in ("maro", "words", "mor")] == [0, 0, 0]


def test_a_rare_term_stays_among_many_toxic_rows(spark):
    assert "grawlix" in fit_lexicon(labelled(spark, ["scum"] * 700 + ["grawlix"] * 9, 1000))[0]


def test_nothing_to_learn_from(spark, docs_of):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    model = fit_toxicity(docs_of(["a", None]), none, F.lit(True))
    assert (model.terms, model.stems) == ([], [])
    assert score_toxicity(docs_of(["a", None]), model).filter("toxic").count() == 0
    odd = spark.createDataFrame([(0, 1), (0, None), (None, 1), (1, 0)], "doc_id bigint, toxic int")
    assert fit_toxicity(docs_of(["a", None]), odd, F.lit(True)).terms == []


def test_a_sample_is_bounded_and_chosen_among_the_documents(spark, docs_of):
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, toxic int")
    copies = docs_of([(7, t, "en", "s", 1) for t in [None, "b", "a"] * 300] + [(i, f"t{i}", "en", "s", 1) for i in range(290, 310)])
    found = {r.key: (r.text, r.label) for r in labelled_sample(copies, labels, F.lit(True), "toxic").collect()}
    assert found == {7: ("", 1)} | {i: (f"t{i}", i % 2) for i in range(290, 300)}
    assert labelled_sample(copies, labels, F.lit(True), "toxic", rows=5).count() == 5
    assert labelled_sample(copies, labels, F.col("doc_id") < 7, "toxic").count() == 0


def fitted(spark, docs_of):
    """A model of made-up rows: toxic ones with two terms, clean ones with a word next to one of them."""
    texts = [f"w{i}a w{i}b moron w{i}c pathetic w{i}d" for i in range(60)] + [f"c{i}a mormon c{i}b maron words c{i}c" for i in range(400)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(460)], "doc_id bigint, toxic int")
    return fit_toxicity(docs_of(texts), labels, F.lit(True))


def test_misspelled_hits_count_and_ordinary_words_do_not(spark, docs_of):
    model = fitted(spark, docs_of)
    assert (model.terms, model.stems, model.ordinary) == (["moron", "pathetic"], [], ["maron", "mormon"])
    score = lambda *texts: model.probability(hits(pa.array(texts), model.trie(), model.name)[0])
    empty, plain, wrong, ordinary, quoted = score("", "a moron, pathetic", "a m0ron, patheitc", "a maron mormon", 'a "moron" and "pathetic"')
    assert empty == ordinary < 0.5 < wrong <= plain and quoted < 0.5
    assert (model.weights[:-1] >= 0).all() and model.weights[1] > 0
    counts = np.random.default_rng(0).integers(0, 5, (200, 5)).astype(float)
    for kind in range(5):
        more = counts.copy()
        more[:, kind] += 1
        assert (model.probability(more) >= model.probability(counts)).all()


def test_entries_with_ever_new_near_misses_are_exact(spark, docs_of):
    texts = [f"w{i}a scummy{chr(97 + i % 20)}{i} w{i}b" for i in range(60)]
    texts += [f"c{i}a slummy{chr(97 + i % 20)}{i} c{i}b" for i in range(400)]
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(460)], "doc_id bigint, toxic int")
    model = fit_toxicity(docs_of(texts), labels, F.lit(True))
    assert "^scumm" in model.exact or not any(len(s) >= FUZZY_STEM for s in model.stems)
    assert kind_of(model.trie(), "slummyzz") == 0 and kind_of(model.trie(), "scummyzz") == 1


def test_misspell_makes_one_edit():
    for w in ("moron", "idiot", "pathetic", "scum", "axa", "réeux", "xxxxx"):
        assert edits(w, misspell(w)) <= 1
    assert misspell("ab") == "ab"


def brute_score(text, model):
    """The score by the definition: every word against every entry by edit distance."""
    import math
    import re

    places = [(m.start(), m.group()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    quoted = set()
    pairs = {'"': '"', "“": "”", "„": "“", "«": "»", "‹": "›", "»": "«"}
    at = 0
    for line in text.split("\n"):
        i = 0
        while i < len(line):
            end = line.find(pairs[line[i]], i + 1) if line[i] in pairs else -1
            if end > i:
                quoted |= set(range(at + i, at + end))
                i = end
            i += 1
        at += len(line) + 1

    def kind(w):
        if w in model.terms or any(w.startswith(s) for s in model.stems):
            return 1
        if w in model.ordinary:
            return 0
        near = [t for t in model.terms if len(t) >= FUZZY_TERM and t not in model.exact and edits(w, t) == 1]
        near += [s for s in model.stems if len(s) >= FUZZY_STEM and "^" + s not in model.exact for i in range(len(w) + 1) if edits(w[:i], s) == 1]
        return 2 if near else 0

    counts = dict.fromkeys(COUNTS, 0)
    for n, (start, word) in enumerate(places):
        k = kind(word.lower())
        if not k:
            continue
        near = {w.lower() for j, (_, w) in enumerate(places) if 0 < abs(j - n) <= WINDOW}
        if start in quoted:
            counts["quoted"] += 1
        elif near & REPORTING and not near & ADDRESS:
            counts["reported"] += 1
        else:
            counts[COUNTS[k - 1]] += 1
            counts["addressed"] += bool(near & ADDRESS)
    w = dict(zip(["abuse", "share", "quoted", "reported", "addressed", "constant"], model.weights))
    scale = lambda x: min(math.log2(1 + x), 3.0)
    total = w["abuse"] * scale(counts["plain"] + w["share"] * counts["misspelled"]) + w["constant"]
    total += sum(w[c] * scale(counts[c]) for c in ("quoted", "reported", "addressed"))
    return 1 / (1 + math.exp(-total))


def test_whole_score_against_brute_force(spark, docs_of):
    model = Toxicity(
        ["moron", "scum", "pathetic", "idiot"], ["vequa", "ab"], np.array([3.0, 0.7, 0.2, 0.4, 0.9, -4.0]), ["maron", "idot"], ["pathetic"]
    )
    rng = random.Random(5)
    words = ["moron", "Moron", "m0ron", "maron", "skum", "scum", "patheitc", "PATHETIC", "idiot", "idoit", "idot", "vequaire", "vequia", "vqua", "abc"]
    words += ["you", "said", "word", "x", "plain", "ça", "é", '"', "“", "”", "«", "»", "\n", ".", "moron.", '"idiot"', "12"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(400)]
    rows = score_toxicity(docs_of(texts), model).select("text", "toxicity").collect()
    assert len(rows) == 400
    for r in rows:
        assert r.toxicity == pytest.approx(brute_score(r.text, model), abs=1e-9)
