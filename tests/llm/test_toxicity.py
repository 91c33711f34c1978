import random
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from netsight.llm import toxicity

FOUL = ["grobnik", "smurdle", "vexo", "plonkard"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y))
    return row[-1]


def plainly(word, terms, stems):
    whole = min((distance(word, t) for t in terms if distance(word, t) <= (len(t) >= 5)), default=9)
    begun = min((d for s in stems for k in range(len(word) + 1) if (d := distance(word[:k], s)) <= (len(s) >= 6)), default=9)
    return 1 if whole == 0 else 3 if begun == 0 else 2 if whole == 1 else 4 if begun == 1 else 0


@given(
    st.lists(st.text("abc", min_size=1, max_size=8), max_size=5), st.lists(st.text("abc", min_size=1, max_size=8), max_size=3),
    st.lists(st.text("abcd", max_size=10), max_size=20),
)
def test_automaton_is_the_edit_distance(terms, stems, words):
    automaton = toxicity.Automaton(terms, stems)
    for word in [*words, *terms, *(s + "d" for s in stems)]:
        assert automaton.match(word) == plainly(word, terms, stems)


@pytest.mark.parametrize(
    "text,abusive,reported",
    [
        ("you grobnik", 1, 0), ("you gr0bnik and GROBNIKS", 2, 0), ('he said "grobnik" to me', 0, 1), ("the word grobnik is old", 0, 1),
        ("»ein grobnik«", 0, 1), ('"it was grobnik" they thought', 0, 1), ("it's a grobnik, isn't it", 1, 0), ("nothing here", 0, 0), ("", 0, 0),
        ("grobnik", 1, 0),
    ],
)
def test_quotation_is_told_from_abuse(text, abusive, reported):
    automaton = toxicity.Automaton(["grobnik"], [])
    kinds = {w: automaton.match(w) for w in toxicity.WORD.findall(text.lower())}
    found = toxicity.hits(text, kinds)
    assert (sum(found[:4]), found[4]) == (abusive, reported)


@pytest.fixture(scope="module")
def labelled(spark, prose):
    r, docs, labels = random.Random(1), [], []
    for i in range(600):
        words = prose(r.randint(30, 90), i).split()
        toxic = i % 6 == 0
        for _ in range(r.randint(1, 4) if toxic else 0):
            word = r.choice([*FOUL, "zork" + r.choice(["en", "isch", "ung", "lich", "te"])])
            if r.random() < 0.2 and len(word) > 5:
                word = word[:2] + "x" + word[3:]
            words.insert(r.randrange(len(words)), word)
        docs.append((i, " ".join(words), "a"))
        labels.append((i, 1, int(toxic)))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_held_out_accuracy(documents, labelled):
    docs, labels = labelled
    found = toxicity.toxicity(documents(docs), labels).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    held = [(r.predicted, int(r.doc_id % 6 == 0)) for r in found if r.held_out]
    assert len(held) > 80 and sum(a == b for a, b in held) / len(held) > 0.97


def test_held_out_labels_teach_nothing(documents, labelled, spark):
    docs, labels = labelled
    turned = spark.createDataFrame([(r.doc_id, 1, 1 - r.toxic if held_out(r.doc_id) else r.toxic) for r in labels.collect()], labels.schema)
    a, b = (sorted(map(str, toxicity.toxicity(documents(docs), x).collect())) for x in (labels, turned))
    assert a == b


def test_nasty(documents, nasty, labelled, spark):
    _, labels = labelled
    odd = labels.unionByName(spark.createDataFrame([(None, 1, 1), (1, 1, None), (2, None, 1), (2, 1, 0)], labels.schema))
    assert len(toxicity.toxicity(documents(nasty), odd).collect()) == len(nasty)
    assert toxicity.toxicity(documents([]), labels).count() == 0
    assert all(0 < r.score < 1 for r in toxicity.toxicity(documents(nasty), labels.limit(0)).collect())
    only = spark.createDataFrame([(1, 1, 0), (6, 1, 0)], labels.schema)
    assert all(r.predicted == 0 for r in toxicity.toxicity(documents(nasty), only).collect())


def test_weights_are_not_negative():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.random((300, 3))
    y = (x[:, 0] - x[:, 1] + 0.1 * r.standard_normal(300) > 0).astype(float)
    w = toxicity.regression(x, y)
    assert w[0] > 1 and w[1] == 0 and w[2] >= 0
