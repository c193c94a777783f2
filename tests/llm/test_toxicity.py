"""Automata against plain edit distances; windows, training and whole results of the score."""

import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tractlens.llm import toxicity
from tractlens.llm.automaton import LexiconAutomaton, edits_allowed

SCHEMA = "doc_id long, text string, score string, toxic int, half string"
LABELS = "doc_id long, quality int, toxic int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_nearest(terms, word):
    """Best edits of the whole word and of a prefix, by trying all terms."""
    whole = [(d, i) for i, t in enumerate(terms) if (d := distance(t, word)) <= edits_allowed(t)]
    begun = [
        (d, i) for k in range(1, len(word)) for i, t in enumerate(terms) if (d := distance(t, word[:k])) <= edits_allowed(t)
    ]
    whole, begun = min(whole, default=(9, 0)), min(begun, default=(9, 0))
    if min(whole[0], begun[0]) == 9:
        return None
    return (whole[0], True) if whole[0] <= begun[0] else (begun[0], False)


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.text(alphabet="abcé", min_size=1, max_size=9), min_size=1, max_size=6, unique=True),
    st.lists(st.text(alphabet="abcéx", max_size=10), max_size=12),
)
def test_automaton_equals_plain_distances(terms, words):
    for capacity in (10_000, 3):
        automaton = LexiconAutomaton(terms, capacity=capacity)
        for word in words:
            found = automaton.nearest(word)
            got = None if found is None else (found[0], found[2])
            assert got == plain_nearest(terms, word), (terms, word)
            if found is not None:
                lengths = [len(word)] if found[2] else range(1, len(word))
                assert min(distance(terms[found[1]], word[:k]) for k in lengths) == found[0]


def test_kinds_of_matches():
    reader = toxicity.Reader([("idiot", 1.0), ("worthless", 1.0)])
    kinds = {w: (m and m[0]) for w in ["idiot", "Idiots!", "id1ot", "iiiidiot", "idioot", "wortles", "worth", "idle", ""] for m in [reader.match(w)]}
    assert kinds == {"idiot": 0, "Idiots!": 0, "id1ot": 1, "iiiidiot": 1, "idioot": 2, "wortles": 3, "worth": None, "idle": None, "": None}


def test_windows_tell_mention_from_use():
    reader = toxicity.Reader([("idiot", 1.0), ("moron", 1.0), ("scum", 1.0)])
    names = toxicity.FEATURES

    def seen(text):
        return dict(zip(names, reader.features(text)))

    use = seen("well you idiot and you moron are SCUM to me")
    quote = seen('the paper wrote that “idiot” and "you moron are scum" are words of abuse')
    assert use["uses"] == pytest.approx(np.log(4)) and use["mentions"] == 0
    assert use["addressed"] > 0 and use["shouted"] > 0 and use["three"] == 1
    assert quote["uses"] == 0 and quote["mentions"] == pytest.approx(np.log(4)) and quote["three"] == 0
    model = toxicity.Model([], toxicity.START_BASE, toxicity.START)
    score = [float(model.score(np.array([list(s.values())]))[0]) for s in (use, quote, seen("a clean text"))]
    assert score[0] > 0.5 > 0.1 > max(score[1:])
    assert seen('"' + "word " * 60 + 'idiot"')["mentions"] == 0


@pytest.fixture(scope="module")
def made():
    random = np.random.default_rng(3)
    clean = ["".join(random.choice(list("aeioustrn"), 5)) for _ in range(400)]
    bad = ["vekuzz", "grolmak", "pliddow", "worthwicked"]
    rows, labels = [], []
    for i in range(900):
        words = list(random.choice(clean, 40))
        toxic = i % 6 == 0
        if toxic:
            for w in random.choice(bad, 3):
                words.insert(int(random.integers(40)), w)
        rows.append((i, " ".join(words), "old", 1, "h"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_lexicon_and_scores(spark, stored, made):
    rows, labels = made
    extra = [
        (5000, rows[1][1] + " gr0lmak and vvvekuzz or pl*ddow", "x", 1, "h"),
        (5001, rows[1][1] + ' they wrote "grolmak" and "vekuzz pliddow"', "x", 1, "h"),
        (5002, None, None, None, None),
        (5003, "", None, None, None),
        (None, rows[0][1], None, None, None),
        (0, rows[0][1], None, None, None),
        (5004, rows[1][1] + " " + rows[3][1] * 4000, None, None, None),
    ]
    docs = stored(rows + extra, SCHEMA)
    table = stored(labels + [(0, 1, 1), (None, 1, 1), (77777, 1, 1), (5, None, None)], LABELS, "labels")
    model = toxicity.fitted(docs, table)
    assert {t for t, _ in model.terms} >= {"vekuzz", "grolmak", "pliddow", "worthwicked"}
    got = toxicity.scored(docs, model, "tox").collect()
    assert len(got) == len(rows) + len(extra) and got[0].asDict().keys() == {"doc_id", "text", "score", "toxic", "half", "tox"}
    score = {r.doc_id: r.tox for r in got}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(score[i] >= 0.5) == truth[i] for i in held]) > 0.97
    assert score[5000] > 0.5 > 0.1 > score[5001]
    assert score[5002] == score[5003] < 0.1 and score[5004] < 0.1
    assert score[None] == score[0] > 0.5


def test_near_copies_count_once(spark, stored, made):
    rows, labels = made
    copies = [(10_000 + i, rows[0][1].replace(" ", f" {i} ", 1), "x", 1, "h") for i in range(200)]
    docs = stored(rows + copies, SCHEMA)
    table = stored(labels + [(r[0], 1, 1) for r in copies], LABELS, "labels")
    words = Counter(w for r in copies for w in set(r[1].split()))
    assert max(words.values()) == 200
    sample = toxicity.sampled(docs, table).collect()
    assert sum(r.doc_id >= 10_000 for r in sample) <= 5
    assert {t for t, _ in toxicity.fitted(docs, table).terms} <= {"vekuzz", "grolmak", "pliddow", "worthwicked"}


def test_no_labels_no_rows(spark, stored, made):
    docs = stored(made[0][:5], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    model = toxicity.fitted(docs, none)
    assert model.terms == [] and len({r.tox for r in toxicity.scored(docs, model, "tox").collect()}) == 1
    assert toxicity.scored(stored([], SCHEMA, "nothing"), model, "tox").count() == 0


def test_held_out_rows_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op11_lexicon_automata(spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count() and got.score.between(0, 1).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    held = got[got.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.toxic).mean() > 0.85
