"""Toxicity and quality: held-out accuracy on invented text, and edge cases."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import quality, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(3)
    parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(1, 5)))
    rude = ["gruzzled", "plonkish", "snarfwit", "blatherskite"]
    docs, marks = [], []
    for i in range(700):
        w = [word() for _ in range(rng.randrange(30, 160))]
        bad, junk = i % 4 == 0, i % 5 == 0
        if bad:
            for _ in range(5):
                w[rng.randrange(len(w))] = rng.choice(rude)
        if junk:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w)))
        marks.append((i, int(bad), int(not junk)))
    return spark.createDataFrame(docs, "doc_id long, text string").cache(), marks


def accuracy(scores, marks, held):
    got = {r.doc_id: r.score for r in scores.collect()}
    return np.mean([(got[i] >= 0.5) == bool(y) for i, y in marks if i in held])


def test_toxicity_held_out(spark, labelled):
    docs, marks = labelled
    held = {i for i, _, _ in marks if i % 3 == 0}
    learn = spark.createDataFrame([(i, t) for i, t, _ in marks if i not in held], "doc_id long, label int")
    model = toxicity.train(docs, learn)
    assert accuracy(toxicity.score(docs, model), [(i, t) for i, t, _ in marks], held) > 0.9
    kept = toxicity.reject(docs, model)
    assert kept.schema == docs.schema
    assert kept.count() == toxicity.score(docs, model).where("score < 0.5").count()


def test_quality_held_out(spark, labelled):
    docs, marks = labelled
    held = {i for i, _, _ in marks if i % 3 == 1}
    learn = spark.createDataFrame([(i, q) for i, _, q in marks if i not in held], "doc_id long, label int")
    assert accuracy(quality.score(docs, quality.train(docs, learn)), [(i, q) for i, _, q in marks], held) > 0.97


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_edge_rows(spark, labelled, operator):
    docs, marks = labelled
    learn = spark.createDataFrame([(i, t) for i, t, _ in marks], "doc_id long, label int")
    model = operator.train(docs, learn)
    odd = spark.createDataFrame([(1, None, 0), (1, "", 0), (None, "a", 0), (2, "long " * 40_000, 0), (2, "long " * 40_000, 0)], "doc_id long, text string, label int")
    rows = operator.score(odd, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert operator.score(odd.where("false"), model).count() == 0
    untaught = operator.train(docs, learn.where("false"))
    assert len({r.score for r in operator.score(odd, untaught).collect()}) == 1


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_equal_texts_have_equal_scores_and_other_columns_are_ignored(spark, labelled, operator):
    docs, marks = labelled
    learn = spark.createDataFrame([(i, t) for i, t, _ in marks], "doc_id long, label int")
    texts = [r.text for r in docs.limit(40).collect()] + ["gruzzled plonkish " * 3000]
    rows = [(i, texts[(i * i) % len(texts)], 1, 2, 3, 4) for i in range(300)]
    many = spark.createDataFrame(rows, "doc_id long, text string, label int, o int, h int, size int").repartition(5)
    # Repeated rows, conflicting labels of an id and clashing names reach training too.
    model = operator.train(many.unionByName(many), learn.unionByName(learn.where("doc_id < 20").selectExpr("doc_id", "1 - label AS label")))
    by_text = {}
    for r in many.join(operator.score(many, model), "doc_id").collect():
        by_text.setdefault(r.text, set()).add(r.score)
    assert all(len(v) == 1 for v in by_text.values())


def test_the_toxic_dictionary_is_trained_on_what_is_typical():
    ordinary = [b"the weather was mild and the river ran slow %d" % i for i in range(60)]
    rude = b"you snarfwit of a blatherskite who never once read the whole of a sentence"
    runs = toxicity.typical_segments([b"the weather " + rude + b" %d" % i for i in range(30)], ordinary, toxicity.ToxicityParams())
    assert runs and max(map(len, runs)) > 40 and all(r in rude + b" " or b"weather" not in r for r in runs)


def test_typical_segments_take_little_of_the_drivers_memory():
    ordinary = [b"the weather was mild and the river ran slow %d" % i for i in range(60)]
    toxic = [b"the weather " + b"you snarfwit of a blatherskite " * 20_000 for _ in range(9)]
    tracemalloc.start()
    runs = toxicity.typical_segments(toxic, ordinary, toxicity.ToxicityParams())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Two tables of 2**22 counts and the runs themselves; all slots at once took 177 MB.
    assert max(map(len, runs)) > 500_000 and peak < 70_000_000


def test_slots_do_not_depend_on_pieces():
    text = np.random.default_rng(6).integers(0, 256, 2 * toxicity.PIECE + 9, dtype=np.uint8).tobytes()
    slots = toxicity._slots(text, 5)
    assert len(slots) == len(text) - 4 and len(toxicity._slots(b"abcd", 5)) == 0
    for k in [0, 1, *range(toxicity.PIECE - 6, toxicity.PIECE + 6), *range(2 * toxicity.PIECE - 6, len(slots))]:
        assert slots[k] == toxicity._slots(text[k : k + 5], 5)[0]


def test_windows_cover_the_text():
    text = b"ab cd " * 50 + b"x" * 300
    assert b"".join(toxicity.cut(text, 64)) == text
    assert max(map(len, toxicity.cut(text, 64))) <= 64 and toxicity.cut(b"", 64) == [b""]


def test_ngrams_are_unit_vectors():
    slots, values, first = quality.ngrams(pa.array(["a b b", None, "", "!! C"]), 12)
    sums = [float((values[i:j] ** 2).sum()) for i, j in zip(first[:-1], first[1:], strict=True)]
    assert [round(s, 5) for s in sums] == [1.0, 0.0, 0.0, 1.0]
    assert len(slots) == first[-1]
