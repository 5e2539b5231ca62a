"""Fingerprints, decontamination and the pipeline on small corpora."""

import hashlib
import random

import numpy as np

import corpus_pipeline
from plumbline.llm import decontamination, fingerprint


def shingles(text, size=5):
    w = text.encode().lower().split()
    return {b" ".join(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({b" ".join(w)} if w else set())


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def test_edited_pairs(spark):
    rng = random.Random(2)
    texts = [prose(rng, rng.choice([0, 1, 3, 40, 120])) for _ in range(60)] + ["", "𝄞 é 𝄞", prose(rng, 20_000)]
    ids = rng.sample(range(1000), len(texts))
    df = spark.createDataFrame([(i, None if not t else t) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in fingerprint.edited_pairs(df).collect()}
    assert len(got) == len(texts)
    order = sorted(zip(ids, texts, strict=True))
    errors = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(t) // 2
        edited = t[: len(t) - cut] + after[:cut]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for said, other in ((got[i].near_edited, edited), (got[i].near_next, after)):
            a, b = shingles(t), shingles(other)
            errors.append(said - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.abs(errors).max() < 0.25 and np.std(errors) < 0.06


def test_equal_texts_have_equal_fingerprints(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "other"), (None, "a b c d e f")], "doc_id long, text string")
    rows = fingerprint.edited_pairs(df).collect()
    assert len(rows) == 4 and len({r.fingerprint for r in rows}) == 2
    assert fingerprint.edited_pairs(df.where("false")).count() == 0
    alone = fingerprint.edited_pairs(df.where("doc_id = 1")).first()
    assert alone.near_next == 1.0


def test_common_length_is_exact():
    rng = np.random.default_rng(4)
    for _ in range(60):
        a, b = rng.integers(0, 6, rng.integers(0, 20)), rng.integers(0, 6, rng.integers(0, 20))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontamination.common_length(a, b) == table[-1, -1]


def corpus(seed=8):
    rng = random.Random(seed)
    items = [(k, prose(rng, rng.choice([15, 22, 30, 55, 90]))) for k in range(30)]
    docs, planted, edited = [], set(), set()
    for i in range(200):
        w = prose(rng, rng.randrange(20, 200)).split()
        if i % 5 == 0:
            k, text = rng.choice(items)
            p = text.split()
            if i % 10 == 0:
                for _ in range(len(p) // 8):
                    p[rng.randrange(len(p))] = "zz"
                edited.add((i, k))
            else:
                planted.add((i, k))
            at = rng.randrange(len(w))
            w[at:at] = p
        docs.append((i, " ".join(w)))
    return items, docs, planted, edited


def test_leaks_and_paraphrases_are_found(spark):
    items, docs, planted, edited = corpus()
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    df = spark.createDataFrame([*docs, (500, None), (501, ""), (502, docs[5][1]), (502, docs[5][1])], "doc_id long, text string").repartition(3)
    hits = [(r.doc_id, r.item_id) for r in decontamination.find_leaks(df, bench).collect()]
    assert len(hits) == len(set(hits))
    found = {h for h in hits if h[0] < 500}
    assert planted <= found
    assert len(edited & found) >= 0.9 * len(edited)
    assert found <= planted | edited
    small = decontamination.find_leaks(df, bench, decontamination.LeakParams(block=8))
    assert {(r.doc_id, r.item_id) for r in small.collect()} == set(hits)
    assert decontamination.find_leaks(df.where("false"), bench).count() == 0
    assert decontamination.find_leaks(df, bench.where("false")).count() == 0


def test_sums_of_likeness_equal_the_projection():
    """No window that reaches a passage is lost by the rounding, few others are added, and no sum overflows."""
    rng = np.random.default_rng(8)
    vectors = rng.standard_normal((50, 12)).astype(np.float32)
    targets = np.stack([vectors[rng.choice(50, k)].sum(0) for k in (1, 2, 9, 30)] + [np.zeros(12, np.float32)])
    parts, limit = decontamination.likeness(vectors, targets, 56, 0.48)
    slots, count = np.full((90, 8), 50, np.int32), rng.integers(0, 9, 90)
    for i, n in enumerate(count):
        slots[i, :n] = rng.integers(0, 50, n)
    flat = np.vstack([vectors, np.zeros((1, 12), np.float32)])
    for m in (1, 3, 7):
        sums = decontamination.run_sums(decontamination.step_sums(parts, slots, count), m)
        want = np.stack([flat[slots[i : i + m].ravel()].sum(0) @ targets.T for i in range(90 - m + 1)])
        square = (targets**2).sum(1)
        assert (sums >= limit)[:, :4][want[:, :4] >= 0.481 * square[:4]].all() and not (sums >= limit)[:, 4].any()
        close = np.abs(want[:, :4] / square[:4] - sums[:, :4] * (0.48 / limit[:4])) < 0.05 * np.abs(vectors @ targets[:4].T / square[:4]).max(0) + 0.05
        assert close.all()


def test_words_with_the_same_top_bits_are_found():
    known = decontamination.Vocabulary(np.array([5, 7, 9, 1 << 50, (1 << 50) + 3, 1 << 63], np.uint64))
    at, spot = known.find(np.array([9, 6, 1 << 63, (1 << 50) + 3, 5, (1 << 50) + 1, 7, (1 << 63) + 1, 1 << 50], np.uint64))
    assert at.tolist() == [0, 2, 3, 4, 6, 8] and known.hashes[spot].tolist() == [9, 1 << 63, (1 << 50) + 3, 5, 7, 1 << 50]


def test_edited_leak_in_many_documents_is_found(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, 40)) for k in range(12)]
    copies = {}
    for k, spots in ((0, range(0, 40, 5)), (1, range(0, 28, 2))):  # 8 of 40 words, and 14 but for the answer, are others
        copies[k] = " ".join("zz" if i in spots else w for i, w in enumerate(items[k][1].split()))
    docs, want = [], set()
    for i in range(240):
        w = prose(rng, 60).split()
        if i % 8 in copies:
            w[30:30] = copies[i % 8].split()
            want.add((i, i % 8))
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = decontamination.find_leaks(df, spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want


def test_leaks_without_an_id_are_removed(spark, tmp_path):
    items, docs, planted, _ = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leaks = {i for i, _ in planted}
    df = spark.createDataFrame([(None, docs[min(leaks)][1]), (None, docs[1][1]), (None, None), *docs], "doc_id long, text string")
    kept = corpus_pipeline.decontamination_stage(spark, df, str(tmp_path)).collect()
    assert {r.text for r in kept if r.doc_id is None} == {docs[1][1], None}
    assert not leaks & {r.doc_id for r in kept} and {1, 2, 3} <= {r.doc_id for r in kept}


def test_pipeline(spark, tmp_path):
    rng = random.Random(1)
    items, docs, planted, edited = corpus()
    rows, labels = [], []
    for i, t in docs:
        bad = i % 4 == 1
        rows.append((i, t + (" gruzzled plonkish gruzzled plonkish" if bad else ""), "en", "s", len(t)))
        labels.append((i, 1, int(bad)))
    rows += [(300 + i, rows[i][1], "en", "s", 1) for i in range(40, 60)]
    rows += [(400, "write to a@b.co about " + prose(rng, 30), "en", "s", 1), (401, None, None, None, None), (402, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "packing"]
    docs_df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = {r.doc_id for r in docs_df.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs_df, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        out = spark.read.parquet(f"{tmp_path}/stage{k}")
        if name != "packing":
            assert out.columns == docs_df.columns
        now = {r.doc_id for r in out.collect()}
        assert now <= ids
        if name == "ngram_jaccard_join":
            assert not {i for i in now if 340 <= i < 360} and {401, 402} <= now
        if name == "benchmark_decontamination":
            assert not {i for i, _ in planted} & now
        if name == "pii":
            assert out.where("doc_id = 400 and text like 'write to [EMAIL] about%'").count() == 1 and now == ids
        if name == "packing":
            assert now == ids
        docs_df, ids = out, now
    empty = docs_df.sparkSession.read.parquet(f"{tmp_path}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rng = random.Random(3)
    items = [(k, prose(rng, 40)) for k in range(5)]
    names = ["gone", "again", "leak", "spans", "sd", "sh", "h", "found", "score", "other", "node", "block", "label", "o", "size"]
    rows = [(i, prose(rng, 60) if i % 4 else "same words here for all of these rows", "en", "s", 1, *range(len(names))) for i in range(40)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names)
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert all(tuple(r)[5:] == tuple(range(len(names))) for r in out.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 40
