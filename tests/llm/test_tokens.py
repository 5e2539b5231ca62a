"""Token files, separator scan and packing against the tokenizers library and brute force."""

import itertools
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline.llm import packing, token_counts, token_output, tokens
from plumbline.sources.shared import new_path

TEXTS = [
    "It's  the\n\n end,\tof 12 days' — naïve café № ½ 你好 🙂",
    "",
    None,
    "Éloïse't the 'tis we'll\r\n x y  ",
    "<|endoftext|> inside <|endoftext|>",
    "word " * 3000,
    "ß×÷ſ ½ ١٢ _under_score_ a_b",
    "!!! ??? \x1c\x1d end",
    "!",
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary())


def test_encoder_equals_the_library(library):
    got = tokens.Encoder.of(tokens.vocabulary()).encode(TEXTS)
    for text, raw in zip(TEXTS, got, strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids


def test_encoder_forgets_and_stays_right(library, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_PIECES", 40)
    encoder = tokens.Encoder(tokens.vocabulary())
    texts = [" ".join(f"{a}{b}{k}" for k in range(7)) for a, b in itertools.product("abcdef", repeat=2)]
    for k in range(0, len(texts), 3):
        for t, raw in zip(texts[k : k + 3], encoder.encode(texts[k : k + 3]), strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_columns_equal_the_library(library, monkeypatch):
    """Texts of hostile characters, whole columns at once: cuts at texts' borders, long pieces, forgetting in between."""
    monkeypatch.setattr(tokens, "MOST_PIECES", 300)
    monkeypatch.setattr(tokens, "MOST_IDS", 2000)
    encoder = tokens.Encoder(tokens.vocabulary())
    signs = ["'", "'s", "'re", "'ll", "'LL", "s", "t", "re", "d", "A", "é", "Ž", "ſ", "×", "½", "\u0149", " ", " ", "  ", "\n", "\t", "\r\n", "\x00", "\x1c", "7", "!", "_", "-" * 17, "x" * 16, "\u00a0", "你"]
    rng = np.random.default_rng(3)
    for plain in (True, False) * 20:
        some = [s for s in signs if not plain or s.isascii() or s in "éŽ\u0149"]
        texts = ["".join(rng.choice(some, rng.integers(0, 12))) for _ in range(60)] + [None, "'", "s", "<|endoftext|>" if not plain else ""]
        ids, counts = encoder.encode_column(pa.array(texts), 7)
        want = [library.encode(t or "", add_special_tokens=False).ids + [7] for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]
    assert encoder.n <= 300
    assert [len(x) for x in encoder.encode_column(pa.array([], pa.string()), 0)] == [0, 0]


def docs(spark):
    return spark.createDataFrame([(20 - k, t, "x") for k, t in enumerate(TEXTS)] + [(20, "twice", "x"), (None, "no id", "x")], "doc_id long, text string, ids string")


def test_token_files(spark, library):
    path = new_path(spark, "tokens")
    token_output.write_tokens(docs(spark), path, tokens.vocabulary(), end_id=0, files=3)
    want, start = [], 0
    rows = sorted(((-1 if r.doc_id is None else r.doc_id, r.text) for r in docs(spark).collect()), key=lambda r: (r[0], r[1] is not None, r[1] or ""))
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_output.read_digests(spark, path).collect())
    assert got == sorted(want)
    counts = token_output.read_counts(spark, path)
    assert sorted(r.n_tokens for r in counts.collect()) == sorted(w[2] for w in want)
    assert "ids" not in counts._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    some = token_output.read_tokens(spark, path, 13, 14)
    assert {r.doc_id for r in some.collect()} == {13, 14}
    assert "GreaterThanOrEqual(doc_id,13)" in some._jdf.queryExecution().executedPlan().toString()


def test_layout_of_token_files(spark):
    """Encodings, row groups and page indexes as the footers say."""
    path = new_path(spark, "tokens")
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 300, 60))) for i in range(6000)]
    token_output.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, tokens.vocabulary(), files=1)
    (file,) = Path(path.removeprefix("file://")).glob("*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert meta.num_rows == 6000 and 1 <= meta.num_row_groups <= 3
    columns = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    ids = next(c for name, c in columns.items() if name.startswith("ids"))
    assert {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & set(ids.encodings) and ids.compression == "ZSTD"
    for name in ("doc_id", "place"):
        assert "DELTA_BINARY_PACKED" in columns[name].encodings or "RLE_DICTIONARY" in columns[name].encodings
        assert columns[name].has_offset_index and columns[name].has_column_index


def test_token_files_of_nothing(spark):
    path = new_path(spark, "tokens")
    token_output.write_tokens(docs(spark).where("false"), path, tokens.vocabulary())
    assert token_output.read_digests(spark, path).count() == 0


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 19])
def test_scan_stitches_blocks(spark, block, library):
    path, end = new_path(spark, "flat"), 50256
    texts = [t for t in TEXTS if not t or "<|" not in t]
    token_counts.write_flat(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), path, tokens.vocabulary(), end)
    found = token_counts.count_tokens(token_counts.scan_blocks(spark, f"{path}/kind=tokens", end, block_ids=max(block, 50) if block > 1 else 64)).orderBy("file", "ordinal").collect()
    lengths = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r.n_tokens for r in found] == lengths
    assert [r.start for r in found] == [sum(lengths[:k]) + k for k in range(len(lengths))]
    assert all(r.closed for r in found)


def test_counts_are_named(spark, library, monkeypatch):
    """Null, repeated and many ids, several files a task, clashing columns."""
    monkeypatch.setattr(token_counts, "FILE_DOCS", 7)
    texts = [t for t in TEXTS if not t or "<|" not in t]
    rows = [(k * 10, texts[k % len(texts)], "x", 1) for k in range(40)] + [(None, "no id here", "x", 1), (None, None, "x", 1), (5, "twice", "x", 1), (5, "twice", "x", 1), (5, "very long " * 30_000, "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string, value int").repartition(3)
    path = new_path(spark, "flat")
    token_counts.write_flat(df, path, tokens.vocabulary(), 50256)
    counts = token_counts.count_tokens(token_counts.scan_blocks(spark, f"{path}/kind=tokens", 50256))
    got = token_counts.name_documents(counts, token_counts.read_ids(spark, path)).collect()
    assert len({r.file for r in got}) > 3 and all(r.closed for r in got)
    want = [(-1 if i is None else i, len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _, _ in rows]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens) for r in got) == sorted(want)
    path = new_path(spark, "flat")
    token_counts.write_flat(df.where("false"), path, tokens.vocabulary(), 50256)


def test_scan_small_blocks_and_open_tail(spark):
    ids = [5, 6, 9, 9, 7, 8, 8, 8, 8, 9, 4]
    rows = []
    for size in (1, 2, 3, 4, 20):
        for k in range(0, len(ids), size):
            part = ids[k : k + size]
            rows.append((f"f{size}", k // size, len(part), [j for j, x in enumerate(part) if x == 9]))
    blocks = spark.createDataFrame(rows, "file string, block long, n_ids long, ends array<long>")
    for size in (1, 2, 3, 4, 20):
        got = [(r.ordinal, r.start, r.n_tokens, r.closed) for r in token_counts.count_tokens(blocks).where(F.col("file") == f"f{size}").orderBy("ordinal").collect()]
        assert got == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 5, True), (3, 10, 1, False)]


def test_bucket_bounds_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(30):
        lengths = rng.integers(1, 30, 7)
        histogram = {int(k): int(rng.integers(1, 9)) for k in lengths}
        for k in (1, 2, 3, 9):
            cost = lambda bounds: sum((min(b for b in bounds if b >= n) - n) * c for n, c in histogram.items())  # noqa: B023, E731
            keys = sorted(histogram)
            best = min(cost((*c, keys[-1])) for m in range(min(k, len(keys))) for c in itertools.combinations(keys[:-1], m))
            assert cost(packing.bucket_bounds(histogram, k)) == best


def test_packing_keeps_every_token(spark):
    df = spark.createDataFrame([(i, n) for i, n in enumerate([1, 1, 5, 9, 10, 11, 25, 3, 3, 3])] + [(None, 4), (2, 5)], "doc_id long, n_tokens long")
    out = packing.pack(df, packing.PackingParams(max_length=10, buckets=3, budget=20)).collect()
    assert sum(r.length for r in out) == sum(r.n_tokens for r in df.collect())
    batches = {}
    for r in out:
        assert r.length <= r.bucket
        batches.setdefault((r.bucket, r.batch), []).append(r.slot)
    for (bucket, _), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and bucket * len(slots) <= max(20, bucket)
    assert packing.pack(df.where("false")).count() == 0


def test_lengths_of_null_and_empty(spark):
    got = {r.doc_id: r.n_tokens for r in packing.token_lengths(spark.createDataFrame([(1, None), (2, ""), (3, "a b")], "doc_id long, text string"), tokens.vocabulary()).collect()}
    assert got == {1: 1, 2: 1, 3: 3}
