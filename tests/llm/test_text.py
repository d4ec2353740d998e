"""Tokens, pieces, packing, sketches and the classifier against libraries and brute force."""

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from harvestline.llm import packing, pieces_fst, quality_cnn, sketch, token_files, tokens
from harvestline.llm.support import Scratch

SF = "/root/testdata/sf0.001"
ODD = ["", " ", "  a   b ", "\n \nx", "x \ny", "a  b  c", "it's  'll don't", "日本 語  テ", "<|endoftext|> x",
       "a" * 5000, "x\x1c y \x85z", "😀 😀", "def f(x):\n        return  x\n\n\n", "<s> <0x09>", "▁x ▁▁", " " * 40 + "z"]
ROWS = [(3, "b b b"), (1, None), (1, None), (None, "null id"), (7, "word " * 3000), (5, "")]


@pytest.fixture(scope="module")
def texts():
    return pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() + ODD


def test_ids_equal_the_library(texts):
    own = tokens.Encoder(tokens.default_path())
    for start in (0, 100):
        for text, raw in zip(texts[start:], own.encode(texts[start:])):
            assert np.frombuffer(raw, "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_strings_of_added_tokens_equal_a_fresh_library(texts):
    """As the library reads them when loaded from the file, wherever they stand."""
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokens.default_path())
    odd = ["end.<|endoftext|>Next", "<|endoftext|>", "a <|endoftext|>  b", "x<|endoftext|><|endoftext|> y ", "<|endoftext", "a <|end oftext|>"]
    mixed = texts + odd + texts[:50]
    for text, raw in zip(mixed, tokens.Encoder(tokens.default_path()).encode(mixed)):
        assert np.frombuffer(raw, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(library.encode(odd[0], add_special_tokens=False).ids) == 4


def test_forgetting_parts_changes_nothing(texts, monkeypatch):
    want = tokens.Encoder(tokens.default_path()).encode(texts)
    monkeypatch.setattr(tokens, "MEMORY_PARTS", 50)
    own = tokens.Encoder(tokens.default_path())
    assert [own.encode([t])[0] for t in texts] == want


def slow_ids(text, end):
    own = tokens.encoder(tokens.default_path())
    return own.tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def test_token_files(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumn("start", F.lit("clash"))
    target = str(tmp_path / "ids")
    token_files.write_tokens(docs.repartition(3), target, tokens.default_path())
    got = sorted(map(tuple, token_files.digest(token_files.read_tokens(spark, target)).collect()), key=lambda r: r[1])
    at, want = 0, []
    for doc_id, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = slow_ids(text, 0)
        want.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_token_file_layout(spark, tmp_path):
    """Delta-coded metadata, dictionary ids, page indexes, ascending row groups, selective reads."""
    target = tmp_path / "ids"
    token_files.write_tokens(spark.read.parquet(f"{SF}/documents.parquet"), str(target), tokens.default_path())
    last = -1
    for path in sorted(target.glob("part-*.parquet")):
        meta = pq.ParquetFile(path).metadata
        for g in range(meta.num_row_groups):
            columns = {meta.row_group(g).column(c).path_in_schema: meta.row_group(g).column(c) for c in range(meta.num_columns)}
            assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
            assert "RLE_DICTIONARY" in next(c for p, c in columns.items() if p.startswith("ids")).encodings
            assert columns["doc_id"].has_offset_index and columns["doc_id"].has_column_index
            assert columns["doc_id"].statistics.min > last
            last = columns["doc_id"].statistics.max
    plan = spark.read.schema(token_files.SCHEMA).parquet(str(target)).where("doc_id = 5").select("n_tokens")
    text = plan._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)" in text and "ids" not in text.split("ReadSchema")[-1]


def test_no_documents(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_tokens(none, str(tmp_path / "ids"), tokens.default_path())
    assert token_files.digest(token_files.read_tokens(spark, str(tmp_path / "ids"))).collect() == []
    assert packing.pack_documents(none, tokens.default_path()).collect() == []
    assert sketch.fingerprint_documents(none).collect() == []
    assert pieces_fst.encode_documents(none, pieces_fst.default_path()).collect() == []


def check_packed(rows, lengths, capacity):
    p = pd.DataFrame([r.asDict() for r in rows]).sort_values(["sequence_id", "offset"])
    assert (p.groupby("sequence_id").length.cumsum() - p.length == p.offset).all()
    assert p.groupby("sequence_id").length.sum().max() <= capacity
    assert sorted(p.length) == sorted(lengths)
    return p.sequence_id.nunique()


def test_packing_pieces_and_sequences(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(
        [(r[0] if r[0] is None else r[0] + 1000, r[1]) for r in ROWS], "doc_id long, text string"))
    want = []
    for r in docs.collect():
        ids = slow_ids(r.text, 2)
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
                 for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    rows = packing.pack_documents(docs.repartition(6), tokens.default_path()).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == sorted(want, key=str)
    used = check_packed(rows, [w[3] for w in want], 1024)
    assert used <= 1.02 * sum(w[3] for w in want) / 1024 + 1


@pytest.mark.parametrize("low, high", [(1, 1023), (513, 1023), (1, 40), (340, 344)])
def test_packing_of_many_groups(spark, monkeypatch, low, high):
    """Several merging groups: every item placed once, about as few bins as one best-fit pass."""
    monkeypatch.setattr(packing, "GROUP_BINS", 200)
    sizes = np.random.default_rng(low).integers(low, high + 1, 3000)
    items = spark.createDataFrame([(k, 0, 0, int(n), 0) for k, n in enumerate(sizes)], packing.PIECES).repartition(12)
    used = check_packed(packing.pack(items, Scratch(spark, "test")).collect(), sizes.tolist(), 1024)
    assert used <= 1.03 * len(packing.best_fit_decreasing(sizes, 1024)) + 2


def test_sketches_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("range", F.lit(3))
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in sketch.fingerprint_documents(docs).collect()}
    assert len(got) == len(rows)
    for (d, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        changed = text[:len(text) - len(text) // 4] + after[:len(text) // 4]
        assert got[d].n_chars == len(text) and got[d].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        own = sketch.sketch(text)
        assert got[d].fingerprint == sketch.to_text(own)
        assert got[d].edited_fingerprint == sketch.to_text(sketch.sketch(changed))
        assert got[d].near_next == sketch.likeness(own, sketch.sketch(after))


def test_likeness_is_near_exact_jaccard():
    """Edited texts of every length, short ones included; the error falls with the length."""
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    errors = {}
    for text, after in zip(texts, texts[1:]):
        changed = sketch.edited(text, after)
        a, b = (np.unique(sketch.shingle_hashes(t, 5)) for t in (text, changed))
        common = len(np.intersect1d(a, b))
        exact = common / (len(a) + len(b) - common) if len(a) or len(b) else 1.0
        error = abs(sketch.likeness(sketch.sketch(text), sketch.sketch(changed)) - exact)
        errors.setdefault(sum(max(len(a), len(b)) >= n for n in (64, 256, 1024)), []).append(error)
    assert np.mean(errors[0]) < 0.05 and np.mean(errors[1]) < 0.025 and np.mean(errors[2]) < 0.015 and np.mean(errors[3]) < 0.01
    assert max(errors[1]) < 0.15 and max(errors[2]) < 0.08


def test_one_threshold_for_all_lengths():
    for n in (1, 3, 30, 3000):
        hashes = np.unique(sketch.shingle_hashes(" ".join(map(str, range(n + 4))), 5))
        own = sketch.sketch(" ".join(map(str, range(n + 4))))
        under = hashes[hashes < np.uint64(int(2**64 * sketch.FRACTION))]
        assert own.tolist() == (under if len(under) else hashes[:1]).tolist()
    assert len(sketch.sketch("")) == 0


def test_sketch_edges_and_merging(spark):
    rows = [(1, None), (4, "a b c d e f g"), (4, "a b c d e f g"), (9, "x" * 200_000), (None, "only")]
    got = sketch.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and [r.near_edited for r in got if r.doc_id == 1] == [1.0]
    assert len({r.fingerprint for r in got if r.doc_id == 4}) == 1
    words = [str(k) for k in range(4000)]
    a, b = sketch.sketch(" ".join(words[:2500])), sketch.sketch(" ".join(words[2000:]))
    assert sketch.merge(a, b).tolist() == np.union1d(a, b).tolist()
    short, long = sketch.sketch(" ".join(words[1000:1400])), sketch.sketch(" ".join(words))
    assert sketch.containment(short, long) == 1.0 and 0.05 < sketch.likeness(short, long) < 0.16
    assert sketch.from_text(sketch.to_text(a)).tolist() == a.tolist()


def test_pieces_equal_the_library(texts):
    from sentencepiece import SentencePieceProcessor
    model = pieces_fst.Transducer(pieces_fst.default_path())
    library = SentencePieceProcessor(model_file=pieces_fst.default_path())
    for text in texts:
        ids = library.encode(text)
        raw = model.encode(text)
        assert np.frombuffer(raw, "<u4").tolist() == ids, text[:80]
        assert model.decode(raw) == library.decode(ids)


def test_unigram_weights_take_the_best_score():
    """With scores as weights the path is the best of all segmentations."""
    model = pieces_fst.Transducer(pieces_fst.default_path(), merges=False)
    for part in ["▁the", "▁over", "▁xyzzy", "▁日本"]:
        ways = {0: [(0.0, [])]}
        for end in range(1, len(part) + 1):
            ways[end] = [(w + model.score[model.lexicon[part[k:end]]], p + [model.lexicon[part[k:end]]])
                         for k in range(end) if part[k:end] in model.lexicon for w, p in ways[k]]
        got = model.shortest(part)
        assert sum(model.score[i] for i in got) == max(w for w, _ in ways[len(part)])


def test_pieces_round_trip_through_spark(spark):
    rows = [(1, None), (2, "Hello  wörld\n"), (2, "Hello  wörld\n"), (None, "日本☃")]
    encoded = pieces_fst.encode_documents(spark.createDataFrame(rows, "doc_id long, text string"), pieces_fst.default_path())
    back = pieces_fst.decode_documents(encoded, pieces_fst.default_path()).collect()
    assert sorted(map(tuple, back), key=str) == sorted(((d, t or "") for d, t in rows), key=str)


@pytest.fixture(scope="module")
def fitted(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    return docs, labels, quality_cnn.train(docs, labels)


def test_held_out_accuracy(spark, fitted):
    docs, labels, model = fitted
    scored = quality_cnn.score_documents(docs.withColumn("score", F.lit("clash")), model)
    assert scored.columns == [*docs.columns, "score"]
    rows = scored.join(labels, "doc_id").where(quality_cnn._held_out()).select("quality", "score").collect()
    right = [(r.score >= quality_cnn.KEEP_FROM) == (r.quality == 1) for r in rows]
    assert len(right) > 50 and np.mean(right) > 0.9
    assert all(zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in
               docs.where(quality_cnn._held_out()).select("doc_id").collect())


def test_scores_cover_whole_texts(spark, fitted):
    """Blocks of a long text cover every chunk, and odd rows have scores."""
    model = fitted[2]
    text = "the end of a line and " * 40_000 + "OF!! ND!! INGINTI!!"
    codes = quality_cnn._padded(text.encode())
    whole = (quality_cnn._chunks(model, codes) @ model.filters).max(0) + model.offsets
    assert np.allclose(whole, quality_cnn.pooled(model, text.encode()), atol=1e-4)
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "é"), (3, "é"), (None, "abc")], "doc_id long, text string")
    scores = [r.score for r in quality_cnn.score_documents(rows, model).collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] and scores[2] == scores[3]
    assert quality_cnn.score_documents(rows.limit(0), model).collect() == []


def test_one_class_only(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(8)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(8)], "doc_id long, quality int")
    model = quality_cnn.train(docs, labels)
    assert quality_cnn.score(model, "x") > 0.9
    assert quality_cnn.score(quality_cnn.train(docs, labels.limit(0)), "x") == 0.5
