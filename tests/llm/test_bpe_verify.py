"""Speculated and verified BPE against the tokenizers library."""

import hashlib
import json
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from harvestline.llm import bpe_verify

SF = "/root/testdata/sf0.001"
PATH = bpe_verify.default_path()
ODD = ["", " ", "  a   b ", "\n \nx", "x \ny", "it's  'll don't 'S 'T''s don'treally'llx", "日本 語  テ", "<|endoftext|> x",
       "x<|endoftext|>É<|startoftext|>", "<|ENDOFTEXT|> <|endoftext", "ab" * 3000, "a" * 5000, "=" * 700 + " q",
       "x\x1c y \x85z \x00\x01", "😀 😀", "</w> a</w>b", "Å é ΑΣ İ ŸȺ ʼn ǅ", "a b　c d", "١٢ Ⅷ ½", "﷽ ﬁ", "_a_b__",
       "é Ẹ́ ́x a<|endoftext|>́", "1234567890 " * 50, "ſ ŉ ĸ ß ẞ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    alphabet = "abcdefgh XYZé'.,!?09ñß\n\tΣж日本<|>/w"
    return pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist() + ODD + [
        "".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]


def ids_of(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_ids_and_texts_equal_the_library(texts, library):
    own = bpe_verify.WordBpe(PATH)
    for start in (0, 150):
        got = [ids_of(r) for r in own.encode([t.encode() for t in texts[start:]])]
        want = [library.encode(t, add_special_tokens=False).ids for t in texts[start:]]
        assert got == want
        flat = np.array(sum(got, []), np.int32)
        decoded = own.decode(flat, np.cumsum([len(g) for g in got])).to_pylist()
        assert decoded == [library.decode(w, skip_special_tokens=False) for w in want]


def test_long_words_and_forgetting_change_nothing(texts, library, monkeypatch):
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe_verify, "LONG", 3)   # nearly every word by the heap
    assert [ids_of(r) for r in bpe_verify.WordBpe(PATH).encode([t.encode() for t in texts])] == want
    monkeypatch.setattr(bpe_verify, "MEMORY", 20)
    own = bpe_verify.WordBpe(PATH)
    assert [ids_of(own.encode([t.encode()])[0]) for t in texts] == want


def test_compatible_pairs_are_those_that_merging_keeps(library):
    """The border check against merging the joined bytes of random token pairs."""
    own = bpe_verify.WordBpe(PATH)
    sound = {i: s for s, i in ((k, v) for k, v in own.automaton.items())}
    rng = random.Random(3)
    inner = [i for i, s in sound.items() if bpe_verify.END not in s]
    every = list(sound)
    pairs = [(rng.choice(inner), rng.choice(every)) for _ in range(20_000)]
    # tokens that often meet: halves of longer tokens
    pairs += [(a, b) for a, b in zip(own.left[own.made_id].tolist(), own.right[own.made_id].tolist())][:5000]
    pairs += [(own.left[b], own.left[b]) for b in own.made_id[:3000].tolist()]
    pairs = [(int(a), int(b)) for a, b in pairs if int(a) in sound and int(b) in sound]
    good = own.compatible(*(np.array(c, np.int64) for c in zip(*pairs))).tolist()
    assert 100 < sum(good) < len(good) - 100
    for ended in (False, True):
        at = [k for k, (_, b) in enumerate(pairs) if sound[b].endswith(bpe_verify.END) == ended]
        words = [(sound[pairs[k][0]] + sound[pairs[k][1]]).rstrip(bpe_verify.END) for k in at]
        merged, ends = own._merged(words, ended)
        for k, a, b in zip(at, [0, *ends[:-1]], ends):
            assert good[k] == (merged[a:b].tolist() == list(pairs[k])), (pairs[k], merged[a:b])


def test_failing_proposals_are_few_and_found(texts):
    own = bpe_verify.WordBpe(PATH)
    words = sorted({w for t in texts for w in t.lower().split() if w.isalpha() and w.isascii()})
    ids, word, good = own.proposed(words)
    merged, ends = own._merged(words, True)
    for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends)):
        assert good[k] == (ids[word == k].tolist() == merged[a:b].tolist())
    assert 0.3 < good.mean() < 1


def test_query_columns(spark, library):
    rows = [(1, None), (1, "Hello  wOrld's"), (1, "Hello  wOrld's"), (None, "null id"), (5, ""), (6, "x " * 200_000), (7, "<|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS n_tokens", "3 AS decoded_sha256")
    got = bpe_verify.digest(bpe_verify.decode(bpe_verify.encode(docs.repartition(3), PATH), PATH)).collect()

    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe_verify.decode(bpe_verify.encode(empty, PATH), PATH).collect() == []


def test_decoding_odd_lists(spark, library):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [320, -1, 999_999, 49_407])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe_verify.decode(rows, PATH).collect()}
    assert got == {1: "", 2: "", 3: library.decode([320, 49_407], skip_special_tokens=False)}


@pytest.mark.parametrize("change", [
    {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFKC"}]}}, {"pre_tokenizer": None}, {"decoder": {"type": "ByteLevel"}}])
def test_other_kinds_of_file_are_refused(tmp_path, change):
    with open(PATH, encoding="utf-8") as file:
        described = json.load(file) | change
    path = tmp_path / "other.json"
    path.write_text(json.dumps(described), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe_verify.WordBpe(str(path))
