"""SimHash, suffix-array and embedding dedup against brute force and on edge cases."""

import hashlib
import itertools
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from harvestline.llm import embedding_dedup, simhash, suffix_dedup
from harvestline.llm.support import Scratch, connected_components

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n
    for a, b in itertools.combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {n: root(n) for n in nodes}


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(space, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    want = {d: slow_fingerprint(t) for d, t in rows.items()}
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert {d: r.fp & (2**64 - 1) for d, r in got.items()} == want
    parts = components(sorted(rows), lambda a, b: (want[a] ^ want[b]).bit_count() <= 4)
    assert {d: r.component_id for d, r in got.items()} == parts


def test_native_hash_is_the_same(spark):
    text = "one Two  three\tfour FIVE"
    words = [w.decode() for w in simhash.words_of(text)]
    shingles = [" ".join(words[i:i + 4]) for i in range(2)]
    native = [r[0] & (2**64 - 1) for r in spark.createDataFrame([(s,) for s in shingles], "s string")
              .select(F.xxhash64("s")).collect()]
    assert simhash.shingle_hashes(text).tolist() == native


@pytest.mark.parametrize("count", [2, 40_000, 1 << 26])
def test_cells_miss_no_link(count):
    """Whatever the number of cells, fingerprints within the radius share one."""
    rng = random.Random(count)
    runs, choices = simhash.cell_plan(count)
    near, refs = simhash.references()
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        pair = np.array([a, b], np.uint64)
        closer = simhash.distances(pair, near)[:, 1:] < simhash.distances(pair, near)[:, :1]
        assert any(all((closer[0, runs[k]] == closer[1, runs[k]]).all() for k in c) for c in choices)
        assert np.abs(simhash.distances(pair[:1], refs) - simhash.distances(pair[1:], refs)).max() <= 4


def test_links_of_dense_and_split_cells(spark, monkeypatch):
    """A cloud of near fingerprints and far ones, with cells small enough to be split."""
    monkeypatch.setattr(simhash, "CELL_LIMIT", 20)
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    fps = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), 3)) for _ in range(150)}
    fps |= {rng.getrandbits(64) for _ in range(100)}
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    scratch = Scratch(spark, "test")
    edges = scratch.write(simhash.link_edges(df, len(fps)), "edges")
    got = {r.node: r.component for r in connected_components(edges, scratch, "parts").collect()}
    want = components(sorted(signed), lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert {n: got.get(n, n) for n in signed} == want


def test_simhash_edge_rows(spark):
    rows = [(5, None, "en", None, 0), (3, "", None, "s", 0), (9, " \n\t", "en", "s", 3), (4, "Same words here", "en", "s", 1),
            (8, "same WORDS\there", "en", "s", 1), (8, "same WORDS\there", "en", "s", 1), (7, "x" * 300_000, "en", "s", 1)]
    got = sorted(map(tuple, simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).select("doc_id", "component_id").collect()))
    assert got == [(3, 3), (4, 4), (5, 3), (7, 7), (8, 4), (8, 4), (9, 3)]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def slow_repeats(rows):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - 49 if d is not None else 0):
            w = raw[i:i + 50]
            first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49 if d is not None else 0):
            if first[raw[i:i + 50]] < d:
                gone[i:i + 50] = b"\1" * 50
        spans = sum(1 for i in range(len(raw)) if gone[i] and (not i or not gone[i - 1]))
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digest(docs):
    return sorted(map(tuple, suffix_dedup._with_runs(docs).mapInArrow(
        suffix_dedup._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()), key=str)


def planted_rows(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdé", k=rng.randint(1, 7))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choices(words, k=n))
    passages = [prose(60)[:k] for k in (49, 50, 51, 66, 84, 85, 130, 300)]
    rows = []
    for d in range(60):
        text = prose(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            passage = rng.choice(passages)
            cut = rng.randint(0, 8)
            text += rng.choice(["", " ", "-"]) + passage[cut:len(passage) - rng.randint(0, 8)] + prose(rng.randint(0, 10))
        rows.append((d * 7 % 61, text))
    rows += [(70, rows[0][1]), (71, rows[0][1]), (72, "ab" * 400), (73, "ab" * 300), (74, "a" * 49), (75, "a" * 50),
             (76, "a" * 200), (70, rows[0][1]), (77, None), (78, ""), (None, rows[1][1]), (2, rows[5][1] + passages[-1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_equal_brute_force(spark, seed):
    rows = planted_rows(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert digest(docs) == slow_repeats(rows)


def test_repeats_across_batches(spark, monkeypatch):
    """Small batches: comparison happens in Spark's sort, not within a batch."""
    monkeypatch.setattr("harvestline.llm.support.ROWS_PER_BATCH", 2)
    rows = planted_rows(5)
    assert digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == slow_repeats(rows)


def test_repeats_of_the_tables_and_columns_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert digest(docs) == slow_repeats(rows)
    clash = docs.limit(5).withColumn("places", F.lit("x")).withColumn("name", F.lit(1)).withColumn("done", F.lit(True))
    cut = suffix_dedup.remove_repeats(clash)
    assert cut.columns == clash.columns and cut.count() == 5
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def slow_embeddings(rows):
    unit = {}
    for k, (i, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, np.float32).astype(np.float64)
            unit[k] = a / np.sqrt((a * a).sum())
    links = lambda a, b: a in unit and b in unit and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95
    n = {k: sum(links(k, o) for o in range(len(rows)) if o != k) for k in range(len(rows))}
    part = components(list(range(len(rows))), links)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[part[k]] = min(least.get(part[k], i), i)
    return sorted((i, n[k], least[part[k]], i == least[part[k]]) for k, (i, _) in enumerate(rows))


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_LIMIT", 30)
    rng = np.random.default_rng(7)
    rows = [(int(i), rng.standard_normal(24).astype(np.float32).tolist()) for i in range(200)]
    base = rng.standard_normal(24)
    rows += [(1000 + i, (base + 0.12 * rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(120)]
    rows += [(2000 + i, rows[3][1]) for i in range(40)] + [(3000, [2 * x for x in rows[3][1]])]
    rows += [(4000, None), (4001, []), (4002, [0.0] * 24), (4003, [float("nan")] * 24), (4004, [None] * 24),
             (4005, [float("inf")] + [1.0] * 23), (4006, [1.0]), (4007, [1.0]), (4008, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, vector array<float>")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect())
    assert got == slow_embeddings(rows)


def test_double_components_keep_their_precision(spark):
    rng = np.random.default_rng(11)
    base = rng.standard_normal(16)
    rows = [(i, (base * scale + 1e-12 * abs(scale) * rng.standard_normal(16)).tolist())
            for i, scale in enumerate([1.0, 1e-200, 1e200, -1.0, 1e-310, 1e307])]
    rows += [(10, rng.standard_normal(16).tolist()), (11, [5e-324] + [0.0] * 15), (12, [1e308] + [0.0] * 15)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert {i: got[i] for i in (0, 1, 2, 4, 5)} == {i: (4, 0) for i in (0, 1, 2, 4, 5)}
    assert got[3] == (0, 3) and got[10] == (0, 10) and got[11] == (1, 11) and got[12] == (1, 11)
    whole = spark.createDataFrame([(1, [3, 4]), (2, [6, 8]), (3, [-4, 3])], "vec_id long, vector array<int>")
    assert [r.n_links for r in embedding_dedup.near_duplicates(whole).orderBy("vec_id").collect()] == [1, 1, 0]


def test_no_embeddings(spark):
    empty = spark.createDataFrame([], "vec_id long, vector array<float>")
    assert embedding_dedup.near_duplicates(empty).collect() == []


def test_estimates_are_unbiased():
    rng = np.random.default_rng(1)
    a = rng.standard_normal(64)
    a /= np.linalg.norm(a)
    errors = []
    for k in range(200):
        q = 0.8 * a + 0.2 * rng.standard_normal(64)
        q /= np.linalg.norm(q)
        turn = embedding_dedup.rotation(64, k)
        x, y = a @ turn, q @ turn
        factor = np.abs(x).sum() / 8
        error = np.sign(x) @ y / 8 / factor - a @ q
        assert abs(error) <= embedding_dedup.BOUND * np.sqrt((1 - factor**2) / 63) / factor
        errors.append(error)
    assert abs(np.mean(errors)) < 0.02
