"""URL filters, sharding and the pipeline."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from harvestline.llm import QUERIES, SQL, packing, pieces_fst, sharding, simhash, suffix_dedup, tokens, url_filter
from harvestline.llm.support import Scratch
from tests.llm.test_dedup import slow_repeats

SF = "/root/testdata/sf0.001"
PAGES = "page_id long, url string, html string"


def canonical(url):
    return f'<head><link rel="canonical" href="{url}"></head>'


def test_aliases_and_precedence(spark):
    rows = [
        (1, "http://a.com/x", canonical("https://www.bad.net/y")),           # alias of a blocked url
        (2, "http://b.com/x", '<META content="0; URL=http://a.com/x#top" http-equiv=refresh>'),  # two steps away
        (3, "http://example.net/en/1", canonical("http://bad.net/")),        # explicit allow of its own
        (4, "http://c.com/q?a=1&b=2", "<link href='http://d.com/' rel='canonical'>"),
        (5, "http://e.com/dir/p", canonical("other.html")), (6, "http://e.com/dir/other.html", canonical("//bad.net/z")),
        (7, None, canonical("http://bad.net/")), (8, "no-scheme/path", "x"), (9, "HTTP://X.Example.COM/de/a?b#c", None),
        (10, "http://fine.com", None), (11, "http://f.net", None), (12, "http://a.com/x", None), (12, "http://a.com/x", None),
        (13, "http://g.com/1", canonical("http://org/fr/2")),
        (14, "http://h.com/?q=1", canonical("http://bad.net/a?b=1&amp;c=2")),
    ]
    got = {}
    for r in url_filter.filter_urls(spark.createDataFrame(rows, PAGES)).collect():
        got.setdefault(r.page_id, []).append((r.host, r.path, r.rule, r.verdict, r.by))
    assert got[1] == [("a.com", "/x", None, "block", "alias")]
    assert got[2][0][3:] == ("block", "alias") and got[5][0][3:] == ("block", "alias") and got[6][0][3:] == ("block", "alias")
    assert got[3] == [("example.net", "/en/1", "example.net/en/", "allow", "rule")]
    assert got[4][0] == ("c.com", "/q", None, "allow", "default")
    assert got[7] == [("", "", None, "allow", "default")] and got[8] == got[7]
    assert got[9] == [("x.example.com", "/de/a", "example.com/de/", "block", "rule")]
    assert got[10][0][3] == "allow" and got[11] == [("f.net", "", None, "allow", "default")]
    assert got[12] == [("a.com", "/x", None, "block", "alias")] * 2 and got[13][0][3:] == ("allow", "default")
    assert got[14][0][3:] == ("block", "alias")
    assert url_filter.filter_urls(spark.createDataFrame([], PAGES)).collect() == []


def test_observed_redirects_and_long_chains(spark):
    n = 60
    rows = [(k, f"http://s{k}.com/", None) for k in range(n)]
    moves = spark.createDataFrame([(f"http://s{k}.com/", f"https://s{k + 1}.com/") for k in range(n - 1)]
                                  + [(f"http://s{n - 1}.com/", "http://end.net/"), (None, "http://x.com/")],
                                  "from_url string, to_url string")
    got = url_filter.filter_urls(spark.createDataFrame(rows, PAGES), redirects=moves).collect()
    assert {r.verdict for r in got} == {"block"} and len(got) == n


def test_main_path_has_no_python(spark):
    plan = url_filter.query(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def slow_shards(rows, limit):
    bits = {k: bin(int(hashlib.md5(str(k).encode()).hexdigest()[:16], 16))[2:].zfill(64) for k, _ in rows}

    def split(prefix, members):
        if not members:
            return {}
        total = sum(b for _, b in members)
        if total <= limit or len(members) == 1:
            return {k: (prefix, total, len(members)) for k, _ in members}
        at = len(prefix)
        return {**split(prefix + "0", [m for m in members if bits[m[0]][at] == "0"]),
                **split(prefix + "1", [m for m in members if bits[m[0]][at] == "1"])}
    return split("", rows)


@pytest.mark.parametrize("limit", [2_000, 20_000, 10**9])
def test_shards_equal_brute_force(spark, limit):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("shard", F.lit("clash"))
    rows = [(r.doc_id, len(r.text.encode())) for r in docs.collect()]
    got = {r.doc_id: (r.shard, r.shard_bytes, r.shard_rows) for r in sharding.assign(docs, limit=limit).collect()}
    assert got == slow_shards(rows, limit)


def test_deep_splits(spark, monkeypatch):
    """Levels decided two bits at a time give the same buckets."""
    monkeypatch.setattr(sharding, "STEP_BITS", 2)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, len(r.text.encode())) for r in docs.collect()]
    got = {r.doc_id: (r.shard, r.shard_bytes, r.shard_rows) for r in sharding.assign(docs, limit=9_000).collect()}
    assert got == slow_shards(rows, 9_000)


def test_one_key_splits_and_odd_rows(spark):
    rows = [(1, "x" * 100)] * 60 + [(None, None), (2, ""), (3, "y" * 5000)]
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), limit=1000).collect()
    assert len(got) == len(rows) and all(r.shard_bytes <= 1000 or r.shard_rows == 1 for r in got)
    assert sharding.assign(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_written_shards(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sharding.write_shards(docs, str(tmp_path / "s"), limit=50_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count()
    sizes = back.groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b <= 50_000 or r.n == 1 for r in sizes)


def test_written_shards_of_repeated_and_null_keys(spark, tmp_path):
    """Every row is written once, and no shard of several rows is over the limit."""
    rows = [(1, f"{k:02d}" + "x" * 98) for k in range(30)] + [(1, "same" * 25)] * 30 + [(None, "n" * 100)] * 20
    rows += [(None, None), (2, ""), (3, "y" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    sharding.write_shards(docs, str(tmp_path / "s"), limit=1000)
    back = sharding.read_shards(spark, str(tmp_path / "s"), docs.schema)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=str) == sorted(rows, key=str)
    got = sharding.digest(back).collect()
    assert all(r.shard_bytes <= 1000 or r.shard_rows == 1 for r in got) and len({r.shard for r in got}) > 5
    sharding.write_shards(docs.limit(0), str(tmp_path / "none"))
    assert sharding.digest(sharding.read_shards(spark, str(tmp_path / "none"), docs.schema)).collect() == []


def test_shard_query_reads_what_it_wrote(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sharding.query(spark, SF)
    assert any("shard=b" in f for f in got.inputFiles())
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sharding.assign(docs).collect()))


def test_pipeline_stages(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "simhash_near_dedup", "suffix_array_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    scratch = Scratch(spark, "test")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, SF), name)
        kept.append(docs)
    names = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(df.columns == names for df in kept[:3])
    groups = simhash.near_duplicates(kept[0]).collect()
    assert sorted(r.doc_id for r in kept[1].collect()) == sorted({r.component_id for r in groups})
    before = [(r.doc_id, r.text) for r in kept[1].collect()]
    want = {w[0]: w[4] for w in slow_repeats(before)}
    after = {r.doc_id: r for r in kept[2].collect()}
    whole = [r for r in after.values() if hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id]]
    assert len(whole) > 0.9 * len(after)  # the rest lost a character that was cut in two
    assert all(r.n_chars == len(r.text) for r in after.values())
    assert {r.doc_id for r in kept[3].collect()} == set(after)


def test_near_copy_stage_edges(spark):
    rows = [(5, "a b c d e", "en", "s", 9), (3, "A b c d e", "en", "s", 9), (3, "A b c d e", "en", "s", 9), (None, "a b c d e", "en", "s", 9)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = corpus_pipeline.drop_near_copies(spark, docs, SF).select("doc_id").collect()
    assert sorted((r[0] for r in got), key=str) == [3, None]


def test_texts_of_one_id_are_judged_by_their_own_groups(spark):
    """Of one id, the copy of another document goes and the unique texts stay."""
    rows = [(3, "a b c d e f g"), (5, "A b c d e f g"), (5, "z unique text of five"), (5, "y another one of five"),
            (5, "Y another one of five"), (5, None), (8, "")]
    docs = spark.createDataFrame([(k, t, "en", "s", 9) for k, t in rows], spark.read.parquet(f"{SF}/documents.parquet").schema)
    got = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert got.columns == docs.columns
    texts = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert len(texts) == 4 and {rows[0], rows[2], (5, None)} <= set(texts) and (set(rows[3:5]) & set(texts))


CLASHES = ("_doc", "_mark", "_group", "_places", "_counts", "score", "shard", "shard_", "Bits", "bytes", "prefix", "depth", "row",
           "key", "mark", "id", "fp", "component", "component_id", "places", "counts", "total", "members", "full", "ids", "start",
           "keys", "node", "host", "verdict", "by")


def clashing(df):
    taken = {c.lower() for c in df.columns}
    return df.selectExpr("*", *[f"'{c}' AS `{c}`" for c in CLASHES if c.lower() not in taken])


def test_pipeline_on_clashing_names_and_empty_tables(spark):
    """Extra columns pass the stages unchanged and change no decision."""
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    docs, wide = plain, clashing(plain)
    scratch = Scratch(spark, "test")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, SF), name)
        wide = scratch.write(stage(spark, wide, SF), f"{name}-wide")
        assert wide.columns == clashing(plain).columns
        assert sorted(map(tuple, wide.select(*plain.columns).collect())) == sorted(map(tuple, docs.collect()))
    row = wide.first()
    assert all(row[c] == c for c in CLASHES if c not in plain.columns)
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, wide, SF).count() == last(spark, docs, SF).count()
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, plain.limit(0), SF).collect() == []


def test_operators_on_clashing_names(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = clashing(docs)
    sharding.write_shards(wide, str(tmp_path / "shards"))
    back = sharding.read_shards(spark, str(tmp_path / "shards"), wide.schema)
    assert sorted(map(tuple, sharding.digest(back).collect())) == sorted(map(tuple, sharding.assign(docs).collect()))
    assert sorted(map(tuple, back.select(*wide.columns).collect())) == sorted(map(tuple, wide.collect()))
    for run in (simhash.near_duplicates, lambda d: packing.pieces(d, tokens.default_path()),
                lambda d: pieces_fst.encode_documents(d, pieces_fst.default_path()), sharding.assign):
        assert sorted(map(tuple, run(wide).collect())) == sorted(map(tuple, run(docs).collect()))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert sorted(map(tuple, url_filter.filter_urls(clashing(pages)).select("page_id", "verdict").collect())) == sorted(
        map(tuple, url_filter.filter_urls(pages).select("page_id", "verdict").collect()))


def test_every_operator_has_a_query():
    assert [int(k[2:].split("_")[0]) for k in QUERIES] == list(range(1, 14)) and set(SQL) <= set(QUERIES)


def test_cut_in_two_characters_go(spark):
    raw = "é" * 40
    assert suffix_dedup.without(raw.encode(), [(1, 60)]).decode("utf-8", "ignore") == "é" * 10
