"""SimHash near-duplicates found through tables of distances to reference fingerprints.

Every distinct fingerprint gets its Hamming distances to many reference fingerprints: a
base, the 64 neighbours of the base that differ from it in one bit, and random ones. By the
triangle inequality two fingerprints within r bits differ by at most r in every coordinate.

* Candidates: `distance to neighbour i - distance to base` is +1 or -1. Cut into B runs of
  coordinates, two fingerprints within r agree in at least B - r whole runs. Each choice of
  B - r runs is a cell key, so every linked pair meets in some cell. B grows with the number
  of fingerprints so that cells stay small; the result is exact for every B.
* Pairs in a cell whose random-reference coordinates differ by more than r are discarded.
* Survivors are verified on the fingerprints themselves.

Cells emit a spanning forest of their links, never all pairs: a fingerprint reached once is
not compared again, so a dense cell costs about its size. Cells over a limit become chunk
pairs. Equal fingerprints are collapsed before anything else.

Defined cases: null or wordless text has fingerprint zero and links like any other; repeated
rows share a component; rows with a null doc_id link, but a component of such rows alone has a
null id; no documents give no rows. Only doc_id and text are read, so other columns may have any
name.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestline.llm.support import (Scratch, connected_components, group_starts, long_array,
                                     bound_batches, signed, split_cells, table,
                                     texts_of, whole_groups)

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
RANDOM_REFERENCES = 16
CELL_LIMIT = 4096
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words_of(text: str) -> list[bytes]:
    """Words of a text as UTF-8, A-Z lower-cased."""
    return [w for w in _SPACES.split(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if w]


def shingle_hashes(text: str, size: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of every shingle, repeats included; a shorter text is one shingle."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    last = (ends[size - 1:] - 1).tolist() or [len(joined)]
    one = xxhash.xxh64_intdigest
    return np.array([one(joined[a:b], seed) for a, b in zip(starts, last)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit k is 1 if set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        block = np.ascontiguousarray(hashes[at:at + 65_536], "<u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(shingle_hashes(t)) for t in texts_of(batch["text"])], np.uint64)
        yield pa.record_batch([batch["doc_id"], pa.array(signed(values))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) with the unsigned fingerprint stored in a long."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _fingerprints, "doc_id long, fp long")


def _marked_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array([fingerprint(shingle_hashes(t)) for t in texts_of(batch["text"])], np.uint64)
        yield pa.record_batch([batch["id"], batch["mark"], pa.array(signed(fps))], names=["doc_id", "mark", "fp"])


def references(count: int = RANDOM_REFERENCES) -> tuple[np.ndarray, np.ndarray]:
    """Base followed by its 64 neighbours, and `count` random references."""
    rng = np.random.default_rng(20240229)
    base = rng.integers(0, 2**64, dtype=np.uint64)
    near = np.concatenate([[base], base ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))])
    return near, rng.integers(0, 2**64, count, dtype=np.uint64)


def distances(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int8)


def cell_plan(count: int, radius: int = RADIUS) -> tuple[list[np.ndarray], list[tuple[int, ...]]]:
    """Runs of coordinates and the choices of runs that make cell keys for so many rows."""
    wanted = max(1, math.ceil(math.log2(max(count, 2))) - 2)
    blocks = radius + 1
    while blocks < 3 * radius and (blocks - radius) * 64 // blocks < wanted:
        blocks += 1
    return np.array_split(np.arange(64), blocks), list(itertools.combinations(range(blocks), blocks - radius))


def _cells(batches: Iterator[pa.RecordBatch], count: int, radius: int) -> Iterator[pa.RecordBatch]:
    runs, choices = cell_plan(count, radius)
    near, _ = references()
    for batch in batches:
        fps = long_array(batch["fp"])
        for at in range(0, len(fps), 4_096):
            part = fps[at:at + 4_096]
            table_ = distances(part.view(np.uint64), near)
            closer = (table_[:, 1:] < table_[:, :1]).astype(np.uint64)
            keys = [(closer[:, r] << np.arange(len(r), dtype=np.uint64)).sum(1, dtype=np.uint64) for r in runs]
            for number, choice in enumerate(choices):
                key = np.zeros(len(part), np.uint64)
                for run in choice:
                    key = (key << np.uint64(len(runs[run]))) | keys[run]
                yield pa.record_batch([pa.array(np.full(len(part), number, np.int32)), pa.array(signed(key)),
                                       pa.array(part)], names=["cell", "key", "fp"])


def _forest(fps: np.ndarray, coordinates: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect whatever is connected within one cell."""
    edges: list[tuple[int, int]] = []
    left = np.arange(len(fps))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = left[np.abs(coordinates[left] - coordinates[x]).max(1) <= radius]
            hit = near[np.bitwise_count(fps[near] ^ fps[x]) <= radius]
            if len(hit):
                edges += [(int(fps[x]), int(fps[h])) for h in hit]
                queue += hit.tolist()
                left = np.setdiff1d(left, hit, assume_unique=True)
    return edges


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    _, refs = references()
    for rows in whole_groups(batches, ["cell", "key", "lo", "hi"]):
        cell, key, lo, hi = (rows[c].to_numpy() for c in ("cell", "key", "lo", "hi"))
        fps = rows["fp"].to_numpy().astype(np.int64).view(np.uint64)
        starts = group_starts(cell, key, lo, hi)
        sizes = np.diff(np.append(starts, len(fps)))
        a, b = [], []
        small = np.repeat(sizes <= 12, sizes)
        group = np.repeat(np.arange(len(starts)), sizes)
        several = np.flatnonzero(small & np.repeat(sizes > 1, sizes))
        f, g = fps[several], group[several]
        table_ = distances(f, refs)
        for step in range(1, 12):
            i = np.flatnonzero(g[:-step] == g[step:]) if len(g) > step else np.zeros(0, np.int64)
            if not len(i):
                break
            i = i[np.abs(table_[i] - table_[i + step]).max(1) <= radius]
            i = i[np.bitwise_count(f[i] ^ f[i + step]) <= radius]
            a.append(f[i])
            b.append(f[i + step])
        for k in np.flatnonzero(sizes > 12).tolist():
            part = np.unique(fps[starts[k]:starts[k] + sizes[k]])
            found = _forest(part, distances(part, refs), radius)
            if found:
                pairs = np.array(found, np.uint64)
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        if sum(map(len, a)):
            yield pa.record_batch([pa.array(signed(np.concatenate(a))), pa.array(signed(np.concatenate(b)))],
                                  names=["a", "b"])


def link_edges(fps: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """(a, b) over distinct fingerprints: enough links to connect all within `radius` bits."""
    bound_batches(fps.sparkSession)
    cells = fps.select("fp").mapInArrow(lambda b: _cells(b, count, radius), "cell int, key long, fp long")
    # one partition per cell key; a cell over the limit arrives as several chunk pairs
    cells = split_cells(cells, ["cell", "key"], "fp", CELL_LIMIT)
    return (cells.repartition("cell", "key", "lo", "hi").sortWithinPartitions("cell", "key", "lo", "hi")
            .select("cell", "key", "lo", "hi", "fp")
            .mapInArrow(lambda b: _links(b, radius), "a long, b long"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component (a group of linked fingerprints) and component_id, its least doc_id."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.write(fingerprints(docs), "fps")
    return marked.join(_groups(marked, radius, scratch), "fp").select("doc_id", "fp", "component", "component_id")


def _groups(marked: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(fp, component, component_id) of every distinct fingerprint."""
    distinct = scratch.write(marked.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "distinct")
    edges = scratch.write(link_edges(distinct, distinct.count(), radius), "edges")
    parts = connected_components(edges, scratch, "parts")
    named = distinct.join(parts, distinct["fp"] == parts["node"], "left").select(
        "fp", "first_doc", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
    return scratch.write(named.join(least, "component").select("fp", "component", "component_id"), "by_fp")


def first_of_each_group(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` without near-duplicates: of every group one row with the least doc_id.

    Each text is judged by its own fingerprint, also where texts share a doc_id; of several
    rows of a group with its least doc_id the one with the least digest stays. Rows without a
    doc_id have no least one and pass. Columns may have any name.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    bound_batches(docs.sparkSession)
    # digests of text and row travel with the id; texts are joined back once
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"),
                       F.md5(F.to_json(F.struct(*docs.columns))).alias("mark"))
    marked = scratch.write(rows.select("id", "mark", F.col("row.text").alias("text")).mapInArrow(
        _marked_fingerprints, "doc_id long, mark string, fp long"), "fps")
    kept = (marked.join(_groups(marked, radius, scratch), "fp").where("doc_id = component_id")
            .groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("one"))
            .select(F.col("one.doc_id").alias("kept_id"), F.col("one.mark").alias("kept_mark")))
    found = rows.join(kept, (F.col("id") == F.col("kept_id")) & (F.col("mark") == F.col("kept_mark")))
    return (found.dropDuplicates(["id", "mark"]).select("row.*")  # rows equal in every column
            .unionByName(docs.where("doc_id IS NULL")))


def query(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
