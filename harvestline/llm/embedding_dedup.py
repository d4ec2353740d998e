"""Near-duplicate embeddings by randomised-rotation binary codes and exact recomputation.

A vector is scaled to unit length, rotated at random and reduced to the signs of its
coordinates, with one stored correction factor: the inner product of the rotated vector and
its code. `<code, q> / factor` estimates `<vector, q>` without bias, and its error is within
a known bound with a confidence that `BOUND` sets. In a cell, pairs whose upper bound stays
below the threshold are discarded; all others are recomputed in double precision.

Cells: bits of codes under further rotations, in as many tables as make a pair at the
threshold meet with probability `1 - MISS`. Bits per key follow the number of vectors, so
cells stay small. A pair is counted in the first table in which it meets. Cells emit counts
and a spanning forest, never pairs; cells over a limit become chunk pairs; equal vectors are
one representative with a weight.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with
nothing; vectors of different lengths never link; copies link with each other; repeated rows
of one vec_id count as separate vectors in n_links; float and double components are both compared in
double precision; other columns of the table are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestline.llm.support import (Scratch, connected_components, group_starts, long_array,
                                     bound_batches, split_cells, table, whole_groups)

THRESHOLD = 0.95
MISS = 1e-4        # chance that a pair exactly at the threshold shares no cell
BOUND = 5.0        # confidence bounds in standard deviations
CELL_LIMIT = 2048


def _coded_columns(element: str) -> str:
    """Columns of coded vectors; components keep the type they came in."""
    return f"vec_id long, weight long, dim int, vector array<{element}>, code binary, factor float"


def _element(vectors: DataFrame) -> str:
    return vectors.schema["vector"].dataType.elementType.simpleString()


@functools.cache
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def table_plan(count: int, threshold: float) -> tuple[int, int]:
    """Bits per key and number of tables for so many vectors."""
    bits = min(24, max(8, round(math.log2(max(count, 2))) - 4))
    same = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(MISS) / math.log(1 - same ** bits))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _by_dim(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    dims = long_array(batch["dim"])
    for dim in np.unique(dims).tolist():
        yield batch.filter(pa.array(dims == dim))


def _unit(vectors: np.ndarray) -> np.ndarray:
    # by a power of two first, which is exact: squares of very large or small doubles leave their range
    vectors = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, initial=0))[1][:, None])
    return vectors / np.sqrt((vectors * vectors).sum(1))[:, None]


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _by_dim(batch):
            unit = _unit(_matrix(part["vector"]))
            turned = unit @ rotation(unit.shape[1], 0)
            code = np.packbits(turned > 0, axis=1)
            factor = np.abs(turned).sum(1) / math.sqrt(unit.shape[1])
            yield pa.record_batch([part["vec_id"], part["weight"], part["dim"], part["vector"],
                                   pa.array([c.tobytes() for c in code], pa.binary()),
                                   pa.array(factor.astype(np.float32))],
                                  names=["vec_id", "weight", "dim", "vector", "code", "factor"])


def coded(vectors: DataFrame) -> DataFrame:
    """Representatives (least vec_id, weight) of usable vectors with code and factor.

    `vectors` has vec_id and vector.
    """
    usable = vectors.where("vector IS NOT NULL AND size(vector) > 0").where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0))
    same = usable.groupBy("vector").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("weight"))
    bound_batches(vectors.sparkSession)
    return same.select("vec_id", "weight", F.size("vector").alias("dim"), "vector").mapInArrow(
        _codes, _coded_columns(_element(vectors)))


def _keys(unit: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One key per vector and table from the signs under further rotations."""
    dim = unit.shape[1]
    signs = np.concatenate([unit @ rotation(dim, 1 + k) > 0 for k in range(-(-bits * tables // dim))], axis=1)
    signs = signs[:, :bits * tables].reshape(len(unit), tables, bits)
    return (signs << np.arange(bits)).sum(2).astype(np.int32)


def _cells(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _by_dim(batch):
            keys = _keys(_unit(_matrix(part["vector"])), bits, tables)
            every = pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * tables,
                                             pa.array(keys.ravel()))
            for t in range(tables):
                yield pa.record_batch(
                    [pa.array(np.full(len(keys), t, np.int32)), pa.array(keys[:, t]), *part.columns, every],
                    names=["cell", "key", *part.schema.names, "keys"])


def _cell_links(rows: pa.Table, threshold: float):
    """Links of one cell: per vector the weight linked first here, and a spanning forest."""
    cell, lo, hi = (int(rows[c][0].as_py()) for c in ("cell", "lo", "hi"))
    ids, chunk, weight = (rows[c].to_numpy() for c in ("vec_id", "chunk", "weight"))
    unit = _unit(_matrix(rows["vector"].combine_chunks()))
    keys = _matrix(rows["keys"].combine_chunks())
    n, dim = unit.shape
    code = np.unpackbits(np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(n, -1),
                         axis=1)[:, :dim] * np.float32(2) - np.float32(1)
    factor = rows["factor"].to_numpy()
    turned = (unit @ rotation(dim, 0)).astype(np.float32)
    error = BOUND * np.sqrt(np.maximum(1 - factor ** 2, 0) / max(dim - 1, 1)) / factor + 1e-4
    links = np.zeros(n, np.int64)
    linked = np.zeros((n, n), bool)
    for at in range(0, n, 512):
        block = slice(at, min(at + 512, n))
        estimate = code[block] @ turned.T / (math.sqrt(dim) * factor[block, None])
        maybe = estimate + error[block, None] >= threshold
        maybe &= np.arange(n)[None, :] > np.arange(at, block.stop)[:, None]
        if lo != hi:
            maybe &= chunk[block, None] != chunk[None, :]
        i, j = np.nonzero(maybe)
        for part in range(0, len(i), 200_000):
            a, b = i[part:part + 200_000] + at, j[part:part + 200_000]
            hit = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
            a, b = a[hit], b[hit]
            linked[a, b] = True
            first = (keys[a, :cell] != keys[b, :cell]).all(1) if cell else np.ones(len(a), bool)
            np.add.at(links, a[first], weight[b[first]])
            np.add.at(links, b[first], weight[a[first]])
    linked |= linked.T
    edges, left = [], np.flatnonzero(linked.any(1))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = left[linked[x, left]]
            edges += [(ids[x], ids[h]) for h in hit]
            queue += hit.tolist()
            left = np.setdiff1d(left, hit, assume_unique=True)
    return ids[links > 0], links[links > 0], edges


def _links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    names = ["a", "b", "links"]
    for rows in whole_groups(batches, ["cell", "dim", "key", "lo", "hi"], 2 * CELL_LIMIT):
        starts = group_starts(*(rows[c].to_numpy() for c in ("cell", "dim", "key", "lo", "hi")))
        for start, size in zip(starts.tolist(), np.diff(np.append(starts, rows.num_rows)).tolist()):
            if size < 2:
                continue
            ids, links, edges = _cell_links(rows.slice(start, size), threshold)
            if len(ids):
                yield pa.record_batch([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(links)], names=names)
            if edges:
                pairs = np.array(edges, np.int64)
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1]),
                                       pa.array(np.zeros(len(pairs), np.int64))], names=names)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of `vectors` (vec_id, vector)."""
    if _element(vectors) not in ("float", "double"):
        vectors = vectors.withColumn("vector", F.col("vector").cast("array<double>"))
    scratch = Scratch(vectors.sparkSession, "embeddings")
    reps = scratch.write(coded(vectors), "coded")
    bits, tables = table_plan(reps.count(), threshold)
    cells = reps.mapInArrow(lambda b: _cells(b, bits, tables), f"cell int, key int, {_coded_columns(_element(vectors))}, keys array<int>")
    cells = split_cells(cells, ["cell", "dim", "key"], "vec_id", CELL_LIMIT)
    order = ["cell", "dim", "key", "lo", "hi"]
    found = scratch.write(
        cells.repartition(*order).sortWithinPartitions(*order)
        .mapInArrow(lambda b: _links(b, threshold), "a long, b long, links long"), "links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("b IS NOT NULL").select("a", "b"), scratch, "parts")
    known = (reps.select(F.col("vec_id").alias("rep"), "weight", "vector").join(counts, "rep", "left")
             .join(parts, F.col("rep") == F.col("node"), "left")
             .select("vector", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                     F.coalesce("component", "rep").alias("component_id")))
    rows = vectors.select("vec_id", "vector").join(known, "vector", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                       component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")))


SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
), reach AS (
  SELECT DISTINCT a AS vec_id, a AS other FROM links
  UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
       e.vec_id = coalesce(c.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
