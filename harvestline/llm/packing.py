"""Hierarchical best-fit packing of token pieces into sequences of fixed length.

Pieces that fill a sequence are sequences already. The rest are packed best-fit decreasing
inside each partition; nearly full bins are emitted, underfull bins become items of fewer,
larger groups and are packed again, until a round over one group, or `IDLE_ROUNDS` over several
differently mixed ones, saves no bin. Where a group
would need fewer bins without keeping its underfull bins together, they are opened. A group
holds a bounded number of bins, so no task grows with the data.

Defined cases: null text is empty and yields the end id alone; repeated rows are packed as
often as they occur; no documents give no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestline.llm import tokens
from harvestline.llm.support import Scratch, bound_batches, table

CAPACITY = 1024
END_ID = 2
SLACK = 4                # a bin with no more room than this is nearly full
GROUP_BINS = 100_000     # bins one merging task holds
FAN_IN = 8               # groups merged into one per round
IDLE_ROUNDS = 3          # rounds in a row over several groups that save nothing and end the merging
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"
MEMBER = "struct<doc_id:long,piece:int,start:long,length:int,ids_crc32:long>"
BINS = f"full boolean, total int, members array<{MEMBER}>"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int):
    for batch in batches:
        out: list[tuple] = []
        ids, ends = tokens.encoder(path).encode_column(batch["text"])
        raw = memoryview(np.insert(ids, ends, end_id).view(np.uint8))
        at = 0
        for doc, end in zip(batch["doc_id"].to_pylist(), (ends + np.arange(1, len(ends) + 1)).tolist()):
            n = end - at
            first = n % capacity or capacity
            cuts = [0, *range(first, n + 1, capacity)]
            out += [(doc, k, a, b - a, zlib.crc32(raw[4 * (at + a):4 * (at + b)]))
                    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
            at = end
        yield pa.record_batch([pa.array(c, t) for c, t in zip(
            zip(*out) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))],
            names=["doc_id", "piece", "start", "length", "ids_crc32"])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Cut the ids of each text plus `end_id`: one row per piece, a short first one if any."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda batches: _pieces(batches, path, capacity, end_id), PIECES)


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Item numbers of each bin. Free capacities in use are bits of one integer."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[item])
        wide = rooms >> size
        if wide:
            room = size + (wide & -wide).bit_length() - 1
            stack = by_room[room]
            at = stack.pop()
            if not stack:
                rooms &= ~(1 << room)
            bins[at].append(item)
            left = room - size
        else:
            at, left = len(bins), capacity - size
            bins.append([item])
        if left:
            by_room.setdefault(left, []).append(at)
            rooms |= 1 << left
    return bins


def _pack(batches: Iterator[pa.RecordBatch], capacity: int, limit: int):
    """Pack bins (total, members) into fuller bins, `limit` of them at a time."""
    schema = pa.schema([("full", pa.bool_()), ("total", pa.int32()), ("members", pa.list_(pa.struct([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()),
        ("ids_crc32", pa.int64())])))])

    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        total = rows["total"].to_numpy().astype(np.int64)
        members = rows["members"].combine_chunks()
        if isinstance(members, pa.ChunkedArray):
            members = members.chunk(0)
        at = members.offsets.to_numpy()
        bins = best_fit_decreasing(total, capacity)
        if at[-1] - at[0] > len(total):  # bins as items; opened again where that saves a bin
            lengths = members.values.field("length").to_numpy()[at[0]:at[-1]].astype(np.int64)
            opened = best_fit_decreasing(lengths, capacity)
            if len(opened) < len(bins):
                bins, total, at = opened, lengths, np.arange(at[0], at[-1] + 1)
        sums = np.array([int(total[b].sum()) for b in bins], np.int32)
        take, offsets = [], [0]
        for b in bins:
            for item in b:
                take.append(np.arange(at[item], at[item + 1]))
            offsets.append(offsets[-1] + sum(int(at[i + 1] - at[i]) for i in b))
        values = members.values.take(pa.array(np.concatenate(take)))
        out = pa.Table.from_arrays([pa.array(sums >= capacity - SLACK), pa.array(sums), pa.ListArray.from_arrays(
            pa.array(np.array(offsets, np.int32)), values)], names=schema.names).cast(schema)
        yield from out.to_batches(max_chunksize=5_000)

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= limit:
            yield from packed(held)
            held, size = [], 0
    if size:
        yield from packed(held)


def pack(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY) -> DataFrame:
    """Place pieces (doc_id, piece, start, length, ids_crc32): adds sequence_id and offset."""
    bound_batches(items.sparkSession)

    def packed(bins: DataFrame) -> DataFrame:
        return bins.select("total", "members").mapInArrow(
            lambda b: _pack(b, capacity, GROUP_BINS), BINS)

    single = items.select(F.col("length").alias("total"), F.array(F.struct(
        "doc_id", "piece", "start", "length", "ids_crc32")).alias("members"))
    whole = single.where(F.col("total") >= capacity).select(F.lit(True).alias("full"), "total", "members")
    level = scratch.write(packed(single.where(F.col("total") < capacity)), "bins-0")
    done = [whole, level.where("full")]
    bins, groups, step, idle = level.where("NOT full"), None, 0, 0
    count = bins.count()
    while count:
        groups = -(-count // GROUP_BINS) if groups is None else max(-(-groups // FAN_IN), -(-count // GROUP_BINS))
        step += 1
        first = F.element_at("members", 1)
        mixed = bins.repartition(groups, F.xxhash64(first["doc_id"], first["piece"], F.lit(step)))
        level = scratch.write(packed(mixed), f"bins-{step}")
        done.append(level.where("full"))
        bins = level.where("NOT full")
        left, emitted = bins.count(), level.where("full").count()
        saved = count - left - emitted
        count = left
        # with one group a round sees all bins; with more, another mixture may still save some
        idle = idle + 1 if saved <= 0 else 0
        if idle and (groups == 1 or idle == IDLE_ROUNDS):
            break
    done.append(bins)
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    placed = every.select(F.monotonically_increasing_id().alias("sequence_id"), "members").select(
        "sequence_id", F.expr(
            "transform(members, (m, i) -> struct(m.doc_id, m.piece, m.start, m.length, m.ids_crc32, cast(aggregate(slice(members, 1, i), 0L, "
            "(s, x) -> s + x.length) as long) AS offset))").alias("members"))
    return placed.select("sequence_id", F.explode("members").alias("m")).select(
        "m.doc_id", "m.piece", "m.start", F.col("m.length").cast("long").alias("length"), "m.ids_crc32",
        "sequence_id", "m.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Tokenise once into a table of pieces, then pack the pieces."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.write(pieces(docs, path, capacity, end_id), "pieces"), scratch, capacity)


def query(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), tokens.default_path())
