"""Repeated-substring removal by distributed prefix doubling over suffix positions.

Two positions are equal to depth h when the h bytes that follow them are. Ranks to depth 2h
are the sorted pairs (rank to h of a position, rank to h of the position h further on). Each
round Spark sorts such pairs at a larger offset; positions whose rank no other document
shares leave, until the depth reaches the threshold of 50 bytes.

* Depth 24 is doubled inside a task (1, 2, 4, 8, 16, 24), since those ranks are names of bytes.
  Of the positions in any 50 bytes, only the one of least name is sorted: equal strings choose
  equal positions, so no repeated string is missed, and about one position in 14 is shuffled.
* Each surviving position stands for the windows that chose it, a run of at most 27 starts.
  When the bytes around it equal those of a smaller document, all its windows are repeats;
  one occurrence per distinct surrounding (the least document) goes on.
* Depth 37: pairs (depth 24, depth 24 at 13 further on, or at 13 before). Positions that share
  such a rank stand together after the sort, and how far their bytes agree on either side
  tells which windows of depth 50 they share. Ranks of many documents are compared as windows
  instead, in one more sort, so that no group is compared pair by pair.

Rows of a task's batch that already share a rank with another document skip the comparison
and are dealt out evenly, so a passage in a third of all documents sends one row per batch
to the task of its rank. No pairs of documents are made.

Defined cases: null text is empty; documents under the threshold keep all bytes; matches never
cross documents; copies within one document, or in rows of one doc_id, stay; a row with a null
doc_id removes and loses nothing; repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestline.llm.support import (Scratch, bound_batches, group_starts, long_array, signed,
                                     table, whole_groups)

LENGTH = 50
DEPTH = 24
CHOICE = LENGTH - DEPTH + 1      # names that 50 bytes choose from
FURTHER = (LENGTH - DEPTH) // 2  # 13: either side of the position reaches depth 37
SMALL_GROUP = 32                 # rows of one rank that are compared with each other
BLOCK = 1 << 19                  # bytes named at once
_PLACE = (1 << 40) - 1           # low bits: offset in the text; above: 22 bits of its checksum
_MANY, _KNOWN = 1, 2
_U = np.uint64


# names of bytes


def _mix(x: np.ndarray) -> np.ndarray:
    x ^= x >> _U(32)
    x *= _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    return x


def _pair(left: np.ndarray, right: np.ndarray, seed: int = 0) -> np.ndarray:
    """Name of a pair of names."""
    return _mix(left * _U(0x9FB21C651E98DF25 + 2 * seed) + right)


def _names(codes: np.ndarray, seed: int = 0) -> np.ndarray:
    """Names to depth 24 of every position that has 24 bytes, by doubling."""
    x = _mix((codes.astype(_U) + _U(1 + seed)) * _U(0xD6E8FEB86659FD93))
    depth = 1
    while depth < DEPTH:
        step = min(depth, DEPTH - depth)
        x = _pair(x[:-step], x[step:], seed)
        depth += step
    return x


def _fifty(deep: np.ndarray, at: np.ndarray, seed: int = 0) -> np.ndarray:
    """Names to depth 50 from names to depth 24 at three offsets."""
    return _pair(_pair(deep[at], deep[at + FURTHER], seed), deep[at + LENGTH - DEPTH], seed)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over every `width` neighbours."""
    reach = 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[:reach - width], x[width - reach:]) if width > reach else x


class _Block:
    """Some texts end to end: their names and, once chosen, the positions of windows."""

    def __init__(self, texts: list[bytes]):
        self.lengths = np.array([len(t) for t in texts])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.codes = np.frombuffer(b"".join(texts), np.uint8)
        self.text = np.repeat(np.arange(len(texts)), self.lengths)
        self.names = _names(self.codes)

    def choose(self) -> None:
        """Mark the positions that windows inside one text choose."""
        least = _least(self.names, CHOICE)
        ends = (self.starts + self.lengths)[self.text[:len(least)]]
        self.windows = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends)
        inside = np.zeros(len(least), bool)
        inside[self.windows] = True
        least = np.where(inside, least, _U(0))
        edge = np.zeros(CHOICE - 1, _U)
        reach = ~_least(~np.concatenate([edge, least, edge]), CHOICE)
        self.chosen = np.flatnonzero(reach == self.names)
        self.least = least

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last window of each chosen position (first > last: none chose it first)."""
        s = self.windows
        k = np.searchsorted(self.chosen, s)
        todo = np.arange(len(s))
        while len(todo):
            todo = todo[self.names[self.chosen[k[todo]]] != self.least[s[todo]]]
            k[todo] += 1
        first = np.full(len(self.chosen), np.iinfo(np.int64).max)
        last = np.full(len(self.chosen), -1)
        if len(s):
            at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            first[k[at]] = s[at]
            last[k[at]] = s[np.append(at[1:], len(s)) - 1]
        return first, last


def _blocks(texts: list[bytes], rows: list[int]) -> Iterator[tuple[list[int], _Block]]:
    """Texts of at least the threshold, grouped to about BLOCK bytes, with their row numbers."""
    held, size = [], 0
    for r in rows:
        if len(texts[r]) >= LENGTH:
            held.append(r)
            size += len(texts[r])
            if size >= BLOCK:
                yield held, _Block([texts[k] for k in held])
                held, size = [], 0
    if held:
        yield held, _Block([texts[k] for k in held])


def _encoded(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the one shuffle that brings them to their positions."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.record_batch([batch["doc_id"], pa.array(list(map(pack, _encoded(batch))), pa.binary())],
                              names=["doc_id", "packed"])


def _unpacked(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _tag(raw: bytes) -> int:
    return (zlib.crc32(raw) & 0x3FFFFF) << 40


def _shared_here(names: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch: what each row need tell (0, _MANY or _KNOWN), and its least doc per name."""
    order = np.lexsort((docs, names))
    starts = group_starts(names[order])
    sizes = np.diff(np.append(starts, len(order)))
    low, high = docs[order][starts], docs[order][np.append(starts[1:], len(order)) - 1] if len(order) else docs
    kind = np.repeat(np.where(low < high, _KNOWN, 0), sizes)
    kind[starts[low < high]] = _MANY
    out, least = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    out[order] = kind
    least[order] = np.repeat(low, sizes)
    return out, least


# round 1: depth 24


def _first_depth(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = _encoded(batch), long_array(batch["doc_id"])
        names, docs, places = [], [], []
        for rows, block in _blocks(texts, list(range(len(texts)))):
            block.choose()
            p = block.chosen
            of = block.text[p]
            names.append(block.names[p])
            docs.append(ids[rows][of])
            places.append(p - block.starts[of] + np.array([_tag(texts[r]) for r in rows])[of])
        if not names:
            continue
        name, doc, place = map(np.concatenate, (names, docs, places))
        kind, _ = _shared_here(name, doc)
        name = np.where(kind == _KNOWN, _mix(place.astype(_U) + doc.astype(_U) * _U(31)), name)
        place = (place.astype(_U) | kind.astype(_U) << _U(62)).view(np.int64)
        yield pa.record_batch([pa.array(signed(name)), pa.array(doc), pa.array(place)],
                              names=["name", "doc", "place"])


def _several(starts: np.ndarray, docs: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Rows of groups that span documents, and rows known to."""
    sizes = np.diff(np.append(starts, len(docs)))
    spans = np.minimum.reduceat(docs, starts) < np.maximum.reduceat(docs, starts)
    spans |= np.maximum.reduceat((kind == _MANY).astype(np.int8), starts) > 0
    return np.repeat(spans, sizes) | (kind == _KNOWN)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, ["name"]):
        name, doc, place = (rows[c].to_numpy() for c in ("name", "doc", "place"))
        kind = (place.view(_U) >> _U(62)).astype(np.int64)
        keep = _several(group_starts(name), doc, kind)
        if keep.any():
            place = (place[keep].view(_U) & _U((1 << 62) - 1)).view(np.int64)
            yield pa.record_batch([pa.array(doc[keep]), pa.array(place)], names=["doc", "place"])


# round 2: surroundings


def _wanted(batch: pa.RecordBatch, tags: list[int]) -> list[np.ndarray]:
    """Numbers of each row's places that belong to this text."""
    places = [np.array(p, np.int64) for p in batch["places"].to_pylist()]
    return [np.flatnonzero(p >> 40 << 40 == t) for p, t in zip(places, tags)]


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name the bytes around each position: from the first to the last window that chose it."""
    for batch in batches:
        texts, ids = list(map(_unpacked, batch["packed"].to_pylist())), long_array(batch["doc_id"])
        tags = [_tag(t) for t in texts]
        places = batch["places"].to_pylist()
        wanted = [np.sort(np.array(p, np.int64)[k] & _PLACE) for p, k in zip(places, _wanted(batch, tags))]
        parts = []
        for rows, block in _blocks(texts, [r for r in range(len(texts)) if len(wanted[r])]):
            block.choose()
            first, last = block.runs()
            p = np.concatenate([wanted[r] + s for r, s in zip(rows, block.starts)])
            k = np.minimum(np.searchsorted(block.chosen, p), len(block.chosen) - 1)
            k = k[(block.chosen[k] == p) & (last[k] >= 0)]
            p, lo, n = block.chosen[k], first[k], last[k] - first[k] + 1
            of = block.text[p]
            shape = n.astype(_U) * _U(64) + (p - lo).astype(_U)
            name, twin = (_pair(_pair(_fifty(block.names, lo, seed), _fifty(block.names, lo + n - 1, seed), seed),
                                shape, seed) for seed in (0, 9))
            parts.append((name, twin, ids[rows][of],
                          lo - block.starts[of] + np.array([tags[r] for r in rows])[of], n * 32 + p - lo))
        if not parts:
            continue
        name, twin, doc, place, shape = (np.concatenate([p[c] for p in parts]) for c in range(5))
        _, least = _shared_here(name ^ _mix(twin.copy()), doc)
        done = doc > least  # a smaller document of this batch has the same surroundings
        name = np.where(done, _mix(place.astype(_U) + doc.astype(_U) * _U(31)), name)
        yield pa.record_batch([pa.array(signed(name)), pa.array(signed(twin)), pa.array(doc), pa.array(place),
                               pa.array(shape.astype(np.int32)), pa.array(done)],
                              names=["name", "twin", "doc", "place", "shape", "done"])


# shape: windows * 32 + offset of the position behind the first of them
_AROUND = "name long, twin long, doc long, place long, shape int, done boolean"


def _first_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mark rows whose surroundings a smaller document has."""
    for rows in whole_groups(batches, ["name", "twin"]):
        name, twin, doc = (rows[c].to_numpy() for c in ("name", "twin", "doc"))
        starts = group_starts(name, twin)
        least = np.repeat(doc[starts], np.diff(np.append(starts, len(doc))))  # sorted by doc
        yield from pa.Table.from_arrays(
            [rows["doc"], rows["place"], rows["shape"], pa.array(rows["done"].to_numpy() | (doc > least))],
            names=["doc", "place", "shape", "done"]).combine_chunks().to_batches()


# rounds 3 and 4: depth 37, then windows


def _flat(around: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(around.buffers()[1], np.int32)[around.offset:around.offset + len(around) + 1]
    return np.frombuffer(around.buffers()[2] or b"", np.uint8), at.astype(np.int64)


def _both_sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows per position: depth 37 from it on, and depth 37 that begins 13 before it."""
    for batch in batches:
        texts, ids = list(map(_unpacked, batch["packed"].to_pylist())), long_array(batch["doc_id"])
        tags = [_tag(t) for t in texts]
        columns = [batch["places"].to_pylist(), batch["shapes"].to_pylist()]
        wanted = [[np.array(c[r], np.int64)[k] for c in columns] for r, k in enumerate(_wanted(batch, tags))]
        for rows, block in _blocks(texts, [r for r in range(len(texts)) if len(wanted[r][0])]):
            place, shape = (np.concatenate([wanted[r][c] for r in rows]) for c in (0, 1))
            of = np.repeat(np.arange(len(rows)), [len(wanted[r][0]) for r in rows])
            n, offset = shape // 32, shape % 32
            lo = (place & _PLACE) + block.starts[of]
            end, p = lo + n - 1 + LENGTH, lo + offset
            deep = block.names
            right = np.flatnonzero(p + DEPTH + FURTHER <= end)
            left = np.flatnonzero(offset > FURTHER)
            name = np.concatenate([
                _pair(_pair(deep[p[right]], deep[p[right] + FURTHER]), np.ones(len(right), _U)),
                _pair(_pair(deep[p[left] - FURTHER], deep[p[left]]), np.zeros(len(left), _U))])
            row = np.concatenate([right, left])
            side = np.repeat([0, 1], [len(right), len(left)])
            place, doc = place[row], ids[rows][of[row]]
            kind, _ = _shared_here(name, doc)
            _, inverse, counts = np.unique(name, return_inverse=True, return_counts=True)
            kind = np.where(counts[inverse] > SMALL_GROUP, kind, 0)  # few rows wait for the sort
            name = np.where(kind == _KNOWN, _mix(place.astype(_U) + doc.astype(_U) * _U(31) + side.astype(_U)), name)
            size = (end - lo)[row]
            ends = np.cumsum(size)
            take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo[row] - (ends - size), size)
            around = pa.BinaryArray.from_buffers(pa.binary(), len(size), [
                None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()),
                pa.py_buffer(block.codes[take].tobytes())])
            yield pa.record_batch([
                pa.array(signed(name)), pa.array(doc), pa.array(place), pa.array(n[row].astype(np.int32)),
                pa.array(offset[row].astype(np.int32)), pa.array((kind * 2 + side).astype(np.int32)), around],
                names=["name", "doc", "place", "n", "offset", "kind", "around"])


_SIDES = "name long, doc long, place long, n int, offset int, kind int, around binary"
_FOUND = "a long, b long, doc long, place long, n int, done boolean"


class _Sides:
    """Rows of one side each: bytes around, and the windows that hold the side's 37 bytes.

    The right side stands for the windows that begin up to 13 before the position, the left
    side for those that begin earlier.
    """

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        self.codes, self.at = _flat(rows["around"].chunk(0))
        offset, n, self.doc, self.place = (
            rows[c].to_numpy().astype(np.int64) for c in ("offset", "n", "doc", "place"))
        left = rows["kind"].to_numpy() % 2 == 1
        cut = np.clip(offset - FURTHER, 0, n)
        self.first, self.stop = np.where(left, 0, cut), np.where(left, cut, n)
        # where the shared 37 bytes begin and end in the row's bytes
        self.begin = self.at[:-1] + offset - np.where(left, FURTHER, 0)
        self.end = self.begin + DEPTH + FURTHER

    def windows(self) -> Iterator[pa.RecordBatch]:
        count = np.maximum(self.stop - self.first, 0)
        row = np.repeat(np.arange(len(count)), count)
        start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + self.first[row]
        s = self.at[:-1][row] + start
        a, b = _fifty(_names(self.codes), s), _fifty(_names(self.codes, 5), s, 5)
        d, w = self.doc[row], self.place[row] + start
        _, least = _shared_here(a ^ _mix(b.copy()), d)
        yield from _found(a, b, d, w, np.ones(len(w), np.int64), d > least)

    def compared(self, group: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Windows shared with a smaller document of the same group, for small groups."""
        reach = LENGTH - DEPTH - FURTHER  # 13 more bytes on the two sides make a window
        low, high = self.at[:-1, None], self.at[1:, None]
        steps = np.arange(1, reach + 1)
        before = self.begin[:, None] - steps
        after = self.end[:, None] - 1 + steps
        # bytes on either side; beyond the row's bytes nothing agrees
        left = np.where(before >= low, self.codes[np.maximum(before, 0)].astype(np.int16), -1)
        right = np.where(after < high, self.codes[np.minimum(after, len(self.codes) - 1)].astype(np.int16), -1)
        for step in range(1, SMALL_GROUP):
            if len(group) <= step:
                return
            i = np.flatnonzero((group[:-step] == group[step:]) & (self.doc[:-step] != self.doc[step:]))
            if not len(i) and not (group[:-step] == group[step:]).any():
                return
            j = i + step
            agree = [np.cumprod((x[i] == x[j]) & (x[i] >= 0), axis=1).sum(1) for x in (left, right)]
            later = np.where(self.doc[i] > self.doc[j], i, j)
            # shared windows begin `l` before the 37 bytes: reach - right <= l <= left
            stop = self.begin[later] - (reach - agree[1]) + 1 - self.at[:-1][later]
            first = self.begin[later] - agree[0] - self.at[:-1][later]
            first, stop = np.maximum(first, self.first[later]), np.minimum(stop, self.stop[later])
            some = first < stop
            later, first, n = later[some], first[some], (stop - first)[some]
            zero = np.zeros(len(n), _U)
            yield from _found(zero, zero, self.doc[later], self.place[later] + first, n, np.ones(len(n), bool))


def _found(a, b, doc, place, n, done) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_arrays(
        [pa.array(signed(a)), pa.array(signed(b)), pa.array(doc), pa.array(place),
         pa.array(n.astype(np.int32)), pa.array(done)],
        names=["a", "b", "doc", "place", "n", "done"]).to_batches(max_chunksize=50_000)


def _matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows known to be repeats, and windows of large groups still to be compared."""
    for rows in whole_groups(batches, ["name"]):
        name, doc, kind = (rows[c].to_numpy() for c in ("name", "doc", "kind"))
        starts = group_starts(name)
        sizes = np.diff(np.append(starts, len(name)))
        spans = _several(starts, doc, kind // 2)
        large = np.maximum.reduceat(kind // 2, starts) > 0
        large = np.repeat(large | (sizes > SMALL_GROUP), sizes)
        group = np.repeat(np.arange(len(starts)), sizes)
        keep = np.flatnonzero(spans & large)
        for part in range(0, len(keep), 50_000):
            yield from _Sides(rows.take(pa.array(keep[part:part + 50_000]))).windows()
        keep = np.flatnonzero(spans & ~large)
        if len(keep):
            yield from _Sides(rows.take(pa.array(keep))).compared(group[keep])


def _first_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, ["a", "b"]):
        a, b, doc = (rows[c].to_numpy() for c in ("a", "b", "doc"))
        starts = group_starts(a, b)
        keep = doc > np.repeat(doc[starts], np.diff(np.append(starts, len(doc))))  # sorted by doc
        if keep.any():
            yield from rows.select(["doc", "place", "n"]).filter(pa.array(keep)).to_batches()


def repeated_runs(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc, place, n): n neighbouring windows of a document that smaller documents have.

    `place` is the first window's offset, with a checksum of the text in the bits above 40.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sources = docs.where("doc_id IS NOT NULL AND octet_length(text) >= " + str(LENGTH)).select(
        F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranked = sources.mapInArrow(_first_depth, "name long, doc long, place long")
    ranked = ranked.repartition("name").sortWithinPartitions("name")
    shared = scratch.write(ranked.mapInArrow(_repeated, "doc long, place long"), "first")
    scratch.release()
    texts = sources.mapInArrow(_packed, "doc_id long, packed binary")
    grouped = shared.groupBy(F.col("doc").alias("doc_id")).agg(F.collect_list("place").alias("places"))
    around = texts.join(grouped, "doc_id").select("doc_id", "packed", "places").mapInArrow(_surroundings, _AROUND)
    around = around.repartition("name").sortWithinPartitions("name", "twin", "doc")
    around = scratch.write(around.mapInArrow(
        _first_surroundings, "doc long, place long, shape int, done boolean"), "surroundings")
    scratch.drop("first")
    scratch.release()
    grouped = around.where("NOT done").groupBy(F.col("doc").alias("doc_id")).agg(
        F.collect_list("place").alias("places"), F.collect_list("shape").alias("shapes"))
    sides = texts.join(grouped, "doc_id").select("doc_id", "packed", "places", "shapes").mapInArrow(
        _both_sides, _SIDES)
    matches = scratch.write(sides.repartition("name").sortWithinPartitions("name").mapInArrow(
        _matches, _FOUND), "matches")
    scratch.release()
    windows = matches.where("NOT done").repartition("a", "b").sortWithinPartitions("a", "b", "doc")
    found = windows.select("a", "b", "doc", "place", "n").mapInArrow(_first_windows, "doc long, place long, n int")
    runs = [df.select("doc", "place", "n") for df in (
        around.where("done").withColumn("n", F.floor(F.col("shape") / 32).cast("int")), matches.where("done"), found)]
    runs = scratch.write(runs[0].union(runs[1]).union(runs[2]), "runs")
    scratch.drop("surroundings", "matches")
    scratch.release()
    return runs


def spans_of(raw: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal removed (start, end) from window runs that carry this text's checksum."""
    tag = _tag(raw)
    spans: list[list[int]] = []
    for place, n in sorted((p & _PLACE, n) for p, n in runs if p >> 40 << 40 == tag):
        if spans and place <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], place + n - 1 + LENGTH)
        else:
            spans.append([place, place + n - 1 + LENGTH])
    return [(a, b) for a, b in spans]


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in spans:
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]])


def _with_runs(docs: DataFrame) -> DataFrame:
    """Each document as one struct `row`, with the places and lengths of its repeated runs or null."""
    runs = repeated_runs(docs, Scratch(docs.sparkSession, "suffix"))
    runs = runs.groupBy(F.col("doc").alias("key")).agg(
        F.collect_list("place").alias("places"), F.collect_list("n").alias("counts"))
    bound_batches(docs.sparkSession)
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    return rows.join(runs, F.col("row.doc_id").cast("long") == F.col("key"), "left").drop("key")


def _removed(batch: pa.RecordBatch) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    texts = pa.record_batch([batch["row"].field("text")], names=["text"])
    for raw, places, counts in zip(_encoded(texts), batch["places"].to_pylist(), batch["counts"].to_pylist()):
        yield raw, spans_of(raw, list(zip(places, counts))) if places else []


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(raw), sum(b - a for a, b in spans), len(spans),
                 hashlib.sha256(without(raw, spans)).hexdigest()) for raw, spans in _removed(batch)]
        columns = list(zip(*rows)) if rows else [[]] * 4
        yield pa.record_batch([batch["row"].field("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]],
                               pa.array(columns[3], pa.string())],
                              names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _cut(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [without(raw, spans).decode("utf-8", "ignore") for raw, spans in _removed(batch)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.string()) if n == "text" else batch["row"].field(n) for n in names], names=names)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeated bytes cut out of `text` (characters cut in two go entirely)."""
    names = docs.columns
    schema = docs.select(*[F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in names]).schema
    return _with_runs(docs).mapInArrow(lambda b: _cut(b, names), schema)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_runs(docs).mapInArrow(
        _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
