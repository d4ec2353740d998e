"""SentencePiece encoding and decoding as shortest paths through weighted transducers.

A model is compiled once into a normaliser, a lexicon of pieces and a byte fallback. An input
is composed with them into a lattice whose arcs are pieces between character positions; the
encoding is the path of least weight in the tropical semiring (add along a path, minimum over
paths).

* Unigram models: an arc weighs minus its score; states are positions.
* BPE models: states are (position, last piece), and an arc has weight zero if merging would
  leave the two pieces side by side, else infinity. Merging decides between any two neighbours
  locally, so exactly one path is finite, and it is the one merging finds. Only pieces that
  share a score break this (runs of word marks). There the second component of the weight
  decides: the leftmost joining comes first, so of the finite paths the one with the longest
  pieces from the left is taken, within the same lattice.

No piece runs across a word mark that follows another character, nor between two characters that
no piece holds side by side, so texts are cut there and parts already seen by the worker are
looked up in a bounded memory. The normaliser is the identity with spaces as word marks; a model
that normalises any other way is refused.

Defined cases: null text is empty and has no ids; characters outside the lexicon become their
UTF-8 bytes; a word mark in the text itself decodes to a space; rows with null or repeated doc_ids
are encoded as often as they occur; no rows give no rows. Only doc_id and text are read, so other
columns may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestline.llm.support import bound_batches, table, texts_of

MARK = "▁"
MEMORY_PARTS = 800_000
MEMORY_PAIRS = 1_000_000
LONG_PART = 64           # longer parts are not remembered
INFINITE = float("inf")
# Texts that normalisers of other kinds change: compositions, widths, cases, white space.
PROBE = " a  b\t c e\u0301 A\u030a ﬁ ① Ｋ ǅ İ ß \u00a0x\u3000y \n z  "


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


class Transducer:
    """The compiled model. `merges` says whether arcs are weighed as BPE or as unigram."""

    def __init__(self, path: str, merges: bool = True):
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        special = {i for i in ids if model.is_control(i) or model.is_unknown(i) or model.is_byte(i)}
        self.merges = merges
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.lexicon = {p: i for i, p in enumerate(self.pieces) if i not in special}
        self.score = [model.get_score(i) for i in ids]
        self.rank = [-v for v in self.score]  # joined earlier when lower
        self.byte_ids = {int(self.pieces[i][1:-1], 16): i for i in ids if model.is_byte(i)}
        self.bytes = [b"" if i in special else self.pieces[i].replace(MARK, " ").encode() for i in ids]
        for value, i in self.byte_ids.items():
            self.bytes[i] = bytes([value])
        self.unknown = model.unk_id()
        if any("\n" in p or MARK in p.lstrip(MARK) for p in self.lexicon):
            raise ValueError("pieces run across word marks or lines")
        self.prefix = model.normalize("a").startswith(MARK)
        probe = PROBE + "".join(map(chr, (*range(1, 0xD800), *range(0xE000, 0x10000))))
        if model.normalize(probe) != self.normalise(probe):
            raise ValueError("the model's normaliser changes more than spaces")
        beside = sorted({ord(a) << 21 | ord(b) for p in self.lexicon for a, b in zip(p, p[1:])})
        self.beside = np.array(beside, np.int64)  # characters that some piece holds side by side
        self.parts: dict[str, bytes] = {}
        self.atoms: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.parts_of_piece: dict[int, tuple[int, int] | None] = {}
        # every prefix of a piece, with the piece it is or -1; arcs are found by walking it
        self.trie: dict[str, int] = {}
        for text, i in self.lexicon.items():
            if not merges or self.reachable(i):
                for k in range(1, len(text)):
                    self.trie.setdefault(text[:k], -1)
                self.trie[text] = i

    # normaliser

    def normalise(self, text: str) -> str:
        """Spaces become word marks, and one is put in front of a text that is not empty."""
        return ((MARK if self.prefix else "") + text.replace(" ", MARK)) if text else ""

    # composition

    def fallback(self, char: str) -> tuple[int, ...]:
        found = tuple(self.byte_ids.get(b, -1) for b in char.encode("utf-8", "surrogatepass"))
        return (self.unknown,) if -1 in found else found

    def arcs(self, part: str, i: int) -> list[tuple[int, int]]:
        """The (end, piece id) of every arc that leaves position i; id -1 stands for bytes."""
        out, trie = [], self.trie
        for j in range(i + 1, len(part) + 1):
            piece = trie.get(part[i:j])
            if piece is None:
                break
            if piece >= 0:
                out.append((j, piece))
        if not out or out[0][0] != i + 1:
            out.append((i + 1, -1))
        return out

    # weights

    def _best(self, symbols: list[str]) -> int | None:
        best, found = INFINITE, None
        for k in range(len(symbols) - 1):
            joined = self.lexicon.get(symbols[k] + symbols[k + 1])
            if joined is not None and self.rank[joined] < best:
                best, found = self.rank[joined], k
        return found

    def halves(self, piece: int) -> tuple[int, int] | None:
        """The two pieces whose joining makes this piece; None for a single character."""
        if piece not in self.parts_of_piece:
            symbols = list(self.pieces[piece])
            last = None
            while len(symbols) > 1:
                k = self._best(symbols)
                if k is None:
                    break
                last = (self.lexicon[symbols[k]], self.lexicon[symbols[k + 1]]) if len(symbols) == 2 else None
                symbols[k:k + 2] = [symbols[k] + symbols[k + 1]]
            self.parts_of_piece[piece] = last
        return self.parts_of_piece[piece]

    def reachable(self, piece: int) -> bool:
        """Does merging ever make this piece?"""
        return len(self.pieces[piece]) == 1 or self.halves(piece) is not None

    def side_by_side(self, left: int, right: int) -> bool:
        """Would merging leave these two pieces as they are? Bytes never merge.

        Undoes the later of the two pieces' last joinings again and again. At each moment
        before a joining, a joining across the boundary must not have come first.
        """
        if left < 0 or right < 0:
            return True
        known = self.pairs.get(left << 16 | right)
        if known is None:
            if len(self.pairs) >= MEMORY_PAIRS:
                self.pairs.clear()
            known = self.pairs[left << 16 | right] = self._undone(left, right)
        return known

    def _undone(self, left: int, right: int) -> bool:
        # joinings across the boundary that come before this rank (or at it, if `at`) win
        rank, at = INFINITE, False
        while True:
            across = self.lexicon.get(self.pieces[left] + self.pieces[right])
            if across is not None and (self.rank[across] < rank or at and self.rank[across] == rank):
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and self.rank[left] > self.rank[right]:
                rank, at, left = self.rank[left], False, a[1]  # of equal ranks the left one is first
            else:
                rank, at, right = self.rank[right], True, b[0]

    # shortest path

    def shortest(self, part: str) -> list[int]:
        """Ids on the path of least weight; -1 for a character given as bytes."""
        return self._merge_path(part) if self.merges else self._score_path(part)

    def _score_path(self, part: str) -> list[int]:
        n = len(part)
        weight, back = [0.0] + [INFINITE] * n, [(0, -1)] * (n + 1)
        lowest = min(self.score) - 10.0  # a character without a piece
        for i in range(n):
            for j, piece in self.arcs(part, i):
                w = weight[i] - (self.score[piece] if piece >= 0 else lowest)
                if w < weight[j]:
                    weight[j], back[j] = w, (i, piece)
        path, at = [], n
        while at:
            at, piece = back[at]
            path.append(piece)
        return path[::-1]

    def _merge_path(self, part: str) -> list[int]:
        n = len(part)
        # finite states by position: last piece -> (position before it, piece before it)
        states: list[dict[int, tuple[int, int | None]]] = [{} for _ in range(n + 1)]
        several, known, fits, walk = False, self.pairs, self.side_by_side, self.trie.get
        states[0] = {-2: (0, None)}
        for i in range(n):
            lefts = states[i]
            if not lefts:
                continue
            j = i
            while j < n:        # the arcs that leave position i, as in arcs()
                j += 1
                piece = walk(part[i:j])
                if piece is None:
                    if j > i + 1:
                        break
                    piece = -1
                elif piece < 0:
                    if j > i + 1:
                        continue
                    piece = -1
                found = None
                for left in lefts:
                    if left < 0 or piece < 0 or (known[k] if (k := left << 16 | piece) in known else fits(left, piece)):
                        several = several or found is not None
                        found = left
                if found is not None:
                    states[j][piece] = (i, None if found == -2 else found)
                if piece < 0 and walk(part[i:j]) is None:
                    break
        if several or len(states[n]) != 1:
            return self._longest_path(part, states)
        (piece, (at, before)), = states[n].items()
        path = [piece]
        while before is not None:
            path.append(before)
            at, before = states[at][before]
        return path[::-1]

    def _longest_path(self, part: str, states: list[dict]) -> list[int]:
        """Of several finite paths the one with the longest pieces from the left."""
        n = len(part)
        leads: list[set[int]] = [set() for _ in range(n)] + [set(states[n])]

        def steps(i: int, left: int):
            for j, piece in reversed(self.arcs(part, i)):
                if piece in leads[j] and (left == -2 or self.side_by_side(left, piece)):
                    yield j, piece

        for i in range(n - 1, -1, -1):
            leads[i] = {left for left in states[i] if next(steps(i, left), None)}
        path, at, left = [], 0, -2
        while at < n:
            at, left = next(steps(at, left))
            path.append(left)
        return path

    # whole texts

    def _ids(self, part: str) -> bytes:
        out, at = [], 0
        for piece in self.shortest(part):
            if piece >= 0:
                out.append(piece)
                at += len(self.pieces[piece])
            else:
                out += self.fallback(part[at])
                at += 1
        return np.array(out, "<u4").tobytes()

    def cut(self, text: str) -> list[str]:
        """Parts of a normalised text between which no piece can run."""
        parts: list[str] = []
        for k, line in enumerate(self.normalise(text).split("\n")):
            if k:
                parts.append("\n")
            first, *rest = line.split(MARK)
            if first:
                parts.append(first)
            if "" not in rest:
                parts += [MARK + chunk for chunk in rest]
                continue
            marks = ""
            for chunk in rest:
                marks += MARK
                if chunk:
                    parts.append(marks + chunk)
                    marks = ""
            if marks:
                parts.append(marks)
        return parts

    def _learn(self, parts: list[str]) -> dict[str, bytes]:
        """Ids of new parts, each cut where no piece runs across."""
        joined = "".join(parts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        pairs = codes[:-1] << 21 | codes[1:]
        at = np.minimum(np.searchsorted(self.beside, pairs), len(self.beside) - 1)
        ends = np.cumsum([len(p) for p in parts])
        cut = np.ones(len(codes) + 1, bool)
        cut[1:-1] = self.beside[at] != pairs if len(self.beside) else True
        cut[ends] = True
        places = np.flatnonzero(cut)
        atoms = [joined[a:b] for a, b in zip(places[:-1].tolist(), places[1:].tolist())]
        wanted = set(atoms)
        new = wanted.difference(self.atoms)
        if len(self.atoms) + len(new) > MEMORY_PARTS:
            self.atoms, new = {}, wanted
        for atom in new:
            self.atoms[atom] = self._ids(atom)
        raw = list(map(self.atoms.__getitem__, atoms))
        for atom in new:
            if len(atom) > LONG_PART:
                del self.atoms[atom]
        found, begin = {}, 0
        for part, end in zip(parts, np.searchsorted(places, ends).tolist()):
            found[part] = raw[begin] if end == begin + 1 else b"".join(raw[begin:end])
            begin = end
        return found

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        cut = [self.cut(t) for t in texts]
        every = set().union(*cut)
        new = every.difference(self.parts)
        if len(self.parts) + len(new) > MEMORY_PARTS:
            self.parts = {}
            new = every
        if new:
            self.parts.update(self._learn(list(new)))
        out = [b"".join(map(self.parts.__getitem__, parts)) for parts in cut]
        if len(self.parts) > MEMORY_PARTS:
            self.parts = {}
        for part in new:
            if len(part) > LONG_PART:
                self.parts.pop(part, None)
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_batch([text])[0]

    def decode(self, ids: bytes) -> str:
        """Invert `encode`: outputs of the pieces joined, without the mark put in front."""
        text = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return (text[1:] if self.prefix and text[:1] == b" " else text).decode("utf-8", "replace")


@functools.cache
def transducer(path: str, merges: bool = True) -> Transducer:
    """One compiled model per Python worker."""
    return Transducer(path, merges)


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = transducer(path).encode_batch(texts_of(batch["text"]))
        ends = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
        ids = np.frombuffer(b"".join(raw), "<u4").view(np.int32)
        yield pa.record_batch([batch["doc_id"], pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))],
                              names=["doc_id", "ids"])


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every whole text."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda b: _encode(b, path), "doc_id long, ids array<int>")


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [transducer(path).decode(np.array(i, "<u4").tobytes()) for i in batch["ids"].to_pylist()]
        yield pa.record_batch([batch["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of encoded documents."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _decode(b, path), "doc_id long, text string")


def _digest(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    model = transducer(path)
    for batch in batches:
        texts = texts_of(batch["text"])
        raw = model.encode_batch(texts)
        back = [model.decode(r) for r in raw]
        yield pa.record_batch([
            batch["doc_id"], pa.array([len(r) // 4 for r in raw], pa.int64()),
            pa.array([zlib.crc32(r) for r in raw], pa.int64()),
            pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()),
            pa.array([b == t for b, t in zip(back, texts)])],
            names=["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"])


def query(spark, sf_dir):
    """Per document: number and CRC-32 of its ids, SHA-256 of the text decoded from them."""
    bound_batches(spark)
    path = default_path()
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        lambda b: _digest(b, path),
        "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
