"""Exact byte-level BPE ids of whole texts, with a bounded memory of words already seen.

Before a space that is followed by a character other than white space, the tokenizer's
pattern always begins a new piece, likewise before a lone line end between visible characters and
between a letter and a mark. Texts are therefore cut there and every part is encoded once while
the worker remembers it; parts not seen yet go to the tokenizers library joined, many at a time,
and the byte lengths of the ids tell where each part ends. Ids equal those of the whole text.

The strings of added tokens, such as `<|endoftext|>`, are read as those tokens wherever they
stand in a text, as the library does by itself. A text that holds one goes to it whole.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa

MEMORY_PARTS = 1_000_000  # parts remembered by one task at most, about 150 MB
LONG_PART = 64           # longer parts are encoded on their own and not remembered


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_lengths(path: str) -> np.ndarray:
    """Bytes that each id stands for: one per character in a byte-level vocabulary."""
    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    lengths = np.zeros(max([*described["model"]["vocab"].values(),
                            *(t["id"] for t in described["added_tokens"])]) + 1, np.int64)
    for piece, i in described["model"]["vocab"].items():
        lengths[i] = len(piece)
    for token in described["added_tokens"]:
        lengths[token["id"]] = len(token["content"].encode())
    return lengths


def _bytes_where(test) -> np.ndarray:
    return np.array([test(b) for b in range(256)], bool)


WHITE = _bytes_where(lambda b: 9 <= b <= 13 or 28 <= b <= 32)      # white space by themselves
SOLID = _bytes_where(lambda b: 33 <= b <= 126)
LETTER = _bytes_where(lambda b: b < 128 and chr(b).isalpha())
MARKS = SOLID & ~_bytes_where(lambda b: chr(b).isalnum() or b == ord("'"))
# First bytes of the longer UTF-8 forms of white space, and the bytes that follow.
LONG_WHITE = {0xC2: [b"\x85", b"\xa0"], 0xE1: [b"\x9a\x80"], 0xE3: [b"\x80\x80"],
              0xE2: [b"\x80" + bytes([k]) for k in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)] + [b"\x81\x9f"]}


def cut_places(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Offsets in UTF-8 `data` before which a piece always begins; `starts` are those of texts.

    Such are spaces that precede something other than white space of the same text, line ends
    between two visible ASCII characters, and ASCII marks (but apostrophes) behind ASCII letters.
    """
    spaces = np.flatnonzero(data[:-1] == 32)
    after = data[spaces + 1]
    fine = ~WHITE[after]
    for first, rests in LONG_WHITE.items():
        at = np.flatnonzero(after == first)
        for rest in rests if len(at) else []:
            same = np.ones(len(at), bool)
            for k, byte in enumerate(rest):
                same &= data[np.minimum(spaces[at] + 2 + k, len(data) - 1)] == byte
            fine[at[same]] = False
    begins = np.zeros(len(data) + 1, bool)
    begins[starts] = True
    spaces = spaces[fine]
    marks = np.flatnonzero(LETTER[data[:-1]] & MARKS[data[1:]]) + 1
    lines = np.flatnonzero((data[1:-1] == 10) & SOLID[data[:-2]] & SOLID[data[2:]]) + 1
    return np.concatenate([spaces[~begins[spaces + 1]], marks, lines])


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        tokens = self.tokenizer.get_added_tokens_decoder().values()
        self.added = re.compile(b"|".join(re.escape(t.content.encode()) for t in tokens)) if tokens else None
        self.lengths = _byte_lengths(path)
        self.known: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new parts. Those that begin with a space or a line end are encoded joined: cut
        where they were cut in the texts, their pieces are the same."""
        found, spaced, lines = {}, [], []
        for p in parts:
            if 1 < len(p) <= LONG_PART and p[0] == 32 and not WHITE[p[1]] and p[1] not in LONG_WHITE:
                spaced.append(p)
            elif 1 < len(p) <= LONG_PART and p[0] == 10 and SOLID[p[1]] and SOLID[p[-1]]:
                lines.append(p)
            else:
                found[p] = self._whole(p.decode())
        groups = [some[i:i + 500] for some in (spaced, lines) for i in range(0, len(some), 500)]
        encoded = self.tokenizer.encode_batch_fast([b"".join(g).decode() for g in groups], add_special_tokens=False)
        for group, encoding in zip(groups, encoded):
            ids = np.array(encoding.ids, "<u4")
            ends = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(p) for p in group])) + 1
            raw = ids.tobytes()
            start = 0
            for part, end in zip(group, (4 * ends).tolist()):
                found[part] = raw[start:end]
                start = end
        return found

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column of texts as one array, and where each text's ids end; null is empty.

        Parts of the whole column are told apart in Arrow, so Python sees each of them once.
        """
        column = texts.cast(pa.large_binary()).fill_null(b"")
        at = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8 * column.offset)
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0]:at[-1]]
        at = at - at[0]
        cuts = cut_places(data, at) if len(data) else np.zeros(0, np.int64)
        if self.added and self.added.search(data.tobytes()):
            for k in [k for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if self.added.search(data[a:b].tobytes())]:
                cuts = cuts[(cuts < at[k]) | (cuts >= at[k + 1])]  # goes to the library whole
        bound = np.zeros(len(data) + 1, bool)
        bound[at] = bound[cuts] = True
        bounds = np.flatnonzero(bound)
        parts = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        coded = parts.dictionary_encode()
        which, every = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        new = [p for p in every if p not in self.known]
        if len(self.known) + len(new) > MEMORY_PARTS:
            self.known, new = {}, every
        self.known.update(self._learn(new))
        raw = list(map(self.known.__getitem__, every))
        if len(self.known) > MEMORY_PARTS:
            self.known = {}
        else:
            for p in new:
                if len(p) > LONG_PART:
                    del self.known[p]
        lengths = np.array([len(r) for r in raw], np.int64) // 4
        count = lengths[which]
        ends = np.cumsum(count)
        source = np.repeat((np.cumsum(lengths) - lengths)[which] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)
        return np.frombuffer(b"".join(raw), "<u4")[source], np.r_[0, ends][np.searchsorted(bounds, at[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker."""
    return Encoder(path)
