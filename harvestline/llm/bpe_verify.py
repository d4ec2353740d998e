"""BPE with word ends, encoded by speculation and verification, and decoded.

Greedy longest match (an automaton over the vocabulary) proposes the tokens of every new word. A
proposal is the merge result exactly if each two adjacent tokens are compatible: undoing the
merges inside both tokens, latest first, no pair that then faces the border could have merged
before. That check runs vectorised over all adjacent pairs of a batch. Only words with a pair that
fails are merged exactly, all of them together, one merge rank per word and round; words over
`LONG` bytes one by one with a heap. Tokens that merging would not give from their own bytes never
take part in a proposal.

Texts are cut at ASCII white space, which no token spans, and each part is encoded once while it
is remembered; what a worker remembers is bounded. Parts of Latin characters are lower-cased and
cut into words here, all others by the library's own normaliser and pre-tokeniser, so
normalisation is the library's. Files with another model, normaliser or pre-tokeniser are refused.

Decoding joins the token strings by single spaces, as the library does for a file without a
decoder; ids that the vocabulary lacks are left out.

Defined cases: null text is empty and has no ids; rows with null or repeated doc_ids, ties and
copies are each encoded by themselves; very long texts are encoded whole; no rows give no rows.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import functools
import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestline.llm.support import bound_batches, table

MEMORY = 400_000        # parts and words remembered by one worker at most
REMEMBERED = 64         # longer parts are not remembered
LONG = 256              # bytes from which a word is merged with a heap
NEVER = 1 << 40         # rank of a pair that does not merge
END = "Ā"          # stands for the end of a word behind its bytes as characters

# The normaliser and pre-tokeniser this module implements for Latin characters.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LATIN = 0x180           # below it, NFC changes nothing and lower case stays in known classes


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves, the others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or b >= 161 and b != 173]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def _latin_words() -> re.Pattern:
    """The word pattern for characters below LATIN, which `re` has no classes for."""
    letters, digits = ("".join(re.escape(chr(c)) for c in range(LATIN) if unicodedata.category(chr(c))[0] == kind)
                       for kind in "LN")
    own = WORDS.replace(r"\p{L}", letters).replace(r"\p{N}", digits).replace(r"\s", r"\t\n\x0b\x0c\r ")
    return re.compile(own + r"|\n")


class WordBpe:
    """One vocabulary with its merges; ids equal those of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self._refuse_others(described)
        library = Tokenizer.from_file(path)
        self.normalize, self.pre_tokenize = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        model = described["model"]
        added = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.added = added
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.hard = re.compile(f"[^\\x00-{chr(LATIN - 1)}]|[\\x85\\xa0]")
        self.latin = _latin_words()
        self.to_bytes = {ord(c): b for c, b in _byte_of_character().items()}
        self.words: dict[str, bytes] = {}
        self.parts: dict[bytes, bytes] = {}

        suffix = model["end_of_word_suffix"]
        spelled = {i: self._spelled(s, suffix) for s, i in model["vocab"].items()}
        self.strings = dict.fromkeys(range(max([*spelled, *added.values()]) + 1), "")
        self.strings.update({i: s for s, i in model["vocab"].items()})
        self.strings.update({i: s for s, i in added.items()})
        known = np.zeros(len(self.strings), bool)
        known[[*spelled, *added.values()]] = True
        self.known = known

        size = self.size = len(self.strings)
        self.length = np.zeros(size, np.int64)
        self.inner, self.last = np.full(256, -1, np.int64), np.full(256, -1, np.int64)
        for i, s in spelled.items():
            self.length[i] = len(s)
            if len(s) == 1 and s != END:
                self.inner[ord(s)] = i
            elif len(s) == 2 and s[1] == END:
                self.last[ord(s[0])] = i
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made_id = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.made = np.full(size, -1, np.int64)     # rank of the merge that makes a token
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.made[self.made_id], self.left[self.made_id], self.right[self.made_id] = np.arange(len(pairs)), left, right
        ranks = np.arange(len(pairs))
        if len(set(self.made_id.tolist())) < len(pairs) or (self.made[left] >= ranks).any() or (self.made[right] >= ranks).any():
            raise ValueError("each token needs one merge, of tokens made before it")
        if (self.inner < 0).any() or (self.last < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        keys = left * size + right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.automaton = self._automaton({s: i for i, s in spelled.items()})

    @staticmethod
    def _refuse_others(described: dict) -> None:
        model, normal, cut = described["model"], described["normalizer"] or {}, described["pre_tokenizer"] or {}
        steps, cuts = normal.get("normalizers", []), cut.get("pretokenizers", [])
        fine = (
            model["type"] == "BPE" and model["end_of_word_suffix"] and not any(model.get(k) for k in (
                "dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
            and [s["type"] for s in steps] == NORMALIZERS and steps[1]["pattern"] == {"Regex": "\\s+"} and steps[1]["content"] == " "
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": WORDS}
            and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
            and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"] and not described["decoder"]
            and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])
                        for t in described["added_tokens"]))
        if not fine:
            raise ValueError("this tokenizer's model, normaliser, pre-tokeniser or decoder is of another kind")

    @staticmethod
    def _spelled(token: str, suffix: str) -> str:
        """A token as its bytes in Latin-1, END behind those that end a word."""
        ends = token.endswith(suffix)
        table = _CHARACTERS
        return "".join(chr(table[c]) for c in (token[:-len(suffix)] if ends else token)) + END * ends

    def _automaton(self, tokens: dict[str, int]):
        import ahocorasick
        whole = [s for s in tokens if s.endswith(END)]
        inner = [s for s in tokens if not s.endswith(END)]
        # a token is sound if its bytes merge into it, at the end of a word or inside one
        merged, ends = self._merged([s[:-1] for s in whole], True)
        sound = {s for s, a, b in zip(whole, [0, *ends[:-1]], ends) if b - a == 1 and merged[a] == tokens[s]}
        merged, ends = self._merged(inner, False)
        sound |= {s for s, a, b in zip(inner, [0, *ends[:-1]], ends) if b - a == 1 and merged[a] == tokens[s]}
        automaton = ahocorasick.Automaton()
        for s in sound:
            automaton.add_word(s, tokens[s])
        automaton.make_automaton()
        return automaton

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair, NEVER without one."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.order[at], NEVER)

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the joined bytes of two tokens gives these two tokens again."""
        good = np.ones(len(left), bool)
        at = np.arange(len(left))
        used_left = np.full(len(left), NEVER)   # rank at which the facing part is merged further
        used_right = used_left.copy()
        while len(at):
            rank = self.rank(left, right)
            # of equal ranks the leftmost pair merges first
            crosses = (rank < used_left) & (rank <= used_right) & (rank < NEVER)
            good[at[crosses]] = False
            made_left, made_right = self.made[left], self.made[right]
            go_on = ~crosses & ((made_left >= 0) | (made_right >= 0))
            of_left = made_left > made_right
            used_left = np.where(of_left, made_left, used_left)[go_on]
            used_right = np.where(of_left, used_right, made_right)[go_on]
            left, right = (np.where(of_left, self.right[left], left)[go_on],
                           np.where(of_left, right, self.left[right])[go_on])
            at = at[go_on]
        return good

    def _symbols(self, words: list[str], ended: bool) -> tuple[np.ndarray, np.ndarray]:
        """Single-byte tokens of the words and the word each belongs to."""
        raw = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        lengths = np.array([len(w) for w in words], np.int64)
        ids = self.inner[raw]
        if ended:
            stop = np.cumsum(lengths)[lengths > 0] - 1
            ids[stop] = self.last[raw[stop]]
        return ids, np.repeat(np.arange(len(words)), lengths)

    def _merged(self, words: list[str], ended: bool) -> tuple[np.ndarray, list[int]]:
        """Exact merging: every round merges, in each word, all pairs of its least rank."""
        ids, word = self._symbols(words, ended)
        done_ids, done_words = [], []
        while len(ids):
            pair = np.full(len(ids), NEVER)
            inside = np.flatnonzero(word[:-1] == word[1:])
            pair[inside] = self.rank(ids[inside], ids[inside + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.repeat(np.minimum.reduceat(pair, starts), np.diff(np.r_[starts, len(ids)]))
            over = least == NEVER
            if over.any():
                done_ids.append(ids[over])
                done_words.append(word[over])
                ids, word, pair, least = ids[~over], word[~over], pair[~over], least[~over]
            hit = pair == least
            # overlapping pairs are equal tokens in a row: every other one from the left
            place = np.arange(len(hit))
            begin = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, -1)) if len(hit) else place
            hit &= (place - begin) % 2 == 0
            ids = np.where(hit, self.made_id[np.where(hit, pair, 0)], ids)
            stay = ~np.r_[False, hit[:-1]] if len(hit) else hit
            ids, word = ids[stay], word[stay]
        if not done_ids:
            return np.zeros(0, np.int64), [0] * len(words)
        every, words_of = np.concatenate(done_ids), np.concatenate(done_words)
        order = np.argsort(words_of, kind="stable")
        return every[order], np.cumsum(np.bincount(words_of, minlength=len(words))).tolist()

    def _merged_long(self, word: str) -> np.ndarray:
        """Exact merging of one long word: a heap of (rank, place) over linked symbols."""
        ids, _ = self._symbols([word], True)
        ranks = self.rank(ids[:-1], ids[1:])
        heap = [(r, k, a, b) for k, (r, a, b) in enumerate(zip(ranks.tolist(), ids[:-1].tolist(), ids[1:].tolist())) if r < NEVER]
        heapq.heapify(heap)
        tokens, n = ids.tolist(), len(ids)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = functools.partial(self._rank_of)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k]
            if tokens[k] != a or j >= n or tokens[j] != b:
                continue
            tokens[k], tokens[j] = int(self.made_id[r]), -1
            after[k] = after[j]
            if after[k] < n:
                ahead[after[k]] = k
                rank = pairs(tokens[k], tokens[after[k]])
                if rank is not None:
                    heapq.heappush(heap, (rank, k, tokens[k], tokens[after[k]]))
            if ahead[k] >= 0:
                rank = pairs(tokens[ahead[k]], tokens[k])
                if rank is not None:
                    heapq.heappush(heap, (rank, ahead[k], tokens[ahead[k]], tokens[k]))
        return np.array([t for t in tokens if t >= 0], np.int64)

    @functools.cached_property
    def _rank_table(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.order.tolist()))

    def _rank_of(self, left: int, right: int) -> int | None:
        return self._rank_table.get(left * self.size + right)

    def proposed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest matches from the left: ids, their words, and which words are whole and verified."""
        found = np.array(list(self.automaton.iter_long(END.join(words) + END)), np.int64).reshape(-1, 2)
        ids = found[:, 1]
        lengths = np.array([len(w) + 1 for w in words], np.int64)
        word = np.searchsorted(np.cumsum(lengths), found[:, 0] + 1 - self.length[ids], "right")
        good = np.bincount(word, self.length[ids], len(words)).astype(np.int64) == lengths
        near = np.flatnonzero((word[1:] == word[:-1]) & good[word[1:]])
        bad = near[~self.compatible(ids[near], ids[near + 1])]
        good[word[bad]] = False
        return ids, word, good

    def _learn_words(self, words: list[str]) -> None:
        for w in [w for w in words if len(w) > LONG]:
            self.words[w] = self._merged_long(w).astype("<u4").tobytes()
        words = [w for w in words if len(w) <= LONG]
        if not words:
            return
        ids, word, good = self.proposed(words)
        failing = np.flatnonzero(~good)
        take = good[word]
        raw = ids[take].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(word[take], minlength=len(words))).tolist()
        for w, fine, a, b in zip(words, good.tolist(), [0, *ends[:-1]], ends):
            if fine:
                self.words[w] = raw[4 * a:4 * b]
        redo = [words[k] for k in failing.tolist()]
        merged, ends = self._merged(redo, True)
        raw = merged.astype("<u4").tobytes()
        for w, a, b in zip(redo, [0, *ends[:-1]], ends):
            self.words[w] = raw[4 * a:4 * b]

    def _words_of(self, part: str) -> list[str]:
        """Words of a part by the library's normaliser and pre-tokeniser, spelled as bytes."""
        return [w.translate(self.to_bytes) for w, _ in self.pre_tokenize(self.normalize(part))]

    def _learn_parts(self, parts: list[bytes]) -> dict[bytes, bytes]:
        plain, other = [], []
        for raw in parts:
            part = raw.decode()
            if self.added_pattern and self.added_pattern.search(part) or self.hard.search(part):
                pieces = self.added_pattern.split(part) if self.added_pattern else [part]
                other.append((raw, [p if p in self.added else self._words_of(p) for p in pieces if p]))
            else:
                plain.append((raw, part))
        cut = self.latin.findall("\n".join([p for _, p in plain]).lower())
        cut = [w if w.isascii() else w.encode().decode("latin-1") for w in cut]
        wanted = set(cut)
        wanted.discard("\n")
        for _, pieces in other:
            wanted.update(w for p in pieces if not isinstance(p, str) for w in p)
        new = wanted.difference(self.words)
        if len(self.words) + len(new) > MEMORY:
            self.words, new = {}, wanted
        self._learn_words(list(new))
        look, found = self.words.__getitem__, {}
        at = iter(plain)
        held: list[bytes] = []
        for w in cut:
            if w == "\n":
                found[next(at)[0]] = b"".join(held)
                held.clear()
            else:
                held.append(look(w))
        if plain:
            found[next(at)[0]] = b"".join(held)
        for raw, pieces in other:
            found[raw] = b"".join(
                self.added[p].to_bytes(4, "little") if isinstance(p, str) else b"".join(map(look, p)) for p in pieces)
        return found

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        cut = [t.split() for t in texts]
        every = set().union(*cut)
        new = every.difference(self.parts)
        if len(self.parts) + len(new) > MEMORY:
            self.parts, new = {}, every
        learned = self._learn_parts(list(new)) if new else {}
        self.parts.update(learned)
        look = self.parts.__getitem__
        out = [b"".join(map(look, parts)) for parts in cut]
        for part in learned:
            if len(part) > REMEMBERED:
                del self.parts[part]
        if len(self.parts) > MEMORY:
            self.parts = {}
        if len(self.words) > MEMORY:
            self.words = {}
        return out

    @functools.cached_property
    def _spaced(self) -> pa.Array:
        return pa.array([self.strings[i] + " " if self.known[i] else "" for i in range(self.size)], pa.large_string())

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of lists of ids; `ends` are the ends of the lists in the flat `ids`."""
        fine = (ids >= 0) & (ids < self.size)
        strings = self._spaced.take(pa.array(np.where(fine, ids, 0)))
        if not fine.all():
            strings = pc.if_else(pa.array(fine), strings, "")
        at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset:strings.offset + len(strings) + 1]
        texts = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(at[np.r_[0, ends]].copy()), strings.buffers()[2]])
        return pc.binary_slice(texts, 0, -1).cast(pa.large_string())


_CHARACTERS = _byte_of_character()


@functools.cache
def word_bpe(path: str) -> WordBpe:
    """One per Python worker."""
    return WordBpe(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = word_bpe(path).encode([t or b"" for t in batch["text"].cast(pa.binary()).to_pylist()])
        ends = np.cumsum([0, *[len(r) // 4 for r in raw]])
        ids = np.frombuffer(b"".join(raw), "<u4").view(np.int32)
        yield pa.record_batch([batch["doc_id"], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))],
                              names=["doc_id", "ids"])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of each whole text."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        lambda b: _encoded(b, path), f"doc_id {kind}, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["ids"].fill_null([]) if batch["ids"].null_count else batch["ids"]
        at = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]] if len(lists) else np.zeros(0, np.int32)
        texts = word_bpe(path).decode(ids, at[1:] - at[0])
        yield pa.record_batch([batch["doc_id"], batch["ids"], texts.cast(pa.string())], names=["doc_id", "ids", "text"])


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the decoded text of rows (doc_id, ids); null ids give an empty text."""
    bound_batches(rows.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")).mapInArrow(
        lambda b: _decoded(b, path), f"doc_id {kind}, ids array<int>, text string")


def digest(decoded: DataFrame) -> DataFrame:
    """Number of ids and the hashes of the ids in decimal and of the decoded text."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
                          F.sha2("text", 256).alias("decoded_sha256"))


def query(spark, sf_dir):
    path = default_path()
    return digest(decode(encode(table(spark, sf_dir, "documents"), path), path))
