"""Cheapest structure repair of conversations by the auction shortest-path algorithm.

A conversation is valid if its role initials read `(s?(ua)+)?`. Its rows span a lattice: a node
is (rows read, state of that pattern), an arc keeps, reroles or deletes the next row or inserts
an empty one, with an integer cost. The auction algorithm keeps a path from the start and a
price per node, never above the cost of any arc plus the price at its head. Where the last node's
price is below the best of its arcs it is raised to it and the path contracts by one node;
otherwise the path extends along that arc. When the sink is reached, every cheapest path consists
of tight arcs (price = cost + price at the head), and the ASCII-least one is traced over those
tight arcs that lead on to the sink. Prices start at the sum of what the remaining rows cost at
least, which is dual feasible.

A long conversation is cut into chunks. Auctions with one sink per exit state give each chunk's
4 x 4 table of costs; tables are joined backwards into exact prices at the chunk borders, and each
chunk is traced against the prices at its end. Rows are range-partitioned in conversation order, so
a conversation with any share of all rows is cut into segments of bounded size over many tasks.
Only two passes follow a large conversation in order, each holding one segment at a time: costs
backwards (a few numbers per segment), then tracing forwards.

Order and ties: rows are taken by (turn, nulls first; role; text), repeated rows stand side by
side. A null role or text is one space. A role that begins with none of s, u, a (the empty role
too) can not be kept as it is. Null conversation ids form one conversation. Only conv_id, turn,
role and text are read, so other columns may have any name. No rows give no conversations.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from harvestline.llm.support import Scratch, bound_batches, table

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
SPACES = " \t\n\x0b\x0c\r"
CHUNK = 48              # rows one auction spans
SEGMENT_ROWS = 2_048    # rows and characters of one segment
SEGMENT_CHARS = 1 << 20
KEY_CHARS = 16          # characters of a role or text that tell ranges of one turn apart
FAR = 1 << 60           # price of a node without a way to the sink

# States of the pattern: nothing read, `s` read, `u` read last, `a` read last.
STEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
# The letter an inserted or reroled row must have, the state it leads to.
WANTED = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
LEADS_TO = ((0,), (0, 1), (0, 1, 2, 3), (0, 1, 2, 3))  # states from which a state can be reached
AT_END = (0, 2 * INSERT, INSERT, 0)                     # cost of finishing from a state
ROLE = {"u": "user", "a": "assistant"}


def _row_arcs(code: str) -> tuple[tuple[tuple[str, int, int], ...], ...]:
    """Per state the (letter, cost, next state) of one row. Codes: `s u a x` by role initial,
    upper case if truncated, `D` where deletion is required."""
    arcs = []
    for state in range(4):
        out = [("D", DELETE, state)]
        if code != "D":
            extra = TRUNCATED if code.isupper() else 0
            kept = STEP[state].get(code.lower())
            if kept is not None:
                out.append(("K", extra, kept))
            out.append(("R", REROLE + extra, WANTED[state][1]))
        arcs.append(tuple(out))
    return tuple(arcs)


ROW_ARCS = {code: _row_arcs(code) for code in "suaxSUAXD"}
LEAST = {code: min(cost for arcs in ROW_ARCS[code] for _, cost, _ in arcs) for code in ROW_ARCS}


class Lattice:
    """Nodes 4 * rows read + state, and the sink behind the last layer."""

    def __init__(self, codes: str, ends: tuple[int, ...], states: tuple[int, ...] = (0, 1, 2, 3)):
        self.codes, self.ends, self.states = codes, ends, states
        self.sink = 4 * len(codes) + 4
        floor = min(ends[q] for q in states)
        prices = [floor] * 4
        for code in reversed(codes):
            floor += LEAST[code]
            prices += [floor] * 4
        self.prices = prices[::-1] + [0]

    def arcs(self, node: int) -> list[tuple[str, int, int]]:
        """(letter, cost, head) in ascending letters; border insertions belong to the next chunk."""
        layer, state = divmod(node, 4)
        if layer == len(self.codes):
            return [("", self.ends[state], self.sink)]
        base = 4 * layer
        out = [(letter, cost, base + 4 + q) for letter, cost, q in ROW_ARCS[self.codes[layer]][state] if q in self.states]
        if WANTED[state][1] in self.states:
            out.insert(1, ("I", INSERT, base + WANTED[state][1]))
        return out

    def auction(self, source: int) -> int:
        """Raise prices until a path from `source` reaches the sink; its cost, FAR without one."""
        prices, path = self.prices, [source]
        while True:
            node = path[-1]
            best, head = min(((cost + prices[j], j) for _, cost, j in self.arcs(node)), default=(FAR, -1))
            best = min(best, FAR)
            if prices[node] < best:
                prices[node] = best
                if len(path) > 1:
                    path.pop()
            elif best >= FAR:
                return FAR
            elif head == self.sink:
                return prices[source]
            else:
                path.append(head)

    def trace(self, source: int) -> tuple[str, int]:
        """ASCII-least letters over tight arcs that lead to the sink, and the state they end in."""
        prices = self.prices
        leads = [False] * self.sink + [True]
        for layer in range(len(self.codes), -1, -1):
            for _ in range(3):  # an insertion may lead to a node of the same layer
                for node in range(4 * layer, 4 * layer + 4):
                    leads[node] = leads[node] or any(
                        leads[j] and prices[node] == cost + prices[j] for _, cost, j in self.arcs(node))
        letters, node = [], source
        while True:
            letter, head = next((letter, j) for letter, cost, j in self.arcs(node)
                                if leads[j] and prices[node] == cost + prices[j])
            if head == self.sink:
                return "".join(letters), node % 4
            letters.append(letter)
            node = head


@functools.lru_cache(50_000)
def chunk_costs(codes: str) -> tuple[tuple[int, ...], ...]:
    """Costs from each entry state to each exit state of one chunk."""
    costs = [[FAR] * 4 for _ in range(4)]
    for leave in range(4):
        ends = tuple(0 if q == leave else FAR for q in range(4))
        lattice = Lattice(codes, ends, LEADS_TO[leave])  # prices hold for every entry state
        for enter in LEADS_TO[leave]:
            costs[enter][leave] = lattice.auction(enter)
    return tuple(map(tuple, costs))


@functools.lru_cache(50_000)
def chunk_trace(codes: str, enter: int, ends: tuple[int, ...]) -> tuple[str, int]:
    lattice = Lattice(codes, ends)
    lattice.auction(enter)
    return lattice.trace(enter)


def before(costs, ends: tuple[int, ...]) -> tuple[int, ...]:
    """Prices in front of a chunk from the prices behind it."""
    return tuple(min(min(c + e for c, e in zip(row, ends)), FAR) for row in costs)


def chunks_of(codes: str) -> list[str]:
    return [codes[k:k + CHUNK] for k in range(0, len(codes), CHUNK)]


def segment_costs(codes: str) -> list[list[int]]:
    """Costs from each entry to each exit state of any number of chunks."""
    total = [[0 if p == q else FAR for q in range(4)] for p in range(4)]
    for chunk in chunks_of(codes):
        costs = chunk_costs(chunk)
        total = [[min(min(row[m] + costs[m][q] for m in range(4)), FAR) for q in range(4)] for row in total]
    return total


def trace(codes: str, enter: int, ends: tuple[int, ...]) -> tuple[str, int]:
    """ASCII-least cheapest letters from state `enter`, and the exit state."""
    chunks = chunks_of(codes)
    prices = [ends]
    for chunk in reversed(chunks[1:]):
        prices.append(before(chunk_costs(chunk), prices[-1]))
    letters = []
    for chunk, price in zip(chunks, reversed(prices)):
        least = min(price)
        part, enter = chunk_trace(chunk, enter, tuple(p - least for p in price))
        letters.append(part)
    return "".join(letters), enter


def applied(letters: str, codes: str, enter: int, roles: list[str], texts: list[str]) -> tuple[list[tuple[str, str]], int]:
    """Repaired (role, text) rows and the cost of the letters."""
    rows, cost, state, at, kept = [], 0, enter, 0, 0
    for letter in letters:
        want, after = WANTED[state]
        if letter == "I":
            rows.append((ROLE[want], ""))
            cost, state = cost + INSERT, after
            continue
        code = codes[at]
        at += 1
        if letter == "D":
            cost += DELETE
        else:
            cost += TRUNCATED * code.isupper()
            if letter == "R":
                rows.append((ROLE[want], texts[kept]))
                cost, state = cost + REROLE, after
            else:
                rows.append((roles[kept], texts[kept]))
                state = STEP[state][code.lower()]
        kept += code != "D"
    return rows, cost


SEGMENT = pa.schema([
    ("part", pa.int32()), ("seg", pa.int64()), ("whole", pa.bool_()), ("blank", pa.int64()), ("duplicate", pa.int64()),
    ("truncated", pa.int64()), ("illegal", pa.int64()), ("turns", pa.int64()), ("first_turn", pa.int64()),
    ("last_turn", pa.int64()), ("first_initial", pa.string()), ("last_initial", pa.string()), ("codes", pa.string()),
    ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
SEGMENT_DDL = ("part int, seg long, whole boolean, blank long, duplicate long, truncated long, illegal long, turns long, "
               "first_turn long, last_turn long, first_initial string, last_initial string, codes string, "
               "roles array<string>, texts array<string>")
LEGAL = {"su", "ua", "au"}


class _Segment:
    def __init__(self):
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.first_turn = self.last_turn = None
        self.first_initial = self.last_initial = None
        self.codes, self.roles, self.texts, self.chars, self.rows = [], [], [], 0, 0

    def turn(self, turn: int | None) -> None:
        if turn is not None and turn != self.last_turn:
            self.n["turns"] += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn

    def add(self, initial: str, fault: str | None, role: str, text: str, copies: int) -> None:
        """`copies` equal rows; more than one only where each must be deleted."""
        if self.last_initial is not None and self.last_initial + initial not in LEGAL:
            self.n["illegal"] += 1
        self.n["illegal"] += copies - 1  # a row followed by its like is never legal
        self.first_initial = initial if self.first_initial is None else self.first_initial
        self.last_initial = initial
        self.rows += copies
        if fault:
            self.n[fault] += copies
        if fault in ("blank", "duplicate"):
            self.codes.append("D" * copies)
        else:
            self.codes.append(initial.upper() if fault else initial)
            self.roles.append(role)
            self.texts.append(text)
            self.chars += len(role) + len(text)


def _segments(batches: Iterator[pa.RecordBatch], ids: pa.DataType, most_rows: int, most_chars: int) -> Iterator[pa.RecordBatch]:
    """Cut sorted rows into segments. Conversations that touch an end of this partition or fill
    more than one segment are not `whole`."""
    part, seg, open_, conv, begun, edge = TaskContext.get().partitionId(), 0, None, None, False, True
    out: list[tuple] = []

    def close(whole: bool) -> None:
        nonlocal seg
        s = open_
        out.append((conv, part, seg, whole, *s.n.values(), s.first_turn, s.last_turn, s.first_initial,
                    s.last_initial, "".join(s.codes), s.roles, s.texts))
        seg += 1

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out))
        done = pa.record_batch([pa.array(c, t) for c, t in zip(columns, [ids, *SEGMENT.types])],
                               names=["conv_id", *SEGMENT.names])
        out.clear()
        return done

    held = 0
    for batch in batches:
        for row_conv, turn, role, text, initial, fault, rest, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if begun and row_conv != conv:
                close(not edge)
                held += open_.chars
                open_, edge = _Segment(), False
            elif not begun:
                open_, begun = _Segment(), True
            conv = row_conv
            todo = [(fault, 1), (rest, copies - 1)] if fault not in ("blank", "duplicate") else [(fault, copies)]
            for kind, n in todo:
                while n:
                    if open_.rows >= most_rows or open_.chars >= most_chars:
                        edge = True
                        close(False)
                        held += open_.chars
                        open_ = _Segment()
                    take = min(n, most_rows - open_.rows) if kind in ("blank", "duplicate") else 1
                    open_.turn(turn)
                    open_.add(initial, kind, role, text, take)
                    n -= take
            if len(out) >= 2_000 or out and held >= SEGMENT_CHARS:
                yield batch_of()
                held = 0
    if begun:
        close(False)
    if out:
        yield batch_of()


def _with_costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        costs = [sum(segment_costs(c), []) for c in batch["codes"].to_pylist()]
        columns = [batch[k] for k in ("conv_id", "part", "seg")]
        yield pa.record_batch([*columns, pa.array(costs, pa.list_(pa.int64()))], names=["conv_id", "part", "seg", "costs"])


def _prices_behind(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from the last to the first of each conversation: prices behind each of them."""
    conv, begun, ends = None, False, AT_END
    for batch in batches:
        prices, last = [], []
        for row_conv, flat in zip(batch["conv_id"].to_pylist(), batch["costs"].to_pylist()):
            final = not begun or row_conv != conv
            conv, begun = row_conv, True
            ends = AT_END if final else ends
            prices.append(list(ends))
            last.append(final)
            ends = before([flat[k:k + 4] for k in range(0, 16, 4)], ends)
        columns = [batch[k] for k in ("conv_id", "part", "seg")]
        yield pa.record_batch([*columns, pa.array(prices, pa.list_(pa.int64())), pa.array(last, pa.bool_())],
                              names=["conv_id", "part", "seg", "ends", "last"])


REPAIRED_DDL = ("last boolean, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, "
                "last_turn long, cost long, audit string, rows array<struct<role:string,text:string>>")
PASSED = ("blank", "duplicate", "truncated", "turns", "first_turn", "last_turn")


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trace segments in order; `illegal` and `turns` count what a border adds or splits once."""
    state, fresh, turn, initial = 0, True, None, None
    for batch in batches:
        columns = {k: batch[k].to_pylist() for k in batch.schema.names if k != "conv_id"}
        illegal, turns, cost, audit, rows = [], [], [], [], []
        for k in range(batch.num_rows):
            if fresh:
                state, turn, initial = 0, None, None
            codes = columns["codes"][k]
            letters, leave = trace(codes, state, tuple(columns["ends"][k]))
            done, spent = applied(letters, codes, state, columns["roles"][k], columns["texts"][k])
            fresh = columns["last"][k]
            if fresh:
                for _ in range(AT_END[leave] // INSERT):
                    want, leave = WANTED[leave]
                    letters += "I"
                    spent += INSERT
                    done.append((ROLE[want], ""))
            first = columns["first_turn"][k]
            turns.append(columns["turns"][k] - (first is not None and first == turn))
            turn = turn if columns["last_turn"][k] is None else columns["last_turn"][k]
            illegal.append(columns["illegal"][k] + (initial is not None and initial + columns["first_initial"][k] not in LEGAL))
            initial, state = columns["last_initial"][k], leave
            cost.append(spent)
            audit.append(letters)
            rows.append([{"role": r, "text": t} for r, t in done])
        long = pa.int64()
        kept = {k: batch[k] for k in PASSED}
        yield pa.record_batch(
            [batch["conv_id"], batch["last"], kept["blank"], kept["duplicate"], kept["truncated"], pa.array(illegal, long),
             pa.array(turns, long), kept["first_turn"], kept["last_turn"], pa.array(cost, long), pa.array(audit, pa.string()),
             pa.array(rows, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))],
            names=["conv_id", "last", "blank", "duplicate", "truncated", "illegal", "turns", "first_turn", "last_turn",
                   "cost", "audit", "rows"])


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number of copies, the role initial and the first fault of the
    first copy (`fault`) and of the others (`rest`).

    Equal rows collapse before the shuffle. The first turn of a (role, text) is a partial
    aggregate over digests and its join can be split, so no pair holds up one task.
    """
    one = (rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
           .withColumn("_said", F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
           .withColumn("_at", F.struct(F.col("turn").isNotNull().alias("known"), "turn")))
    first = one.groupBy(F.col("conv_id").alias("_conv"), F.col("_said").alias("_words")).agg(F.min("_at").alias("_first"))
    shown = F.rtrim("text", F.lit(SPACES))
    initial = F.substring("role", 1, 1)
    both = one.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_said") == F.col("_words")))
    blank = F.when(shown == "", "blank")
    seen = F.when(~F.col("_at").eqNullSafe(F.col("_first")), "duplicate")
    cut = F.when(~F.right(shown, F.lit(1)).isin(".", "!", "?"), "truncated")
    return both.select("conv_id", "turn", "role", "text", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
                       F.coalesce(blank, seen, cut).alias("fault"), F.coalesce(blank, F.lit("duplicate")).alias("rest"), "copies")


def repair(rows: DataFrame, scratch: Scratch, most_rows: int = SEGMENT_ROWS, most_chars: int = SEGMENT_CHARS) -> DataFrame:
    """Repaired segments of all conversations, those of one conversation in order and in one partition.

    Columns: conv_id, last (ends its conversation), counts of blank, duplicate, truncated rows,
    illegal neighbours and distinct turns, first_turn, last_turn, cost, audit (K keep, R rerole,
    D delete, I insert) and rows (role, text). A segment holds at most `most_rows` rows and,
    but for one text, `most_chars` characters.
    """
    bound_batches(rows.sparkSession)
    space = F.lit(" ")
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), space).alias("role"),
                        F.coalesce(F.col("text").cast("string"), space).alias("text"))
    kind = plain.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)
    ids = f"conv_id {kind.simpleString()}, "
    # a null turn sorts first by itself; texts break ties last
    order = ["conv_id", "turn", "role", "text"]
    # range bounds are sampled keys on the driver: beginnings keep them small and in the same order
    bounds = ["conv_id", "turn", *[F.left(c, F.lit(KEY_CHARS)) for c in ("role", "text")]]
    sorted_rows = judged(plain).repartitionByRange(*bounds).sortWithinPartitions(*order)
    segments = scratch.write(sorted_rows.mapInArrow(lambda b: _segments(b, arrow, most_rows, most_chars), ids + SEGMENT_DDL), "segments")
    whole = segments.where("whole").withColumns({"ends": F.array(*map(F.lit, AT_END)).cast("array<long>"), "last": F.lit(True)})
    cut = segments.where("NOT whole")
    costs = cut.select("conv_id", "part", "seg", "codes").mapInArrow(_with_costs, ids + "part int, seg long, costs array<long>")
    behind = (costs.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part"), F.desc("seg"))
              .mapInArrow(_prices_behind, ids + "part int, seg long, ends array<long>, last boolean"))
    priced = cut.join(scratch.write(behind.drop("conv_id"), "prices"), ["part", "seg"])
    columns = ["conv_id", *PASSED, "illegal", "first_initial", "last_initial", "codes", "roles", "texts", "ends", "last"]
    lines = priced.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
    out = ids + REPAIRED_DDL
    return whole.select(*columns).mapInArrow(_repair, out).unionAll(lines.select(*columns).mapInArrow(_repair, out))


def repaired_rows(segments: DataFrame) -> DataFrame:
    """The repaired conversations as rows (conv_id, role, text), in order within a partition."""
    return segments.select("conv_id", F.explode("rows").alias("_row")).select("conv_id", "_row.role", "_row.text")


DIGEST_DDL = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "repaired_sha256 string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation. Its hash is sequential by nature: segments stream through it."""
    names = ("blank", "duplicate", "truncated", "illegal", "cost", "turns")
    fresh = True
    for batch in batches:
        out: list[tuple] = []
        columns = {k: batch[k].to_pylist() for k in batch.schema.names}
        for k in range(batch.num_rows):
            if fresh:
                sums, low, high, audit, sha, begun = dict.fromkeys(names, 0), None, None, [], hashlib.sha256(), False
            for name in names:
                sums[name] += columns[name][k]
            low = columns["first_turn"][k] if low is None else low
            high = high if columns["last_turn"][k] is None else columns["last_turn"][k]
            audit.append(columns["audit"][k])
            for row in columns["rows"][k]:
                sha.update(f"{chr(10) * begun}{row['role']}:{row['text']}".encode())
                begun = True
            fresh = columns["last"][k]
            if fresh:
                gaps = 0 if low is None else high - low + 1 - sums["turns"]
                out.append((columns["conv_id"][k], gaps, *(sums[n] for n in names[:5]), "".join(audit), sha.hexdigest()))
        types = [batch["conv_id"].type, *[pa.int64()] * 6, pa.string(), pa.string()]
        fields = ["conv_id", "gaps", *names[:5], "audit", "repaired_sha256"]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 9, types)], names=fields)


def digest(segments: DataFrame) -> DataFrame:
    """Counts, cost, audit and the SHA-256 of `role:text` lines of each conversation."""
    return segments.mapInArrow(_digest, f"conv_id {segments.schema['conv_id'].dataType.simpleString()}, " + DIGEST_DDL)


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: drop, empty, strip ends, repeat, or set the role of a row by its key."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text = F.coalesce(F.col("text"), space)
    hit: Column = F.col("_hit")
    marked = rows.select("conv_id", "turn", F.coalesce(F.col("role"), space).alias("role"), text.alias("text"),
                         (F.crc32(key) % 20).alias("_hit")).where(hit != 0)
    return marked.select(
        "conv_id", "turn", F.when(hit == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(hit == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy")


def repaired_damage(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Damage, repair and digest; a conversation without rows left has zeros and an empty audit."""
    found = digest(repair(damaged(rows), scratch)).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct()
    zero = F.lit(0).cast("long")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def query(spark, sf_dir):
    return repaired_damage(table(spark, sf_dir, "conversations"), Scratch(spark, "conversations"))
