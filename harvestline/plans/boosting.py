"""Boosted regression trees, fitted in blocks that survive a crash, kept and scored as a table.

The score of a row is the sum, over all trees of the model, of the value of the leaf it falls into.
Tree 0 is a single leaf, the mean label; each further tree fits what the trees before it left over,
and its values are already multiplied by the learning rate. Rows of the table are nodes: a row goes
right where its feature exceeds the threshold, and a leaf is its own left and right child.

Fitting. Every feature is cut once into at most `bins` ranges. A block of trees grows in one job, whose
tasks run side by side, each over its rows as arrays in a file of its own: level by level they tally rows and
left-over sums by node, feature and range, as Spark's tree learner does, whose splits these are (it looks for
ranges in a sample of 10,000 rows, here all count). After each block of trees the trees and the prediction of
every fitted row are tables of a step log, so a fit that was cut off goes on with the first block the log
lacks; the last block gives the predictions of all rows. What is left over is taken in steps of
`GRAIN`: sums of it are exact whatever the order of tasks, so a rerun grows the same trees. The squares
that are summed stay exact up to some 2 million rows of the largest possible error, and many more of
usual ones.

Defined cases: rows without a label are not fitted but get a prediction; a null feature counts as below
every threshold, NaN as above; without any labelled row there is no model (ValueError).
"""

from __future__ import annotations

import os
import pickle
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestline.constants import FEATURES
from harvestline.plans.steps import StepLog

GRAIN = 2.0 ** -16
# `input` counts the features from 0; in a leaf it is -1 and the threshold is null
NODES = "tree int, node int, depth int, input int, threshold double, left int, right int, value double"

CHUNK_COLUMNS = ["ranges", "label", "prediction"]
CHUNK = ", ".join(f"{c} binary" for c in CHUNK_COLUMNS)
CHUNK_ROWS = 32_768     # rows tallied at once: their arrays stay in the cache of a core
CELLS = 1024            # ranges that features counted together have at most, as a product
ROUTED = 64             # nodes of a tree that is walked by masks; larger ones row by row

EXCHANGE = "_exchange"
GROWN = "input array<int>, cut array<int>, left array<int>, value array<double>"


class Boosted(NamedTuple):
    trees: DataFrame  # nodes
    rows: DataFrame  # input columns in `row`, and `prediction`, the running sum while fitting


def _cuts(labelled: DataFrame, features: list[str], bins: int) -> DataFrame:
    """One row: per feature, the values that end its ranges."""
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    ends = [F.coalesce(F.sort_array(F.array_distinct(
        F.percentile_approx(F.col(c).cast("double"), shares, 100 * bins))),
        F.array().cast("array<double>")) for c in features]
    return labelled.agg(F.array(*ends).alias("cuts"))


def _ranges(features: list[str], cuts: list[list[float]]) -> Column:
    """Per feature the number of ends the value exceeds; 0 for null."""
    def passed(c: str, ends: list[float]) -> Column:
        known = F.array(*[F.lit(end) for end in ends]).cast("array<double>")
        return F.size(F.filter(known, lambda end: F.col(c) > end)).cast("double")

    return F.array(*[passed(c, ends) for c, ends in zip(features, cuts, strict=True)])


def _codes(values: pa.Array | pd.Series, ends: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The same for a batch of one feature, where null is given or -infinity."""
    known = values.fill_null(-np.inf) if isinstance(values, pa.Array) else values
    return np.searchsorted(ends, known.to_numpy(), side="left").astype(kind)


class _Walk(NamedTuple):
    """A tree that rows of ranges walk down: right where the range of the input exceeds the cut."""

    input: Sequence[int]
    cut: Sequence[int]
    left: Sequence[int]
    right: Sequence[int]

    def marks(self, codes: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """Per row the mark of the leaf it falls into. `codes` holds one array a feature."""
        if len(self.input) > ROUTED:
            return marks[self._rows(codes)]
        found = self._masked(codes, marks, 0)
        return found if found.ndim else np.full(codes.shape[1], found)

    def _masked(self, codes: np.ndarray, marks: np.ndarray, node: int) -> np.ndarray:
        if self.input[node] < 0:
            return marks[node]
        left, right = (self._masked(codes, marks, side[node]) for side in (self.left, self.right))
        above = np.negative((codes[self.input[node]] > self.cut[node]).astype(marks.dtype))     # all bits or none
        return left ^ ((left ^ right) & above)

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
        inputs, cuts, left, right = map(np.array, self)
        while (inner := inputs[at] >= 0).any():
            at = np.where(inner, np.where(codes[inputs[at], rows] > cuts[at], right[at], left[at]), at)
        return at

    def values(self, codes: np.ndarray, values: Sequence[float]) -> np.ndarray:
        return np.array(values)[self.marks(codes, np.arange(len(values), dtype=np.min_scalar_type(len(values))))]


class _Tree:
    """A tree while it grows: nodes in the order they are made, the right child next to the left one."""

    def __init__(self, input: Sequence[int] = (-1,), cut: Sequence[int] = (0,), left: Sequence[int] = (0,),
                 value: Sequence[float] = (0.0,)) -> None:
        self.input, self.cut, self.left, self.value = list(input), list(cut), list(left), list(value)

    def walk(self) -> _Walk:
        return _Walk(self.input, self.cut, self.left, [child + 1 for child in self.left])

    def split(self, node: int, found: int, cut: int, values: tuple[float, float]) -> None:
        self.input[node], self.cut[node], self.left[node] = found, cut, len(self.input)
        for value in values:
            for held, new in ((self.input, -1), (self.cut, 0), (self.left, 0), (self.value, value)):
                held.append(new)

    def rows(self, number: int, cuts: list[list[float]], rate: float) -> list[tuple]:
        """The tree as rows of the table, numbered from its root down; a split whose two leaves are equal
        is a leaf."""
        def same(node: int) -> bool:
            if self.input[node] < 0:
                return True
            pair = self.left[node], self.left[node] + 1
            return all([same(child) for child in pair]) and leaf[pair[0]] == leaf[pair[1]] and \
                not leaf.update({node: leaf[pair[0]]})

        def visit(node: int, depth: int) -> int:
            at = len(made)
            made.append((number, at, depth, -1, None, at, at, rate * leaf[node]))
            if not same(node):
                left, right = (visit(self.left[node] + side, depth + 1) for side in (0, 1))
                found = self.input[node]
                made[at] = (number, at, depth, found, cuts[found][self.cut[node]], left, right, rate * leaf[node])
            return at

        leaf, made = dict(enumerate(self.value)), []
        visit(0, 0)
        return made


def _packed(batches: Iterator[pa.RecordBatch], cuts: list[np.ndarray], kind: np.dtype,
            base: float) -> Iterator[pa.RecordBatch]:
    """Ranges, labels and first predictions of a batch of features and labels as one row of bytes."""
    for batch in batches:
        if batch.num_rows:
            codes = [_codes(batch.column(i), ends, kind) for i, ends in enumerate(cuts)]
            yield _bytes((_together(codes, batch.num_rows, kind), batch["label"].to_numpy(),
                          np.full(batch.num_rows, base)))


def _together(codes: list[np.ndarray], rows: int, kind: np.dtype) -> np.ndarray:
    return np.stack(codes) if codes else np.zeros((0, rows), kind)


def _bytes(columns: Sequence[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=CHUNK_COLUMNS)


def _chunks(batches: Iterator[pa.RecordBatch], kind: np.dtype) -> Iterator[tuple]:
    """Ranges, labels and predictions of each packed row."""
    for batch in batches:
        for codes, labels, predictions in zip(*(batch[c].to_pylist() for c in CHUNK_COLUMNS)):
            labels = np.frombuffer(labels)
            features = len(codes) // (len(labels) * kind.itemsize)
            yield np.frombuffer(codes, kind).reshape(features, len(labels)), labels, np.frombuffer(predictions)


def _after(chunks: Iterator[tuple], grown: Sequence[_Tree], rate: float) -> Iterator[tuple]:
    """Chunks with the predictions after more trees."""
    walks = [(tree.walk(), tree.value) for tree in grown]
    for codes, labels, predictions in chunks:
        for walk, values in walks:
            predictions = predictions + rate * walk.values(codes, values)
        yield codes, labels, predictions


def _rest(labels: np.ndarray, predictions: np.ndarray) -> np.ndarray:
    """What is left over, in whole steps of `GRAIN`, halves away from zero."""
    steps = (labels - predictions) / GRAIN
    whole = np.floor(np.abs(steps))
    return np.copysign(whole + (np.abs(steps) - whole >= 0.5), steps) * GRAIN


def _bundles(sizes: Sequence[int]) -> list[list[int]]:
    """Features that are counted together: one count over their common ranges gives those of each."""
    found: list[list] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for bundle in found:
            if bundle[0] * sizes[i] <= CELLS:
                bundle[0] *= sizes[i]
                bundle[1].append(i)
                break
        else:
            found.append([sizes[i], [i]])
    return [features for _, features in found]


def _tally(chunks: Iterator[tuple], tree: _Tree, open_: list[int], sizes: Sequence[int]) -> np.ndarray:
    """Per open node, feature and range: rows, and sums of what is left over and of its squares.

    `chunks` are ranges and what is left over.
    """
    slots = len(open_) + 1      # the last one is for rows in closed nodes
    marks = np.full(len(tree.input), len(open_), np.min_scalar_type(slots))
    marks[open_] = np.arange(len(open_))
    walk, bundles = tree.walk(), _bundles(sizes)
    shapes = [(slots, *(sizes[i] for i in bundle)) for bundle in bundles]
    totals = [np.zeros((3, np.prod(shape))) for shape in shapes]
    for codes, rest in chunks:
        slot, weights = walk.marks(codes, marks), (None, rest, rest * rest)
        for bundle, total in zip(bundles, totals):
            place = slot.astype(np.min_scalar_type(total.shape[1]))
            for i in bundle:
                place = place * place.dtype.type(sizes[i]) + codes[i]
            place = place.astype(np.intp)
            for k in range(3):
                total[k] += np.bincount(place, weights[k], total.shape[1])
    stats = np.zeros((3, len(sizes), len(open_), max([1, *sizes])))
    for bundle, total, shape in zip(bundles, totals, shapes):
        whole = total.reshape(3, *shape)[:, :-1]
        for at, i in enumerate(bundle):
            others = tuple(2 + other for other in range(len(bundle)) if other != at)
            stats[:, i, :, :sizes[i]] = whole.sum(axis=others)
    return stats


class _Held:
    """Rows of one task while trees grow, as arrays in a file of the task that the system may keep in memory."""

    def __init__(self, chunks: Iterator[tuple]) -> None:
        folder = (os.environ.get("SPARK_LOCAL_DIRS") or "").split(",")[0]
        self.file = tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)
        shapes = [self._write(several) for several in _gathered(chunks)]
        self.chunks, at = [], 0
        if not shapes:
            return
        held = np.memmap(self.file, np.uint8, "r+")
        for features, rows, kind in shapes:
            parts = []
            for size, type_ in ((features * rows, kind), (rows, np.float64), (rows, np.float64), (rows, np.float64)):
                parts.append(held[at:at + size * np.dtype(type_).itemsize].view(type_))
                at += -(-parts[-1].nbytes // 8) * 8
            self.chunks.append((parts[0].reshape(features, rows), *parts[1:]))

    def _write(self, several: list[tuple]) -> tuple:
        codes = np.concatenate([c[0] for c in several], axis=1)
        labels, predictions = (np.concatenate([c[k] for c in several]) for k in (1, 2))
        for part in (codes, labels, predictions, _rest(labels, predictions)):
            self.file.write(part.tobytes() + bytes(-part.nbytes % 8))
        self.file.flush()
        return *codes.shape, codes.dtype

    def rows(self) -> Iterator[tuple]:
        return ((codes, rest) for codes, _, _, rest in self.chunks)

    def add(self, tree: _Tree, rate: float) -> None:
        for codes, labels, predictions, rest in self.chunks:
            predictions += rate * tree.walk().values(codes, tree.value)
            rest[:] = _rest(labels, predictions)


def _gathered(chunks: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Small chunks put together to some `CHUNK_ROWS` rows."""
    several, rows = [], 0
    for chunk in chunks:
        several.append(chunk)
        rows += len(chunk[1])
        if rows >= CHUNK_ROWS:
            yield several
            several, rows = [], 0
    if several:
        yield several


class _Exchange:
    """What the first task of a barrier stage asks the others, and their answers, as files in a folder that
    all of them reach. (Spark's own `allGather` takes a second each time.)"""

    def __init__(self, folder: str, tasks: int) -> None:
        self.context, self.tasks, self.turn = BarrierTaskContext.get(), tasks, 0
        self.me = self.context.partitionId()
        # a stage that is tried once more has a folder of its own
        self.folder = f"{folder}/{uuid.uuid4().hex}"
        if self.me == 0:
            os.makedirs(self.folder)
        self.folder = self.context.allGather(self.folder)[0]
        if not os.path.isdir(self.folder):
            raise FileNotFoundError(f"not all executors reach {self.folder}")

    def _put(self, name: str, content: bytes) -> None:
        with open(f"{self.folder}/_{name}", "wb") as file:
            file.write(content)
        os.rename(f"{self.folder}/_{name}", f"{self.folder}/{name}")

    def _get(self, name: str) -> bytes:
        pause = 0.0005
        while not os.path.exists(f"{self.folder}/{name}"):
            time.sleep(pause)
            pause = min(pause * 1.1, 0.01)
        with open(f"{self.folder}/{name}", "rb") as file:
            return file.read()

    def ask(self, question: object, answer: Callable[[], np.ndarray]) -> np.ndarray:
        """The answers of all tasks, the own one included, added up."""
        self.turn += 1
        self._put(f"{self.turn}", pickle.dumps(question))
        total, names = answer(), [f"{self.turn}-{i}" for i in range(1, self.tasks)]
        for name in names:
            total += np.frombuffer(self._get(name)).reshape(total.shape)
        for name in (f"{self.turn}", *names):
            os.unlink(f"{self.folder}/{name}")
        return total

    def close(self) -> None:
        self._put(f"{self.turn + 1}", pickle.dumps(None))

    def questions(self) -> Iterator[object]:
        while (question := pickle.loads(self._get(f"{self.turn + 1}"))) is not None:
            self.turn += 1
            yield question

    def reply(self, stats: np.ndarray) -> None:
        self._put(f"{self.turn}-{self.me}", stats.tobytes())


def _best_split(stats: np.ndarray, present: list[np.ndarray]) -> tuple | None:
    """(feature, last range on the left, statistics of the left and right rows) of the first split that
    takes most off the variance; None if none takes any."""
    def variance(n, total, squares):
        return (squares - total * total / n) / n

    best, gain_of_best = None, 0.0
    for found, ranges in enumerate(present):
        if len(ranges) < 2:
            continue
        left = np.cumsum(stats[:, found], axis=1)
        whole, left = left[:, -1:], left[:, ranges[:-1]]
        right = whole - left
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = (variance(*whole) - left[0] / whole[0] * variance(*left)
                    - right[0] / whole[0] * variance(*right))
        gain = np.where((left[0] > 0) & (right[0] > 0), gain, -np.inf)
        at = int(np.argmax(gain))
        if gain[at] > gain_of_best:
            best, gain_of_best = (found, int(ranges[at] + ranges[at + 1]) // 2, left[:, at], right[:, at]), gain[at]
    return best


def _fit_tree(tallies: Callable[[_Tree, list[int]], np.ndarray], depth: int) -> _Tree:
    """One tree, level by level; `tallies` gives those of all rows for the open nodes of a tree."""
    tree, open_, present = _Tree(), [0], None
    for _ in range(max(depth, 1)):
        stats = tallies(tree, open_)
        if present is None:
            present = [np.flatnonzero(stats[0, i, 0]) for i in range(stats.shape[1])]
            count, total = stats[:2, 0, 0].sum(axis=1) if stats.shape[1] else (1.0, 0.0)
            tree.value[0] = float(total / count)
            if not depth:
                break
        grown = []
        for slot, node in enumerate(open_):
            if (found := _best_split(stats[:, :, slot], present)) is None:
                continue
            sides = found[2:]
            tree.split(node, *found[:2], tuple(float(total / n) for n, total, _ in sides))
            for child, (n, total, squares) in zip((tree.left[node], tree.left[node] + 1), sides):
                if abs((squares - total * total / n) / n) >= np.finfo(float).eps:
                    grown.append(child)
        if not grown:
            break
        open_ = grown
    return tree


def _grow(packed: DataFrame, count: int, sizes: list[int], depth: int, kind: np.dtype, rate: float,
          folder: str) -> list[_Tree]:
    """So many more trees, in one job: its tasks run side by side and hold their rows; the first one grows
    the trees and asks all for their tallies, level by level, through files in `folder`.

    Where workers can't open the folder as a path, or executors come and go, a level is one job.
    """
    spark = packed.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    plain = path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"
    if not plain or spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return _grow_by_jobs(packed, count, sizes, depth, kind, rate)
    context = spark.sparkContext._jsc.sc()
    tasks = max(1, context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))
    folder = path.toUri().getPath()

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, exchange, made = _Held(_chunks(batches, kind)), _Exchange(folder, tasks), []

        def answer(before: _Tree | None, tree: _Tree, open_: list[int]) -> np.ndarray:
            if before is not None:
                held.add(before, rate)
            return _tally(held.rows(), tree, open_, sizes)

        if exchange.me:
            for question in exchange.questions():
                exchange.reply(answer(*question))
            return

        def tallies(tree: _Tree, open_: list[int]) -> np.ndarray:
            before = made[-1] if made and len(tree.input) == 1 else None    # a new tree: the last one counts
            return exchange.ask((before, tree, open_), lambda: answer(before, tree, open_))

        for _ in range(count):
            made.append(_fit_tree(tallies, depth))
        exchange.close()
        whole, real = pa.list_(pa.int32()), pa.list_(pa.float64())
        yield pa.RecordBatch.from_pylist([vars(tree) for tree in made], pa.schema(
            [("input", whole), ("cut", whole), ("left", whole), ("value", real)]))

    made = packed.repartition(tasks).mapInArrow(grown, GROWN, barrier=True)
    return [_Tree(**tree.asDict()) for tree in made.collect()]


def _grow_by_jobs(packed: DataFrame, count: int, sizes: list[int], depth: int, kind: np.dtype,
                  rate: float) -> list[_Tree]:
    """The same, where the sums of all tasks come to the driver after every level."""
    packed, made = packed.persist(StorageLevel.MEMORY_AND_DISK), []

    def tallied(batches: Iterator[pa.RecordBatch], now: tuple, before: list[_Tree]) -> Iterator[pa.RecordBatch]:
        left_over = ((codes, _rest(labels, sums)) for codes, labels, sums in _after(_chunks(batches, kind), before, rate))
        yield pa.RecordBatch.from_arrays([pa.array([_tally(left_over, *now, sizes).tobytes()], pa.binary())], ["tally"])

    def tallies(*now) -> np.ndarray:
        parts = packed.mapInArrow(lambda part, before=list(made): tallied(part, now, before), "tally binary").collect()
        return sum(np.frombuffer(r.tally) for r in parts).reshape(3, len(sizes), len(now[1]), max([1, *sizes]))

    for _ in range(count):
        made.append(_fit_tree(tallies, depth))
    packed.unpersist()
    return made


def _walks(nodes: Sequence, ends: list[np.ndarray]) -> list[tuple[_Walk, list[float]]]:
    """Rows of a table of trees as walks over ranges that end at `ends`, in order of the trees."""
    trees: dict[int, list] = {}
    for node in sorted(nodes, key=lambda n: (n[0], n[1])):
        trees.setdefault(node[0], []).append(node)
    return [(_Walk([n[3] for n in tree],
                   [int(np.searchsorted(ends[n[3]], n[4])) if n[3] >= 0 else 0 for n in tree],
                   [n[5] for n in tree], [n[6] for n in tree]), [n[7] for n in tree])
            for _, tree in sorted(trees.items())]


def _sum_of(nodes: Sequence, ends: list[np.ndarray], inputs: Sequence[Column]) -> Column:
    """Sum of the values of the leaves that a row falls into; the model is bounded by its trees."""
    walks, kind = _walks(nodes, ends), np.min_scalar_type(max([1, *map(len, ends)]))

    @F.pandas_udf("double")
    def total(*values: pd.Series) -> pd.Series:
        codes = [_codes(column, known, kind) for column, known in zip(values, ends)]
        # no input of that number: never above a threshold
        codes += [np.zeros(len(values[0]), kind)] * (len(ends) - len(codes))
        codes, sums = _together(codes, len(values[0]), kind), np.zeros(len(values[0]))
        for walk, leaves in walks:
            sums += walk.values(codes, leaves)
        return pd.Series(sums)

    # pandas can't tell null from NaN; null is below every threshold
    known = [F.coalesce(c.cast("double"), F.lit(float("-inf"))) for c in inputs]
    return total(*(known or [F.lit(0.0)]))


def fit(labelled: DataFrame, folder: str, run: str, *, fitted: Column | None = None,
        features: list[str] = FEATURES, trees: int = 250, depth: int = 4, rate: float = 0.05,
        bins: int = 64, block: int = 25) -> Boosted:
    """Fit `label` on the rows for which `fitted` is true (all by default).

    `folder` is storage all executors reach and `run` names the step log in it. A run is resumed with
    the rows it began with and keeps its settings.
    """
    if min(trees, bins - 1, block) < 1 or depth < 0:
        raise ValueError("at least one tree, two bins and a block of one tree are needed")
    spark = labelled.sparkSession
    log = StepLog(spark, folder, run)
    kept = F.lit(True) if fitted is None else F.coalesce(fitted, F.lit(False))
    settings = (trees, depth, rate, bins, block, features)
    plan = log.once("plan", lambda: spark.createDataFrame(
        [settings], "trees int, depth int, rate double, bins int, block int, features array<string>"))
    if tuple(plan.first()) != settings:
        raise ValueError(f"run {run} was begun with other settings")

    begun = log.once("input", lambda: labelled.select(
        F.struct(*labelled.columns).alias("row"), *[F.col(c).cast("double").alias(f"x{i}")
                                                    for i, c in enumerate(features)],
        F.col("label").cast("double").alias("label"), kept.alias("chosen"),
    ).withColumn("fitted", F.col("chosen") & F.col("label").isNotNull()).drop("chosen"))
    columns = [f"x{i}" for i in range(len(features))]
    chosen = begun.where("fitted")
    cuts = [list(ends) for ends in log.once("cuts", lambda: _cuts(chosen, columns, bins)).first().cuts]
    base = log.once("base", lambda: chosen.agg(
        F.avg(F.round(F.col("label") / GRAIN) * GRAIN).alias("value"))).first().value
    if base is None:
        raise ValueError("no labelled row to fit")

    ends = [np.array(known, np.float64) for known in cuts]
    sizes = [len(known) + 1 for known in cuts]
    kind = np.min_scalar_type(max([1, *sizes]))
    blocks = [(first, min(first + block - 1, trees)) for first in range(1, trees + 1, block)]
    root = (0, 0, 0, -1, None, 0, 0, base)
    latest = "rows-0"
    log.once(latest, lambda: chosen.select(*columns, "label").mapInArrow(
        lambda batches: _packed(batches, ends, kind, base), CHUNK))
    done = log.committed()
    for first, last in blocks:
        name = f"rows-{first}-{last}"
        if name not in done:
            # the table of rows commits a block: trees without it are grown once more
            rows = log.table(latest)
            grown = _grow(rows, last - first + 1, sizes, depth, kind, rate, f"{log.path}/{EXCHANGE}")
            log.empty(EXCHANGE)
            nodes = [node for number, tree in enumerate(grown, first) for node in tree.rows(number, cuts, rate)]
            log.again(f"trees-{first}-{last}", spark.createDataFrame(nodes, NODES).coalesce(1))
            if last < trees:
                log.again(name, rows.mapInArrow(
                    lambda part, grown=grown: map(_bytes, _after(_chunks(part, kind), grown, rate)), CHUNK))
            else:
                known = [root, *(tuple(n) for f, l in blocks for n in log.table(f"trees-{f}-{l}").collect())]
                log.again(name, begun.select("row", _sum_of(known, ends, [F.col(c) for c in columns]).alias("prediction")))
            log.empty(latest)
        latest = name
    table = spark.createDataFrame([root], NODES)
    for first, last in blocks:
        table = table.unionByName(log.table(f"trees-{first}-{last}"))
    return Boosted(table, log.table(latest).select("row.*", "prediction"))


def score(features: DataFrame, trees: DataFrame, name: str = "score",
          inputs: list[str] = FEATURES) -> DataFrame:
    """Score rows by the table of trees, clipped to 0..1; no join.

    The table is bounded by the model, not by the data (250 trees of depth 4 have 7,751 nodes at most):
    the driver reads it, and every batch of rows walks down all trees by masks over its columns.
    """
    nodes = [tuple(n) for n in trees.select(*[c.split()[0] for c in NODES.split(", ")]).collect()]
    ends: list[set] = [set() for _ in range(max([len(inputs), *[n[3] + 1 for n in nodes]]))]
    for node in nodes:
        if node[3] >= 0:
            ends[node[3]].add(node[4])
    total = _sum_of(nodes, [np.unique(np.array(sorted(known), np.float64)) for known in ends],
                    [F.col(c) for c in inputs])
    return features.withColumn(name, F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def score_sql(rows: str, trees: str, key: str, inputs: list[str] = FEATURES) -> str:
    """The same score as a recursive query of any SQL engine, over tables `rows` and `trees`."""
    value = "CASE n.input " + " ".join(f"WHEN {i} THEN r.{c}" for i, c in enumerate(inputs)) + " END"
    return f"""
        WITH RECURSIVE walk AS (
            SELECT r.{key}, n.tree, n.node FROM {rows} r CROSS JOIN {trees} n WHERE n.node = 0
            UNION ALL
            SELECT r.{key}, n.tree,
                   CASE WHEN coalesce({value} > n.threshold, false) THEN n."right" ELSE n."left" END
            FROM walk w JOIN {rows} r ON r.{key} = w.{key}
            JOIN {trees} n ON n.tree = w.tree AND n.node = w.node
            WHERE n.input >= 0)
        SELECT w.{key}, least(greatest(sum(n.value), 0), 1) AS score
        FROM walk w JOIN {trees} n ON n.tree = w.tree AND n.node = w.node AND n.input = -1
        GROUP BY w.{key}"""
