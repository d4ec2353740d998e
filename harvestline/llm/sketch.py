"""Threshold-scaled document sketches: every shingle hash below a fixed fraction.

Shingles are five words. A sketch keeps the hashes under `FRACTION` of their range, the same threshold for
all texts, so sketches merge by union and the share of one sketch in another estimates the share
of the shingles, also of a short document in a very long one. The README has the error by length.

Defined cases: null text is empty; a text with shingles but none under the threshold keeps its
least hash, so only a text without words has the empty sketch; two empty
sketches have likeness 1, an empty and another one 0; the fingerprint is the sketch in hex,
so equal texts have equal fingerprints. A single document is its own next one. Rows with a
null doc_id come first; rows that repeat a doc_id follow each other in text order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestline.llm.simhash import shingle_hashes
from harvestline.llm.support import bound_batches, table

SHINGLE_WORDS = 5
FRACTION = 0.75          # every hash below this share of 2^64 stays, whatever the length of the text
_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")


def _kept(hashes: np.ndarray, fraction: float) -> np.ndarray:
    """Sorted hashes under the threshold; the least one where there are none."""
    return hashes[:max(int(np.searchsorted(hashes, np.uint64(int(2**64 * fraction)))), min(1, len(hashes)))]


def sketch(text: str, fraction: float = FRACTION) -> np.ndarray:
    """Sorted distinct shingle hashes under the threshold."""
    return _kept(np.unique(shingle_hashes(text, SHINGLE_WORDS)), fraction)


def merge(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of two documents together, from their sketches."""
    return _kept(np.union1d(a, b), fraction)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common shingles among all shingles of two documents."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of `a` that `b` holds too."""
    if not len(a):
        return 1.0
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def to_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u8").tobytes().hex()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(fingerprint), ">u8").astype(np.uint64)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next document."""
    cut = len(text) // 4
    return text[:len(text) - cut] + following[:cut]


def _compared(doc_id, text: str, own: np.ndarray, following: str, after: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = sketch(changed)
    return (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(),
            to_text(own), to_text(other), likeness(own, other), likeness(own, after))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each document of a range with the next; the range's last with its look-ahead."""
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held = None
    for batch in batches:
        out = []
        for doc_id, text, ahead in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "ahead"))):
            if ahead and held is None:  # a further row that shares the look-ahead's id
                continue
            text = text or ""
            own = sketch(text)
            if held is not None:
                out.append(_compared(*held, text, own))
            held = None if ahead else (doc_id, text, own)
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                  names=[f.split()[0] for f in _OUT.split(", ")])


def ranges(docs: DataFrame, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower bounds of about `count` ranges of doc_id, which of them hold rows, their least ids.

    Reads the ids alone. `count` follows the number of partitions, never that of documents.
    """
    ids = docs.select(_order_id().alias("id"))
    cuts = ids.agg(F.percentile_approx("id", [k / count for k in range(1, count)], 10_000)).first()[0]
    bounds = np.unique(np.array(cuts or [], np.int64))
    firsts = sorted(ids.groupBy(_range_of(bounds)("id").alias("range")).agg(F.min("id")).collect())
    return bounds, np.array([f[0] for f in firsts], np.int64), np.array([f[1] for f in firsts], np.int64)


def _order_id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63))


def _range_of(bounds: np.ndarray):
    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32))
    return place


def _ahead_of(held: np.ndarray, firsts: np.ndarray):
    """The range before, for rows with the least id of their range: the first follows the last."""
    before = np.roll(held, 1)

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        values = ids.to_numpy()
        at = np.minimum(np.searchsorted(firsts, values), len(firsts) - 1)
        return pd.Series(before[at]).where(firsts[at] == values).astype("Int32")
    return place


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Sketches of each text and its edited text, compared with each other and the next text.

    Texts are shuffled once, into ascending ranges; the first document of each range is also
    sent to the range before it.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, held, firsts = ranges(docs, 4 * parts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _order_id().alias("_id"))
    own = F.struct(_range_of(bounds)("_id").alias("range"), F.lit(False).alias("ahead"))
    before = F.struct((_ahead_of(held, firsts)("_id") if len(held) else F.lit(None).cast("int")).alias("range"),
                      F.lit(True).alias("ahead"))
    placed = rows.select("doc_id", "text", F.explode(F.array(own, before)).alias("to")).select(
        "doc_id", "text", "to.*").where("range IS NOT NULL")
    return (placed.repartition(parts, "range").sortWithinPartitions("range", "ahead", "doc_id", "text")
            .select("doc_id", "text", "ahead").mapInArrow(_rows, _OUT))


def query(spark, sf_dir):
    return fingerprint_documents(table(spark, sf_dir, "documents"))
