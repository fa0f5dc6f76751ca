"""Fingerprints of texts by one-permutation MinHash, and how like each text is to an edited copy and to its neighbour.

A text's five-word shingles are hashed once. A hash's low bits name one of BINS bins, and each bin keeps its smallest
hash. An empty bin takes the value of another: every bin has its own fixed random order of all bins, and the first one in
it that is occupied lends its value (optimal densification, so that two texts borrow alike where they are alike). Of
every bin's value the low BITS bits are packed into the fingerprint. Two unrelated bins agree with probability 2^-BITS,
which the likeness takes out again: (agreeing share - 2^-BITS) / (1 - 2^-BITS), not below 0.

Texts meet the next one in the order of ids inside a sorted partition of one range shuffle. Only the first and last rows
of the partitions, one each, are joined afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, stretches
from .weighted_minhash import Shingler

BINS, BITS = 256, 8  # BITS of 8 pack a bin into one byte
BATCH_CHARS = 2_000_000
#: Of each bin, the order in which it asks the others for a value.
ORDER = np.argsort(np.random.default_rng(12).random((BINS, BINS)), axis=1).astype(np.int64)


def packed(hashes: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The fingerprints of sets of hashes that stand behind each other, sorted within a set; of an empty set no bytes."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    key = owner * BINS + (hashes & np.uint64(BINS - 1)).astype(np.int64)
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    first = order[np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])] if len(order) else order
    least = np.full((len(sizes), BINS), -1, np.int16)
    least.ravel()[key[first]] = (hashes[first] // np.uint64(BINS) & np.uint64((1 << BITS) - 1)).astype(np.int16)
    for row in np.flatnonzero((sizes > 0) & (least < 0).any(axis=1)):
        empty = np.flatnonzero(least[row] < 0)
        asked = least[row][ORDER[empty]]
        least[row, empty] = asked[np.arange(len(empty)), (asked >= 0).argmax(axis=1)]
    return [row.tobytes() if n else b"" for row, n in zip(least.astype(np.uint8), sizes, strict=True)]


def fingerprints_of(shingler: Shingler, texts: list[str]) -> list[bytes]:
    hashes, _, sizes = shingler.sets(texts)
    return packed(hashes, sizes)


def likeness(a: bytes, b: bytes) -> float:
    """The estimated Jaccard similarity of two texts; 1 for two without words, 0 for one with and one without."""
    if not a or not b:
        return float(a == b)
    share = float((np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean())
    return max(0.0, (share - 2.0**-BITS) / (1 - 2.0**-BITS))


def edited(text: str, following: str) -> str:
    """The text, its last quarter replaced by as much of the beginning of the following one, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


SCHEMA = "part int, kind int, doc_id {id}, text string, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
DONE, HEAD, TAIL = 0, 1, 2


def _digests(shingler: Shingler, rows: list[tuple], following: list[str], prints: list[bytes], next_prints: list[bytes]) -> list[tuple]:
    """Result rows of (part, doc_id, text) rows, their next texts and the fingerprints of both."""
    changed = [edited(t, f) for (_, _, t), f in zip(rows, following, strict=True)]
    edits = fingerprints_of(shingler, changed)
    return [
        (part, DONE, doc_id, None, len(text), hashlib.sha256(c.encode()).hexdigest(), own, e, likeness(own, e), likeness(own, n))
        for (part, doc_id, text), c, own, e, n in zip(rows, changed, prints, edits, next_prints, strict=True)
    ]


def _arrow(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), id_type, pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a bounded number of characters, or of one row."""
    for batch in batches:
        for lo, hi in stretches(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), BATCH_CHARS):
            yield batch.slice(lo, hi - lo)


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, doc_id, text) of a sorted partition: results of all but the last, and the first and last with their texts."""
    shingler = Shingler()
    waiting: tuple | None = None
    own: bytes = b""
    id_type = None
    for batch in _texts(batches, 2):
        id_type = batch.column(1).type
        rows = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        prints = fingerprints_of(shingler, [r[2] for r in rows])
        blank = (None,) * 6
        out = [(rows[0][0], HEAD, *rows[0][1:], *blank)] if waiting is None else []
        if waiting is not None:
            rows, prints = [waiting, *rows], [own, *prints]
        out += _digests(shingler, rows[:-1], [r[2] for r in rows[1:]], prints[:-1], prints[1:])
        waiting, own = rows[-1], prints[-1]
        if out:
            yield _arrow(out, id_type)
    if waiting is not None:
        yield _arrow([(waiting[0], TAIL, *waiting[1:], *(None,) * 6)], id_type)


def _at_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of rows (part, doc_id, text, next text)."""
    shingler = Shingler()
    for batch in _texts(batches, 2):
        part, doc_id, text, following = (batch.column(k).to_pylist() for k in range(4))
        prints, next_prints = (fingerprints_of(shingler, t) for t in (text, following))
        yield _arrow(_digests(shingler, list(zip(part, doc_id, text, strict=True)), following, prints, next_prints), batch.column(1).type)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hexadecimal), near_edited, near_next of every row of docs.

    A null text is an empty one. The next document is the one of the next larger id (null ids are the smallest), of equal
    ids by a hash of the text; equal rows are interchangeable. After the last comes the first, so a single document is its
    own neighbour. A text without words has an empty fingerprint, and one of fewer than five words one shingle of all of
    them. An empty table gives no rows. Columns other than the two named ones are ignored, so clashing names do no harm.
    """
    id_type = dict(docs.dtypes)[id_col]
    schema = SCHEMA.format(id=id_type)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    keys = ["doc_id", "tie", "row"]  # the last one lets a hot id's equal rows go to several partitions
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    found = cut(ordered.mapInArrow(_in_order, schema))
    parts = sorted(r["part"] for r in found.filter(F.col("kind") == HEAD).select("part").collect())  # one number a partition
    follows = docs.sparkSession.createDataFrame([(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)], "part int, next_part int")
    heads = found.filter(F.col("kind") == HEAD).select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    tails = found.filter(F.col("kind") == TAIL).select("part", "doc_id", "text").join(follows, "part").join(heads, "next_part")
    last = tails.select("part", "doc_id", "text", "next_text").mapInArrow(_at_edges, schema)
    every = found.filter(F.col("kind") == DONE).unionByName(last)
    return every.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
