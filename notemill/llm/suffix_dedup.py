"""Removal of repeated 100-byte strings by bucket-pointer refinement.

A byte goes if some string of LENGTH bytes that covers it also starts earlier (in a document of smaller id, or earlier in
the same one). A full suffix array holds a pointer for every byte; here the buckets that cannot split further, or hold
one suffix, are left as early as possible:

1. Initial buckets. The bucket of a position is its q-gram (Q bytes). Of the positions that a LENGTH-byte string covers,
   the one of lowest bucket identifier speaks for the string; equal strings choose alike, so only these positions (some
   3 % of all) are sorted into buckets, each with the range of starts it speaks for. A bucket of one is left.
2. Refinement. A position's next identifier is made of the bucket identifiers at later offsets, over the whole range of
   strings it speaks for: positions with equal identifiers are equal over the range, and all but the first repeat it.
   A bucket that doesn't split is done.
3. Recursion into the buckets that did split, with their parts in place of the positions: the strings of a part are cut
   into runs of ever fewer offsets, whose new identifier is of all bytes that each string of a run covers (32 bytes at
   first, then 83, 96 and 100). Each level reuses what the one before found: of equal rows one goes on, and of buckets
   those with several parts. At the last a bucket is one string, and all but its first are repeats. What a level reads is
   at most what the one before kept, times the runs of a row, so hot buckets cost no more than their rows.

Identifiers of q-grams are 64-bit hashes, so that no global numbering is needed; a part of the first level is told apart
by 128 bits, those of its q-gram and of the identifiers at later offsets, and those of later levels by 128-bit hashes.
Strings never cross documents. Each step is an aggregation that combines before its shuffle, or a join whose hot keys
adaptive execution splits, so a passage in any share of the documents loads no single task.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

LENGTH, Q = 100, 32
#: Bytes of text, at most, that one piece holds; longer texts are cut into pieces that overlap.
PIECE = 1 << 18
# Odd multipliers.
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]
_PLACE = np.uint64((1 << 22) - 1)


def buckets(data: np.ndarray) -> np.ndarray:
    """The bucket identifier of the Q-gram at each position."""
    w = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,)).copy()
    n = len(data) - Q + 1
    h = np.zeros(n, np.uint64)
    for k in range(Q // 8):
        h ^= w[8 * k : 8 * k + n]
        h *= _MIX[k]
        h ^= h >> np.uint64(29)
    h *= _MIX[0]
    h ^= h >> np.uint64(32)
    return h


def speakers(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """p, first, last, bucket, refined: position p speaks for the strings that start from first to last. data: pieces,
    one after the other, of PIECE * 2 bytes or fewer together; ends: where each ends."""
    starts = len(data) - length + 1
    if starts <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    h = buckets(data)
    least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    width, want = 1, length - Q + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    inside = np.ones(starts, bool)
    for e in ends[:-1].tolist():
        inside[max(0, e - length + 1) : e] = False
    where = np.flatnonzero(inside)
    at = (least[where] & _PLACE).astype(np.int64)
    cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])[: len(at)]
    p, first = at[cut], where[cut]
    last = where[np.r_[cut[1:], len(at)][: len(cut)] - 1]
    stop = last + length - Q
    refined = ((p - first).astype(np.uint64) << np.uint64(8)) | (last - p + 128).astype(np.uint64)
    for k in range(2 * length // Q):
        refined = (refined ^ h[np.minimum(first + k * Q, stop)]) * _MIX[k % 4]
        refined ^= refined >> np.uint64(31)
    return p, first, last, h[p], refined


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Runs of (text number, place in the text, bytes) of at most about PIECE * 2 bytes."""
    run, size = [], 0
    for i, x in enumerate(texts):
        for a in range(0, max(len(x) - length + 1, 0), PIECE - length + 1):
            own = x[a : a + PIECE]
            run.append((i, a, own))
            size += len(own)
            if size >= PIECE:
                yield run
                run, size = [], 0
    if run:
        yield run


def _sorted_in(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Rows of phase 1. place: p << 16 | (p - first) << 8 | (last - p + 128); state 1: the bucket has more rows in this
    batch; route: the bucket, or, for all of its rows here but the first, anything."""
    texts = [x or b"" for x in batch.column(1).to_pylist()]
    owner, place, bucket, refined = [], [], [], []
    for run in _pieces(texts, length):
        sizes = np.array([len(x[2]) for x in run])
        ends = np.cumsum(sizes)
        p, first, last, h, c = speakers(np.frombuffer(b"".join(x[2] for x in run), np.uint8), ends, length)
        piece = np.searchsorted(ends, p, "right")
        shift = np.array([x[1] for x in run]) - (ends - sizes)
        owner.append(np.array([x[0] for x in run])[piece])
        place.append((p + shift[piece]) << 16 | (p - first) << 8 | (last - p + 128))
        bucket.append(h)
        refined.append(c)
    if not owner:
        owner, place, bucket, refined = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    owner, place, bucket, refined = (np.concatenate(x) for x in (owner, place, bucket, refined))
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    later = np.r_[False, b[1:] == b[:-1]][: len(b)]
    many = later | np.r_[later[1:], False][: len(b)]
    route = np.where(later, b + np.arange(len(b)).astype(np.uint64) * _MIX[1] + _MIX[2], b)
    cols = [batch.column(0).take(pa.array(owner[order])), *(pa.array(x.view(np.int64)) for x in (route, b, refined[order], place[order])), pa.array(many)]
    return pa.RecordBatch.from_arrays(cols, names=["k", "route", "bucket", "refined", "place", "many"])


def _range(place: int, length: int) -> tuple[int, int]:
    """First and last start of a row's strings."""
    p = place >> 16
    return p - (place >> 8 & 255), p + (place & 255) - 128


def _free_disk(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of tables that are written."""
    gc.collect()
    spark._jvm.System.gc()
    time.sleep(0.5)


def _join_texts(docs: DataFrame, rows: DataFrame, how: str = "inner") -> DataFrame:
    """k, data and the rows' other columns; docs: k, data."""
    return docs.join(rows.withColumnRenamed("k", "own"), F.col("k") == F.col("own"), how).drop("own")


def removed_ranges(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs: k (document key, ordered as the documents are), data (bytes). Gives k, start, end: bytes to remove; ranges may overlap."""
    spark = docs.sparkSession
    kind = docs.schema["k"].dataType.simpleString()
    first = common.map_batches(docs, lambda batch: _sorted_in(batch, length), f"k {kind}, route long, bucket long, refined long, place long, many boolean")
    count = F.count(F.lit(1)).over(Window.partitionBy("route"))
    alive = common.staged(first.withColumn("n", count).where("many OR n > 1").select("bucket", "refined", "k", "place"), "buckets")
    _free_disk(spark)

    # refinement: the first of equal rows stands for them, the others repeat it
    part = common.staged(alive.groupBy("bucket", "refined").agg(F.min(F.struct("k", "place")).alias("least"), F.count(F.lit(1)).alias("n")), "parts")
    found = _repeats(alive, part, length, "ranges")
    common.dropped(alive)

    # recursion into the buckets that did split
    split = common.staged(part.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select(F.col("bucket").alias("b")), "split")
    todo = part.join(common.sized(split), F.col("bucket") == F.col("b"), "left_semi").select("least.k", "least.place").groupBy("k").agg(F.collect_list("place").alias("todo"))
    rows = common.staged(_strings(_join_texts(docs, todo), kind, length), "strings")
    common.dropped(part)
    common.dropped(split)
    _free_disk(spark)
    for width in widths(length):
        more, after = _refined_again(rows, kind, width, length)
        common.dropped(rows)
        found, rows = found.union(more), after
    return found


def _strings(met: DataFrame, kind: str, length: int) -> DataFrame:
    """The bytes that the strings of each row in todo cover."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, places, found = [], [], []
        for n, (data, todo) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            for place in todo:
                a, b = _range(place, length)
                at.append(n)
                places.append(place)
                found.append(data[a : b + length])
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(places, pa.int64()), pa.array(found, pa.binary())], names=["k", "place", "data"])

    return common.map_batches(met.select("k", "data", "todo"), run, f"k {kind}, place long, data binary")


def _narrowed(batch: pa.RecordBatch, width: int, length: int) -> pa.RecordBatch:
    """Each row cut into the strings of one run of width offsets from p. bucket: all bytes that every string of such a run
    covers, with the run's number; refined: all bytes of the row's own strings there."""
    at, bucket, refined, places, found = [], [], [], [], []
    digest = xxhash.xxh3_128_digest
    for n, (place, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
        p, high = place >> 16, place >> 8 & 255
        low = 128 - (place & 255)  # offsets of the strings' starts before p, from low to high
        for run in range(low // width, high // width + 1):
            lo, hi = max(low, run * width), min(high, run * width + width - 1)
            shared = data[high - run * width : high - run * width - width + 1 + length]
            own = data[high - hi : high - lo + length]
            at.append(n)
            bucket.append(digest(shared, run))
            refined.append(digest(own, lo << 8 | hi))
            places.append(p << 16 | hi << 8 | 128 - lo)
            found.append(own)
    cols = (pa.array(bucket, pa.binary()), pa.array(refined, pa.binary()), pa.array(places, pa.int64()), pa.array(found, pa.binary()))
    return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], names=["k", "bucket", "refined", "place", "data"])


def _start_end(length: int):
    """Columns: the first byte and the end of what the strings of a place cover."""
    p = F.shiftright("place", 16)
    begin, end = p - F.shiftright("place", 8).bitwiseAND(F.lit(255)), p + F.col("place").bitwiseAND(F.lit(255)) - 128 + length
    return begin.cast("long").alias("start"), end.cast("long").alias("end")


def _repeats(alive: DataFrame, part: DataFrame, length: int, name: str) -> DataFrame:
    """k, start, end of the rows that repeat the first of their part."""
    more = part.where("n > 1").select(F.col("bucket").alias("b"), F.col("refined").alias("r"), F.struct("least.k", "least.place").alias("least"))
    again = alive.select("bucket", "refined", "k", "place").join(more, (F.col("bucket") == F.col("b")) & (F.col("refined") == F.col("r"))).where(F.struct("k", "place") != F.col("least"))
    return common.staged(again.select("k", *_start_end(length)), name)


def _refined_again(rows: DataFrame, kind: str, width: int, length: int) -> tuple[DataFrame, DataFrame | None]:
    """One level of refinement. rows: k, place, data, staged; the first rows of the parts of buckets that did split. Gives
    the ranges that this level finds repeated and the rows of the next level, of buckets that split again."""
    cut = common.map_batches(rows, lambda batch: _narrowed(batch, width, length), f"k {kind}, bucket binary, refined binary, place long, data binary")
    shared = common.staged(cut.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("bucket").alias("b")), "shared")
    alive = common.staged(cut.join(common.sized(shared), F.col("bucket") == F.col("b"), "left_semi"), "alive")
    common.dropped(shared)
    part = common.staged(alive.groupBy("bucket", "refined").agg(F.min(F.struct("k", "place", "data")).alias("least"), F.count(F.lit(1)).alias("n")), "parts")
    found = _repeats(alive, part, length, "ranges")
    common.dropped(alive)
    if width == 1:  # a bucket is one string
        common.dropped(part)
        return found, None
    split = common.staged(part.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select(F.col("bucket").alias("b")), "split")
    after = common.staged(part.join(common.sized(split), F.col("bucket") == F.col("b"), "left_semi").select("least.k", "least.place", "least.data"), "strings")
    common.dropped(split)
    common.dropped(part)
    return found, after


def widths(length: int = LENGTH) -> list[int]:
    """Offsets that one run of each level of refinement holds, down to one string: 18, 5, 1."""
    out = [-(-(length - Q + 1) // 4)]
    while out[-1] > 1:
        out.append(-(-out[-1] // 4) if out[-1] > 6 else 1)
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k, data. k is the id where all ids differ and none is null; else the id (null first) with a hash of the text."""
    odd = docs.groupBy(F.col(id_col).alias("i")).count().where("count > 1 OR i IS NULL")
    data = F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))
    k = F.col(id_col) if odd.isEmpty() else F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"))
    return docs.select(k.alias("k"), data.alias("data"))


def merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay).

    A null text is empty; a text shorter than length loses nothing. Of rows with the same id (or a null one, which comes
    first) those of other texts count as earlier or later documents by a hash of the text; rows that repeat both id and
    text are one document and have equal results. An empty table gives no rows."""
    own = keyed(docs, id_col, text_col)
    ranges = removed_ranges(own, length).groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    met = _join_texts(own, ranges, "left")
    is_id = own.schema["k"].dataType.typeName() != "struct"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for data, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            gone = merged([(x["start"], x["end"]) for x in found or []])
            kept, at = [], 0
            for a, b in gone:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            rows.append((len(data), sum(b - a for a, b in gone), len(gone), b"".join(kept)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    met = met.select((F.col("k") if is_id else F.col("k.id")).alias("doc_id"), "data", "ranges")
    return common.map_batches(met, run, f"doc_id {id_kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
