"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints: 64 bits, each set where over half of the XXH64 values of a text's word shingles have it set.

Links at 4 or fewer differing bits are found exactly:

1. Equal fingerprints are one node (an aggregation that combines before its shuffle).
2. The 64 bits are cut into b blocks. Two fingerprints that differ in k bits agree in at least b - k whole blocks, so
   each choice of b - k blocks deals the fingerprints into buckets, and every link lies within a bucket. b follows the
   number of fingerprints, so that buckets stay small however many there are. A bucket with more than SPLIT
   fingerprints is dealt again, as the pairs of its chunks, over more tasks.
3. In a bucket fingerprints are sorted by their Gray rank. Runs of FAN neighbours form nodes, which form larger nodes;
   a node keeps the bits that all below it share (a mask and a pattern). Pairs of nodes are compared from the top: only
   bits newly shared at a level are counted and added to the difference so far; a pair over k is dropped with all below
   it, and a pair that can't exceed k any more links without descending.
4. A bucket gives the edges of a spanning forest, never all pairs; connected components follow.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .components import components

SEED, SHINGLE, BITS, NEAR = 42, 4, 64, 4
#: Children of an index node.
FAN = 8
#: Fingerprints in a bucket beyond which it is dealt again by pairs of chunks of half that size.
SPLIT = 20_000
#: Fingerprints expected in a bucket, at most, when the number of blocks is chosen.
BUCKET = 32
_PAIRS = 500_000
#: Fingerprints in a bucket up to which all its pairs are compared.
FEW = 48


# --- fingerprints


def shingle_hashes(text: str | None, size: int = SHINGLE) -> list[int]:
    words = (text or "").encode().lower().split()
    if not words:
        return []
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [digest(b" ".join(words), SEED)]
    whole = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[size:]]
    ends.append(len(whole))
    return [digest(whole[s:e], SEED) for s, e in zip(starts, ends)]


def fingerprints(texts: list[str | None], size: int = SHINGLE) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(BITS, dtype=np.uint64)
    for i, text in enumerate(texts):
        h = shingle_hashes(text, size)
        if h:
            values = np.array(h, np.uint64)
            ones = np.zeros(BITS, np.int64)
            for k in range(0, len(values), 65536):
                bits = np.unpackbits(values[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                ones += bits.sum(axis=0, dtype=np.int64)
            out[i] = weights[2 * ones > len(values)].sum(dtype=np.uint64)
    return out


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for each row of docs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = fingerprints(batch.column(1).to_pylist()).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, fp long")


# --- the index of one bucket: fingerprints of one or more 64-bit words, one in a row


def gray_rank(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def gray_ranks(fps: np.ndarray) -> list[np.ndarray]:
    """By word, the last one first (as lexsort has its keys): the rank of the words as one number, the first highest."""
    out, odd = [], np.zeros(len(fps), np.uint64)
    for word in fps.T:
        rank = gray_rank(word) ^ (~odd + np.uint64(1))  # all bits turn where those before have an odd number set
        odd = rank & np.uint64(1)
        out.insert(0, rank)
    return out


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def _levels(fps: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(mask, pattern) of the nodes of each level, leaves first."""
    ones, zeros = fps, ~fps
    out = [(ones | zeros, ones)]
    while len(ones) > 1:
        at = np.arange(0, len(ones), FAN)
        ones, zeros = np.bitwise_and.reduceat(ones, at), np.bitwise_and.reduceat(zeros, at)
        out.append((ones | zeros, ones))
    return out


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the components of a[i] and b[i] in label, where label[x] is the smallest member."""
    while True:
        x, y = label[a], label[b]
        keep = x != y
        if not keep.any():
            return
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def near_labels(fps: np.ndarray, near: int = NEAR) -> np.ndarray:
    """For fingerprints sorted by Gray rank: the smallest position that each is linked with, directly or by others."""
    n = len(fps)
    label = np.arange(n)
    if n < 2:
        return label
    levels = _levels(fps)
    top = len(levels) - 1
    one = np.zeros(1, np.int64)
    todo = [(top, one, one, np.zeros(1, np.int64), np.zeros((1, fps.shape[1]), np.uint64))]
    while todo:
        level, a, b, far, met = todo.pop()
        if len(a) > _PAIRS:
            half = len(a) // 2
            todo += [(level, a[k], b[k], far[k], met[k]) for k in (slice(half, None), slice(half))]
            continue
        mask, pattern = levels[level]
        shared = mask[a] & mask[b]
        far = far + _bits((pattern[a] ^ pattern[b]) & shared & ~met)
        keep = (far <= near) & ((a != b) if level == 0 else True)
        a, b, far, shared = a[keep], b[keep], far[keep], shared[keep]
        if not len(a):
            continue
        if level == 0:
            _merge(label, a, b)
            continue
        width = FAN**level
        # all below both nodes are within reach of each other: link them and go no deeper
        sure = far + _bits(~shared) <= near
        for x, y in zip(a[sure], b[sure]):
            members = np.r_[np.arange(x * width, min(n, (x + 1) * width)), np.arange(y * width, min(n, (y + 1) * width))]
            _merge(label, members, np.full(len(members), members[0]))
        a, b, far, shared = a[~sure], b[~sure], far[~sure], shared[~sure]
        below = len(levels[level - 1][0])
        k = np.arange(FAN)
        x = np.broadcast_to((a[:, None] * FAN + k)[:, :, None], (len(a), FAN, FAN)).reshape(-1)
        y = np.broadcast_to((b[:, None] * FAN + k)[:, None, :], (len(a), FAN, FAN)).reshape(-1)
        good = (x < below) & (y < below) & (x <= y)
        src = np.repeat(np.arange(len(a)), FAN * FAN)[good]
        if len(src):
            todo.append((level - 1, x[good], y[good], far[src], shared[src]))
    return label


def bucket_forest(keys: np.ndarray, fps: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions a, b of spanning edges of the near links within the buckets of equal keys. A bucket of a few fingerprints
    is compared pair by pair, the others by their index."""
    order = np.lexsort((*gray_ranks(fps), keys))
    keys, fps = keys[order], fps[order]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    size = np.diff(cut)
    label = np.arange(len(keys))
    at, end = np.flatnonzero(np.repeat(size <= FEW, size)), np.repeat(cut[1:], size)
    left, right = [], []
    for step in range(1, FEW):
        at = at[at + step < end[at]]
        if not len(at):
            break
        close = at[_bits(fps[at] ^ fps[at + step]) <= near]
        left.append(close)
        right.append(close + step)
    if left:
        _merge(label, np.concatenate(left), np.concatenate(right))
    for a, n in zip(cut[:-1][size > FEW], size[size > FEW]):
        label[a : a + n] = a + near_labels(fps[a : a + n], near)
    odd = np.flatnonzero(label != np.arange(len(label)))
    return order[odd], order[label[odd]]


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of longs, in runs that hold all rows of their keys (the first column, by which the rows are sorted)."""
    kept: list[np.ndarray] | None = None
    for batch in batches:
        own = [c.to_numpy() for c in batch.columns]
        kept = [np.concatenate(x) for x in zip(kept, own)] if kept else own
        if len(kept[0]) and kept[0][0] != kept[0][-1]:  # the last key may go on in the next batch
            end = int(np.searchsorted(kept[0], kept[0][-1]))
            yield [x[:end] for x in kept]
            kept = [x[end:] for x in kept]
    if kept and len(kept[0]):
        yield kept


# --- all fingerprints


def blocks_for(n: int, near: int = NEAR) -> int:
    """The fewest blocks for which n evenly spread fingerprints give buckets of BUCKET or fewer."""
    for b in range(near + 2, 2 * near + 5):
        if n <= BUCKET << ((b - near) * BITS // b):
            return b
    return 2 * near + 4


def _keys(fp, near: int, blocks: int):
    """For each choice of blocks - near blocks: the bits in those blocks and the number of the choice."""
    edge = [BITS * k // blocks for k in range(blocks + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - near)):
        mask = sum(((1 << edge[c + 1]) - 1) ^ ((1 << edge[c]) - 1) for c in chosen)
        mask -= (1 << BITS) * (mask >> (BITS - 1))  # as a signed long
        out.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(mask).cast("long")).alias("part")))
    assert len(out) == comb(blocks, near)
    return F.array(*out)


def near_edges(nodes: DataFrame, near: int = NEAR, split: int = SPLIT) -> DataFrame:
    """nodes: distinct fingerprints, column fp. Gives edges (a, b) whose components are those of the links."""
    spark = nodes.sparkSession
    blocks = blocks_for(nodes.count(), near)
    dealt = nodes.select("fp", F.explode(_keys(F.col("fp"), near, blocks)).alias("k")).select("fp", F.xxhash64("k.choice", "k.part").alias("key"))
    hot = dealt.groupBy("key").count().where(F.col("count") > split).select(F.col("key").alias("hot"), F.ceil(F.col("count") * 2 / split).cast("int").alias("chunks"))
    hot = common.staged(hot, "hot")
    if not hot.isEmpty():  # chunk c of a hot bucket meets each chunk, itself included, in one smaller bucket
        joined = dealt.join(hot, dealt.key == hot.hot, "left").withColumn("c", F.expr("int(pmod(xxhash64(fp, 7), coalesce(chunks, 1)))"))
        joined = joined.withColumn("d", F.explode(F.expr("sequence(0, coalesce(chunks, 1) - 1)")))
        dealt = joined.select("fp", F.when(F.col("hot").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("c", "d"), F.greatest("c", "d"))).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in by_key(batches):
            a, b = bucket_forest(keys, fps.view(np.uint64)[:, None], near)
            yield pa.RecordBatch.from_arrays([pa.array(fps[a]), pa.array(fps[b])], names=["a", "b"])

    found = dealt.select("key", "fp").repartition(common.parts(spark), "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    found = common.staged(found.distinct(), "near")
    common.dropped(hot)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable).

    Null and empty texts have fingerprint zero and link like any other. Rows with a null id take part; where a
    component has no other id, its component_id is null. Repeated ids give repeated rows. An empty table gives none."""
    rows = common.staged(fingerprint_rows(docs, id_col, text_col), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = near_edges(nodes.select("fp"), near)
    # components are over long values; which of them names a component doesn't matter here
    group = components(edges)
    named = common.staged(nodes.join(group, nodes.fp == group.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component")), "named")
    common.dropped(edges)
    common.dropped(group)
    least = common.staged(named.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id")), "least")
    of_fp = common.staged(named.select(F.col("fp").alias("of"), "component").join(common.sized(least), F.col("component") == F.col("c")).select("of", "component_id"), "classes")
    common.dropped(named)
    common.dropped(least)
    return rows.join(of_fp, rows.fp == of_fp["of"]).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
