"""The near-duplicate stage: SimHash with the Gray-order index of simhash.py, for texts that are alike at a similarity of 0.8.

At a Jaccard similarity of 0.8 of their five-word shingles two texts differ in some 15 % of a fingerprint's bits, far more
than the four of 64 that blocks of bits can rule out. So:

1. Texts with one and the same set of shingles are one node, with a fingerprint of BITS bits of that set.
2. A node is dealt into a bucket for each of a number of chosen sets of bits. Their size follows the number of nodes, so
   that buckets stay small however many there are, and their number the size, so that a pair at the threshold meets in
   none of them with probability MISSED at most (one at 0.9: a thousandth of that).
3. In a bucket the Gray-order index links the fingerprints within NEAR of the first KEPT bits. These links are candidates:
   NEAR is wide enough for all but 0.3 % of pairs at the threshold. Their components are small sets of like texts.
4. In a component the links at THRESHOLD or more are found exactly, from the shingles themselves: a search in breadth
   compares each node with those that no search has reached yet, so a dense group costs little more than its size. A
   component of more than WEIGHT shingles is dealt as the pairs of its chunks. Connected components of these links follow.

Texts move only as the shingles of nodes that have a candidate, once.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components
from .simhash import bucket_forest, by_key, shingle_hashes

SHINGLE, THRESHOLD = 5, 0.8
BITS, KEPT, NEAR = 256, 128, 30
#: The chance that bits of two sets at the threshold are equal: 1 - acos(2 * 0.8 / 1.8) / pi.
EQUAL = 0.8486
MISSED = 0.02
#: Shingles in a component beyond which it is dealt by pairs of chunks of half that weight.
WEIGHT = 4_000_000
# Odd multipliers.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; of a shorter text its words as a whole, of none none."""
    return np.unique(np.array(shingle_hashes(text, size), np.uint64))


def fingerprint(own: np.ndarray) -> bytes:
    """BITS bits, each set where over half of the shingles have it set."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(own), 255):  # so many ones fit in a byte
        words = own[k : k + 255, None] * _MIX
        words ^= words >> np.uint64(32)
        words *= _MIX[0]
        words ^= words >> np.uint64(29)
        ones += np.unpackbits(words.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(own)).tobytes()


def plan(nodes: int) -> tuple[int, int]:
    """Bits of a key and keys of a node."""
    size = min(40, max(8, ceil(log(max(nodes, 2), 2)) - 2))
    return size, ceil(log(MISSED) / log(1 - EQUAL**size))


def keys_of(prints: np.ndarray, size: int, keys: int) -> np.ndarray:
    """prints: fingerprints, as rows of bytes. Gives the keys of each, one row for each."""
    rng = np.random.default_rng(11)
    chosen = np.stack([rng.permutation(BITS)[:size] for _ in range(keys)])
    bits = np.unpackbits(prints, axis=1)[:, chosen.reshape(-1)].reshape(len(prints), keys, size)
    packed = np.packbits(bits, axis=2)
    out = np.zeros((len(prints), keys), np.int64)
    for k in range(packed.shape[2]):
        out = out << 8 | packed[:, :, k]
    return out << 16 | np.arange(keys)


def links(sets: list[np.ndarray], threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs of sets whose Jaccard similarity reaches the threshold."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[k]) for k in order], np.int64)
    order, size = order[size > 0], size[size > 0]
    if len(order) < 2:
        return []
    codes = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)[1].astype(np.int32)
    upto = np.r_[0, np.cumsum(size)]
    mark = np.zeros(int(codes.max()) + 1, bool)
    left, out = np.arange(len(order)), []  # left: not reached yet, by size
    flat, start, wide = codes, upto[:-1], size
    while len(left):
        todo = [int(left[0])]
        reached = np.zeros(len(left), bool)
        reached[0] = True
        while True:
            if reached.any():
                alive = ~reached
                flat, left, wide = flat[np.repeat(alive, wide)], left[alive], wide[alive]
                start = np.r_[0, np.cumsum(wide)][:-1]
            if not todo or not len(left):
                break
            x = todo.pop()
            own, n = codes[upto[x] : upto[x + 1]], int(size[x])
            a, b = np.searchsorted(wide, [n * threshold - 1e-9, n / threshold + 1e-9])
            b = int(np.searchsorted(wide, n / threshold + 1e-9, "right"))
            reached = np.zeros(len(left), bool)
            if a < b:
                mark[own] = True
                end = start[b - 1] + wide[b - 1]
                both = np.add.reduceat(mark[flat[start[a] : end]], start[a:b] - start[a], dtype=np.int64)
                mark[own] = False
                reached[a:b] = both >= threshold * (n + wide[a:b] - both) - 1e-9
                for y in left[reached].tolist():
                    out.append((int(order[x]), int(order[y])))
                    todo.append(y)
    return out


def node_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, node (a hash of the set of shingles), n (their number) and print (their fingerprint) for each row of docs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(x) for x in batch.column(2).to_pylist()]
        node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array([fingerprint(s) for s in sets], pa.binary())], names=["doc_id", "text_hash", "node", "n", "print"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    return common.map_batches(picked, run, f"doc_id {kind}, text_hash long, node long, n long, print binary")


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """nodes: node, print, staged. Edges (a, b) that span the nodes within NEAR of the bits kept, in any bucket."""
    size, number = plan(nodes.count())
    words = KEPT // 64

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, BITS // 8)
        keys = keys_of(prints, size, number).reshape(-1)
        kept = np.repeat(np.ascontiguousarray(prints[:, : KEPT // 8]).view(np.int64), number, axis=0)
        node = np.repeat(batch.column(0).to_numpy(), number)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(node), *(pa.array(np.ascontiguousarray(kept[:, k])) for k in range(words))], names=["key", "node", *(f"w{k}" for k in range(words))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, node, *kept in by_key(batches):
            a, b = bucket_forest(keys, np.stack(kept, axis=1).view(np.uint64), NEAR)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    dealt = common.map_batches(nodes.select("node", "print"), deal, "key long, node long, " + ", ".join(f"w{k} long" for k in range(words)))
    found = dealt.repartition(common.parts(nodes.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    return common.staged(found.distinct(), "near-candidates")


def verified_edges(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, weight: int = WEIGHT) -> DataFrame:
    """rows: node_rows() of docs, staged. Gives edges (a, b) of nodes whose components are those of the links."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    nodes = common.staged(rows.where("n > 0").groupBy("node").agg(first.alias("row"), F.first("n").alias("n"), F.first("print").alias("print")), "nodes")
    near = candidate_edges(nodes)
    group = components(near)
    alike = common.staged(group.withColumnRenamed("node", "of"), "alike")
    common.dropped(near)
    common.dropped(group)
    met = nodes.select("node", "row", "n").join(common.sized(alike), F.col("node") == F.col("of")).select("node", "component", F.col("row.doc_id").alias("k"), F.col("row.text_hash").alias("t"), "n")
    met = members = common.staged(met, "members")
    heavy = common.staged(met.groupBy(F.col("component").alias("c")).agg(F.sum("n").alias("weight")).where(F.col("weight") > weight), "heavy")
    chunks = F.coalesce(F.ceil(F.col("weight") * 2 / weight), F.lit(1)).cast("int")
    met = met.join(common.sized(heavy), F.col("component") == F.col("c"), "left").select("node", "component", "k", "t", chunks.alias("chunks"))
    texts = docs.select(F.col(id_col).alias("i"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    small = common.staged(met, "looked-up")
    texts = texts.join(common.sized(small), F.col("i").eqNullSafe(F.col("k")) & (F.col("h") == F.col("t")))

    def cells(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingle_set(x).tobytes() for x in batch.column(3).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())], names=["node", "component", "chunks", "cells"])

    own = common.map_batches(texts.select("node", "component", "chunks", "text"), cells, "node long, component long, chunks int, cells binary")
    own = own.withColumn("c", F.expr("int(pmod(xxhash64(node, 7), chunks))")).withColumn("d", F.explode(F.expr("sequence(0, chunks - 1)")))
    placed = own.select(F.xxhash64("component", F.least("c", "d"), F.greatest("c", "d")).alias("key"), "node", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(names: list[int], sets: list[bytes]) -> pa.RecordBatch:
            found = links([np.frombuffer(c, np.uint64) for c in sets], threshold)
            return pa.RecordBatch.from_arrays([pa.array([names[x] for x, _ in found], pa.int64()), pa.array([names[y] for _, y in found], pa.int64())], names=["a", "b"])

        key, names, sets = None, [], []
        for batch in batches:
            for k, n, c in zip(*(batch.column(j).to_pylist() for j in range(3))):
                if k != key and names:
                    yield edges(names, sets)
                    names, sets = [], []
                if k != key or n != names[-1]:  # a row that repeats id and text comes twice
                    names.append(n)
                    sets.append(c)
                key = k
        if names:
            yield edges(names, sets)

    found = placed.repartition(common.parts(docs.sparkSession), "key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long")
    found = common.staged(found.distinct(), "near-texts")
    for table in (nodes, alike, members, heavy, small):
        common.dropped(table)
    return found


def drop_near_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each component of docs: of the smallest id (null last), then of the smallest hash of the text.

    Null and empty texts have no shingle and are one component. Rows that repeat id and text leave one."""
    rows = common.staged(node_rows(docs, id_col, text_col), "shingles")
    edges = verified_edges(docs, rows, id_col, text_col, threshold)
    group = components(edges)
    named = rows.select("doc_id", "text_hash", "node").join(group.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    keyed = named.groupBy("doc_id", "text_hash", F.coalesce("component", "node").alias("component")).agg(F.count(F.lit(1)).alias("n"))
    keyed = common.staged(keyed, "keys")
    best = keyed.groupBy(F.col("component").alias("c")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("best"), F.sum("n").alias("rows"))
    best = common.staged(best.where("rows > 1").select("c", "best"), "best")
    judged = keyed.join(common.sized(best), F.col("component") == F.col("c"))
    wins = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))
    odd = common.staged(judged.where(~wins | (F.col("n") > 1)).select(F.col("doc_id").alias("k"), F.col("text_hash").alias("t"), wins.alias("wins")), "decided")
    for table in (rows, edges, group, keyed, best):
        common.dropped(table)
    same = lambda keys: docs[id_col].eqNullSafe(keys.k) & (F.xxhash64(docs[text_col]) == keys.t)
    once = docs.join(common.sized(odd), same(odd), "left_anti")
    repeated = odd.where("wins")
    first, mark = docs.join(common.sized(repeated, odd), same(repeated), "left_semi"), common.free_name(docs, "text_hash")
    return once.union(first.withColumn(mark, F.xxhash64(text_col)).dropDuplicates([id_col, mark]).drop(mark))
