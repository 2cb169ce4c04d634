"""Masked pseudo-likelihood of documents with a bidirectional window network.

Every token is predicted from the two tokens on either side; a document's score is the sum of the conditional log
probabilities of all its tokens. The vocabulary is every word of the corpus:

    P(word | context) = P(group | context) * P(leaf | group, context) * P(word | leaf)

The network gives the first two, a softmax in two steps over GROUPS * GROUPS leaves: the TOP words that are most frequent
over all documents have a leaf each, and all others share BUCKETS leaves by a hash. The last is 1 for the former; for
the others it is the word's share of its leaf's tokens, by the counts of all words over all documents.

1. Words are counted over all documents, first within a task.
2. Texts become arrays of leaves, a table. The counts of up to KNOWN most frequent words are broadcast (a fixed size);
   the words beyond are joined with their counts. None of these is frequent, so no key of that join is hot.
3. The network is trained in numpy on the windows at every position of all documents: each task goes over its part of
   the table, from the current weights, and the weights that the tasks reach are averaged by their windows. Nothing is
   shuffled for that, so copies of a text never meet in a task, and a task holds BUFFER windows at a time.
4. Scores are the network's sums of each row and the logarithms of the shares.

Only weights, the KNOWN counts and a histogram come to the driver: sizes that are fixed by parameters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SIDE, WIDTH, GROUPS, BUCKETS = 2, 16, 64, 127
#: Leaf 0 lies beyond both ends of a document; words and buckets follow.
LEAVES = GROUPS * GROUPS
TOP = LEAVES - 1 - BUCKETS
#: Words whose counts are broadcast, at most (16 bytes each).
KNOWN = 1 << 18
ROUNDS, RATE = 2, 0.25
#: Windows that a task holds, and the most and fewest that make a step; between them a task has STEPS steps or more.
BUFFER, STEP, LEAST_STEP, STEPS = 262_144, 16_384, 256, 200
#: Tasks that train, at most: each sends its weights once a round.
SHARDS = 4096
#: Words that a worker keeps with their numbers.
STORE = 300_000
#: Parts in which weights are averaged.
PARTS = 16
SHAPES = ((2 * SIDE, LEAVES, WIDTH), (WIDTH, GROUPS), (GROUPS,), (GROUPS, WIDTH, GROUPS), (GROUPS, GROUPS))


def tokens_of(text: str | None) -> list[bytes]:
    """Lower-case tokens between ASCII white space; word_of() gives their words."""
    return (text or "").encode().lower().split()


def word_of(token: bytes) -> bytes:
    return token.strip(b".,;:!?") or token


def word_hash(token: bytes) -> int:
    h = xxhash.xxh64_intdigest(word_of(token))
    return h - (1 << 64) if h >> 63 else h


def words_of(text: str | None) -> list[bytes]:
    return [word_of(t) for t in tokens_of(text)]


def leaf_of(number):
    """The leaf of the number-th word by frequency (from 1; then the buckets): neighbours in frequency lie in different groups."""
    return number % GROUPS * GROUPS + number // GROUPS


# --- the network


def windows(texts: list[np.ndarray]) -> np.ndarray:
    """For each token: the leaves on its left and right, then its own, as columns."""
    gap = np.zeros(SIDE, np.uint16)
    flat = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
    at = np.flatnonzero(flat)
    return np.stack([flat[at + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1), 0)])


class Network:
    """Weights lie in one array. Arrays of a step are kept and used again, as fresh ones cost more than the sums in them."""

    def __init__(self, weights: np.ndarray | None = None):
        if weights is None:
            rng = np.random.default_rng(7)
            weights = np.concatenate([rng.normal(0, 0.1, np.prod(s)) if len(s) > 2 or s[0] == WIDTH else np.zeros(np.prod(s)) for s in SHAPES])
        self.flat = np.array(weights, np.float32)
        self.near, self.group, self.group_bias, self.leaf, self.leaf_bias = self._parts(self.flat)
        self.room: dict[str, np.ndarray] = {}
        self.seen = np.full(len(self.flat), 1e-7, np.float32)

    @staticmethod
    def _parts(flat: np.ndarray) -> list[np.ndarray]:
        at, parts = 0, []
        for s in SHAPES:
            parts.append(flat[at : at + int(np.prod(s))].reshape(s))
            at += int(np.prod(s))
        return parts

    def _room(self, name: str, n: int, width: int) -> np.ndarray:
        if name not in self.room or len(self.room[name]) < n:
            self.room[name] = np.empty((max(n, STEP), width), np.float32)
        return self.room[name][:n]

    def _forward(self, w: np.ndarray):
        """Of windows sorted by their word's group: these, the order, where groups begin, hidden values, and the scores of
        the leaves within the group and of the groups."""
        own = w[-1] // GROUPS
        order = np.argsort(own, kind="stable")
        w, own = w[:, order], own[order]
        n = len(own)
        cut = np.r_[0, np.cumsum(np.bincount(own, minlength=GROUPS))]
        hidden, more = self._room("hidden", n, WIDTH), self._room("more", n, WIDTH)
        np.take(self.near[0], w[0], axis=0, out=hidden, mode="clip")
        for k in range(1, 2 * SIDE):
            np.take(self.near[k], w[k], axis=0, out=more, mode="clip")
            hidden += more
        np.tanh(hidden, out=hidden)
        inner, outer = self._room("inner", n, GROUPS), self._room("outer", n, GROUPS)
        for g in np.flatnonzero(np.diff(cut)):
            part = inner[cut[g] : cut[g + 1]]
            np.matmul(hidden[cut[g] : cut[g + 1]], self.leaf[g], out=part)
            part += self.leaf_bias[g]
        np.matmul(hidden, self.group, out=outer)
        outer += self.group_bias
        for z in (inner, outer):  # far above what weights reach, far below what overflows
            if z.max(initial=0) > 60:
                np.minimum(z, 60, out=z)
        return w, order, cut, hidden, inner, outer

    def log_probabilities(self, w: np.ndarray, at_once: int = STEP) -> np.ndarray:
        """Of each window's token given those around it."""
        out, ones = np.empty(w.shape[1]), np.ones(GROUPS, np.float32)
        for a in range(0, w.shape[1], at_once):
            x, order, _, _, inner, outer = self._forward(w[:, a : a + at_once])
            at = np.arange(len(order))
            told = inner[at, x[-1] % GROUPS] + outer[at, x[-1] // GROUPS]
            for z in (inner, outer):
                np.exp(z, out=z)
                told -= np.log(z @ ones)
            out[a + order] = told
        return out

    def gradient(self, w: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Of the mean loss of these windows: of all weights but those near, one after the other; and of the latter, for
        each place in a window, the leaves that occur there and the gradients of their rows."""
        w, _, cut, hidden, inner, outer = self._forward(w)
        n, at = w.shape[1], np.arange(w.shape[1])
        ones, back, more = np.ones(max(n, GROUPS), np.float32), self._room("back", n, WIDTH), self._room("more", n, WIDTH)
        for z, y in ((inner, w[-1] % GROUPS), (outer, w[-1] // GROUPS)):
            np.exp(z, out=z)
            z *= (1 / (n * (z @ ones[:GROUPS])))[:, None]
            z[at, y] -= np.float32(1 / n)
        flat = self.room.setdefault("gradient", np.empty(len(self.flat), np.float32))
        _, group, group_bias, leaf, leaf_bias = self._parts(flat)
        leaf[:] = 0
        leaf_bias[:] = 0
        for g in np.flatnonzero(np.diff(cut)):
            s = slice(cut[g], cut[g + 1])
            np.matmul(hidden[s].T, inner[s], out=leaf[g])
            np.matmul(ones[: cut[g + 1] - cut[g]], inner[s], out=leaf_bias[g])
            np.matmul(inner[s], self.leaf[g].T, out=back[s])
        np.matmul(hidden.T, outer, out=group)
        np.matmul(ones[:n], outer, out=group_bias)
        np.matmul(outer, self.group.T, out=more)
        back += more
        np.multiply(hidden, hidden, out=more)
        np.subtract(1, more, out=more)
        back *= more
        near = []
        for k in range(2 * SIDE):  # rows of one leaf are added up
            by = np.argsort(w[k], kind="stable")
            x = w[k][by]
            first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
            np.take(back, by, axis=0, out=more, mode="clip")
            near.append((x[first], np.add.reduceat(more, first, axis=0)))
        return flat[self.near.size :], near

    def step(self, w: np.ndarray, rate: float = RATE) -> None:
        """One step of Adagrad."""
        rest, near = self.gradient(w)
        seen_near = self._parts(self.seen)[0]
        for k, (rows, grad) in enumerate(near):
            seen = seen_near[k][rows] + grad * grad
            seen_near[k][rows] = seen
            self.near[k][rows] -= rate * grad / np.sqrt(seen)
        seen, size = self.seen[self.near.size :], self.room.setdefault("size", np.empty(len(rest), np.float32))
        np.multiply(rest, rest, out=size)
        seen += size
        np.sqrt(seen, out=size)
        rest /= size
        rest *= rate
        self.flat[self.near.size :] -= rest


# --- what is gathered from the corpus


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word (a hash), n over all documents; a task adds up its own before the shuffle."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([word_hash(t) for t in counts], pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for part in common.slices(batch):
                for x in part.column(0).to_pylist():
                    counts.update(tokens_of(x))
                if len(counts) > STORE:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)

    return docs.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """What a corpus' counts say: the leaves of the TOP words, the counts of up to KNOWN words, each bucket's tokens."""

    def __init__(self, counts: DataFrame, most: int = KNOWN):
        """counts: word_counts(), staged."""
        level = F.floor(16 * F.log2("n")).cast("int")
        sizes = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
        total, self.level = 0, 1 << 20
        for at, n in sizes:
            total += n
            if total > most:
                break
            self.level = at
        found = counts.where(level >= self.level).select("word", "n").toArrow()
        word, n = (found.column(k).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for k in range(2))
        order = np.lexsort((word, -n))
        word, n = word[order], n[order]
        bucket = np.mod(word, BUCKETS)
        tokens = np.zeros(BUCKETS)
        for r in counts.groupBy(F.pmod("word", F.lit(BUCKETS)).cast("int").alias("bucket")).agg(F.sum("n").alias("n")).collect():
            tokens[r[0]] = r[1]
        self.top = TOP
        np.subtract.at(tokens, bucket[:TOP], n[:TOP])
        self.of_bucket = np.log(np.maximum(tokens, 1))
        leaf = np.where(np.arange(len(word)) < TOP, leaf_of(1 + np.arange(len(word))), leaf_of(1 + TOP + bucket))
        share = np.where(np.arange(len(word)) < TOP, 0, np.log(np.maximum(n, 1)) - self.of_bucket[bucket])
        order = np.argsort(word)
        self.word, self.leaf, self.share = word[order], leaf[order].astype(np.uint16), share[order]

    def beyond(self, counts: DataFrame) -> DataFrame:
        """Words that are not broadcast and occur more than once: word, log_n."""
        return counts.where((F.floor(16 * F.log2("n")).cast("int") < self.level) & (F.col("n") > 1)).select("word", F.log("n").alias("log_n"))


class _Numbers(dict):
    """Numbers tokens as they come."""

    def __missing__(self, token: bytes) -> int:
        self[token] = number = len(self)
        return number


class Coder:
    """Leaves and shares of texts; a worker keeps what it knows of the tokens it has met, up to a bound."""

    def __init__(self, words: Words):
        self.words = words
        self._empty()

    def _empty(self) -> None:
        self.met = _Numbers()
        self.leaf, self.share, self.word, self.rest = np.zeros(0, np.uint16), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, bool)

    def _learn(self, new: list[bytes]) -> None:
        w = self.words
        word = np.array([word_hash(t) for t in new], np.int64)
        at = np.minimum(np.searchsorted(w.word, word), max(len(w.word) - 1, 0))
        known = w.word[at] == word if len(w.word) else np.zeros(len(word), bool)
        bucket = np.mod(word, BUCKETS)
        leaf, share = leaf_of(1 + w.top + bucket), -w.of_bucket[bucket]
        leaf[known], share[known] = w.leaf[at[known]], w.share[at[known]]
        self.leaf, self.share = np.r_[self.leaf, leaf.astype(np.uint16)], np.r_[self.share, share]
        self.word, self.rest = np.r_[self.word, word], np.r_[self.rest, ~known]

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """leaf, share, word, rest (whether the word's count is not known here) of all tokens, and where each text's begin."""
        if len(self.met) > STORE:
            self._empty()
        number, known, flat, upto = self.met.__getitem__, len(self.met), [], [0]
        for t in texts:
            flat.extend(map(number, tokens_of(t)))
            upto.append(len(flat))
        if len(self.met) > known:
            self._learn(list(islice(self.met, known, None)))
        at = np.array(flat, np.int64)
        return self.leaf[at], self.share[at], self.word[at], self.rest[at], np.array(upto)


def coded(docs: DataFrame, words: Words, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a number of its own), doc_id, n_tokens, leaves (bytes), share (sum of the logarithms that are known here), rest
    (words whose count is not) for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(words)  # KNOWN words at most
    made: list[Coder] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Coder(shared.value))
        leaf, share, word, rest, upto = made[0].of(batch.column(2).to_pylist())
        sums = np.r_[0, np.cumsum(share)][upto]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(rest)][upto], pa.int32()), pa.array(word[rest]))
        leaves = [leaf[a:b].tobytes() for a, b in zip(upto[:-1], upto[1:])]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(upto)), pa.array(leaves, pa.binary()), pa.array(np.diff(sums)), lists], names=["row", "doc_id", "n_tokens", "leaves", "share", "rest"])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return common.map_batches(picked, run, f"row long, doc_id {kind}, n_tokens long, leaves binary, share double, rest array<long>")


# --- training and scoring


def trained(tokens: DataFrame, rounds: int = ROUNDS) -> Network:
    """tokens: coded(), staged. With no tokens the network stays as it begins."""
    spark = tokens.sparkSession
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    leaves = tokens.select("leaves")
    shards = max(1, leaves.rdd.getNumPartitions())
    if shards > SHARDS:
        leaves, shards = leaves.coalesce(SHARDS), SHARDS
    size = int(np.clip(total // (shards * STEPS), LEAST_STEP, STEP))
    net = Network()
    for number in range(rounds if total else 0):
        weights = spark.sparkContext.broadcast(net.flat)  # fixed in size

        def run(batches, number=number, weights=weights):
            own, rng, n = Network(weights.value), np.random.default_rng(number), 0
            kept, held = [], 0

            def learn():
                w = windows(kept)
                w = w[:, rng.permutation(w.shape[1])]
                for a in range(0, w.shape[1], size):
                    own.step(w[:, a : a + size])
                return w.shape[1]

            for batch in batches:
                for x in batch.column(0):
                    text = np.frombuffer(x.as_buffer(), np.uint16) if x.is_valid else np.zeros(0, np.uint16)
                    for a in range(0, len(text), BUFFER):  # a longer text is learnt from in parts; at a cut windows see one side only
                        kept.append(text[a : a + BUFFER])
                        held += len(kept[-1])
                        if held >= BUFFER:
                            n += learn()
                            kept, held = [], 0
            if held:
                n += learn()
            if n:
                parts = np.array_split(own.flat, PARTS)
                yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([n] * PARTS, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], names=["part", "n", "w"])

        def averaged(batches):
            sums: dict[int, list] = {}
            for batch in batches:
                for part, n, w in zip(*(c.to_pylist() for c in batch.columns)):
                    now = sums.setdefault(part, [0, 0.0])
                    now[0] += n
                    now[1] = now[1] + n * np.frombuffer(w, np.float32).astype(np.float64)
            if sums:
                yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([(s / n).astype(np.float32).tobytes() for n, s in sums.values()], pa.binary())], names=["part", "w"])

        reached = leaves.mapInArrow(run, "part int, n long, w binary").repartition(PARTS, "part").mapInArrow(averaged, "part int, w binary")
        net = Network(np.concatenate([np.frombuffer(r[1], np.float32) for r in sorted(reached.collect())]))
        weights.unpersist()
    return net


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, known: int = KNOWN) -> DataFrame:
    """One row for each row of docs: doc_id, n_tokens, log_likelihood (the sum), per_token (its mean; null without a token).

    A null or empty text has no token and log_likelihood 0. Repeated rows give repeated rows; an empty table gives none;
    of other columns none is read, so their names don't matter."""
    counts = common.staged(word_counts(docs, text_col), "words")
    words = Words(counts, known)
    tokens = common.staged(coded(docs, words, id_col, text_col), "tokens")
    rare = tokens.select("row", F.explode("rest").alias("w")).join(words.beyond(counts), F.col("w") == F.col("word"))
    rare = common.staged(rare.groupBy(F.col("row").alias("of")).agg(F.sum("log_n").alias("more")), "shares")
    common.dropped(counts)
    net = trained(tokens, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(net.flat)
    made: list[Network] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Network(shared.value))
        texts = [np.frombuffer(x, np.uint16) for x in batch.column(4).to_pylist()]
        upto = np.r_[0, np.cumsum(batch.column(2).to_numpy())]
        sums = np.diff(np.r_[0, np.cumsum(made[0].log_probabilities(windows(texts)))][upto])
        return pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sums)], names=["row", "doc_id", "n_tokens", "share", "of_leaves"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = common.map_batches(tokens.select("row", "doc_id", "n_tokens", "share", "leaves"), run, f"row long, doc_id {kind}, n_tokens long, share double, of_leaves double")
    out = rows.join(common.sized(rare), F.col("row") == F.col("of"), "left")
    out = out.withColumn("log_likelihood", F.when(F.col("n_tokens") > 0, F.col("of_leaves") + F.col("share") + F.coalesce("more", F.lit(0.0))).otherwise(0.0))
    per_token = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.select("doc_id", "n_tokens", "log_likelihood", per_token.alias("per_token"))


def op8_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents"))
