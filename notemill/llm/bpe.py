"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Pieces (pre-tokens) of many texts are encoded together: the symbols of all new pieces lie in one flat array. In each
round every adjacent pair is looked up by binary search over the sorted pair keys, each piece's lowest-ranked pair is
found, and all its occurrences there are merged, left to right. Pieces repeat, so those seen lately are kept with their
ids; that store is emptied when full and changes no result.
"""

from __future__ import annotations

import hashlib
import json
import re
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TOKENIZER = "byte_bpe_50k.json"
#: Pieces that a worker keeps with their ids.
STORE = 150_000
#: New pieces that go through the merge rounds together.
TOGETHER = 50_000
#: Bytes of a piece beyond which its rounds read only where something changes.
LONG = 2048

# The pattern of byte-level pre-tokenization.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 letters stand for themselves, the others for the code points from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


# The same pattern, without property classes, for texts of these characters only: it runs twice as fast.
_PLAIN_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = re.compile(rf"[\n -~{_PLAIN_LETTERS}]*\Z").match
_PLAIN_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_PLAIN_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_PLAIN_LETTERS}]+|\s+(?!\S)|\s+").findall


class Vocabulary:
    """The tables of a tokenizer file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters, vocab = byte_letters(), told["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in told["added_tokens"]}
        self.size = 1 + max([*vocab.values(), *self.added.values()])
        merges = [x if isinstance(x, list) else x.split(" ") for x in told["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        whole = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = left * self.size + right
        order = np.argsort(keys)
        self.keys, self.rank, self.whole = keys[order], order.astype(np.int64), whole[order]
        self.none = len(keys)
        self.of_byte = np.zeros(256, np.int64)
        data: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            data[i] = bytes(letters[c] for c in token)
            if len(token) == 1:
                self.of_byte[letters[token]] = i
        for token, i in self.added.items():
            data[i] = token.encode()
        self.token_len = np.array([len(x) for x in data], np.int64)
        self.token_at = np.r_[0, np.cumsum(self.token_len)[:-1]]
        self.token_bytes = np.frombuffer(b"".join(data), np.uint8)

    def _look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of pairs; rank none where a pair never merges."""
        pair = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, pair), self.none - 1)
        return np.where(self.keys[at] == pair, self.rank[at], self.none), self.whole[at]

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces, one after the other, and where each piece's ids begin (and the last ones end)."""
        if max(map(len, pieces), default=0) <= LONG:
            return self._rounds(pieces)
        ids, begin = self._rounds([p if len(p) <= LONG else b"" for p in pieces])
        lists = [ids[begin[i] : begin[i + 1]] if len(p) <= LONG else self._long(p) for i, p in enumerate(pieces)]
        return np.concatenate(lists), np.r_[0, np.cumsum([len(x) for x in lists])]

    def _long(self, piece: bytes) -> np.ndarray:
        """The ids of one long piece. Its rounds are the same, but a round reads only where its pair occurs: positions
        wait by the rank of the pair that begins there."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[-1] = -1
        rank = np.full(n, self.none)
        whole = np.zeros(n, np.int64)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def look(at: np.ndarray) -> None:
            """Finds the pairs that begin at these positions, which ascend, and lets them wait."""
            last = after[at] < 0
            rank[at[last]] = self.none
            at = at[~last]
            rank[at], whole[at] = self._look(ids[at], ids[after[at]])
            at = at[rank[at] < self.none]
            at = at[np.argsort(rank[at], kind="stable")]
            cut = np.flatnonzero(np.r_[True, np.diff(rank[at]) != 0, True]) if len(at) else np.zeros(1, np.int64)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                r = int(rank[at[a]])
                if r not in waiting:
                    waiting[r] = []
                    heappush(ranks, r)
                waiting[r].append(at[a:b])

        look(np.arange(n))
        while ranks:
            r = heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            # of overlapping occurrences every other one counts, from the left
            begins = np.r_[True, after[at[:-1]] != at[1:]]
            run = np.flatnonzero(begins)
            place = np.arange(len(at))
            at = at[(place - run[np.cumsum(begins) - 1]) % 2 == 0]
            gone = after[at]
            ids[at] = whole[at]
            rank[gone] = self.none
            ids[gone] = -1
            after[at] = after[gone]
            inner = after[at] >= 0
            before[after[at][inner]] = at[inner]
            left = before[at]
            look(np.unique(np.concatenate([at, left[left >= 0]])))
        return ids[ids >= 0]

    def _rounds(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(p) for p in pieces], np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        rank, whole = self._look(ids[:-1], ids[1:])
        rank, whole = np.append(rank, self.none), np.append(whole, 0)
        rank[np.r_[owner[1:] != owner[:-1], True][: len(rank)]] = self.none
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            lowest_here = np.repeat(lowest, np.diff(np.r_[first, len(ids)]))
            live = lowest_here < self.none
            if not live.all():
                done.append((owner[~live], ids[~live]))
                ids, owner, rank, whole, lowest_here = (x[live] for x in (ids, owner, rank, whole, lowest_here))
                if not len(ids):
                    break
            hit = rank == lowest_here
            # of overlapping occurrences (a a a) every other one counts, from the left
            where = np.flatnonzero(hit)
            run = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
            where = where[(where - run[np.searchsorted(run, where, "right") - 1]) % 2 == 0]
            ids[where] = whole[where]
            stay = np.ones(len(ids), bool)
            stay[where + 1] = False
            new = np.zeros(len(ids), bool)
            new[where] = True
            ids, owner, rank, whole, new = (x[stay] for x in (ids, owner, rank, whole, new))
            # only the pairs that begin or end in a merged symbol have changed
            again = np.flatnonzero(new | np.r_[new[1:], False])
            last = np.r_[owner[1:] != owner[:-1], True][again]
            rank[again[last]] = self.none
            again = again[~last]
            rank[again], whole[again] = self._look(ids[again], ids[again + 1])
        if done:
            owner, ids = np.concatenate([x[0] for x in done]), np.concatenate([x[1] for x in done])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.r_[0, np.cumsum(np.bincount(owner, minlength=len(pieces)))]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after the other."""
        size = self.token_len[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.token_bytes[np.arange(total) + np.repeat(self.token_at[ids] - (end - size), size)]


class _Store(dict):
    """Numbers pieces as they come; new has those that have no ids yet."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        self.new.append(piece)
        return number


class Coder:
    """Encodes and decodes texts with a vocabulary; encode_special: added tokens' strings in a text become their ids."""

    def __init__(self, vocabulary: Vocabulary, encode_special: bool = True):
        self.v = vocabulary
        self.find_any = regex.compile(PIECES).findall
        added = sorted(vocabulary.added, key=len, reverse=True) if encode_special else []
        self.cut = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None
        self._empty()

    def _empty(self) -> None:
        self.known = _Store()
        self.ids, self.begin = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def find(self, text: str) -> list[str]:
        return _PLAIN_PIECES(text) if _PLAIN(text) else self.find_any(text)

    def pieces(self, text: str) -> list[str]:
        if self.cut is None or not any(a in text for a in self.v.added):
            return self.find(text)
        out: list[str] = []
        for k, part in enumerate(self.cut.split(text)):
            # a zero byte and more mark an added token: no piece from the pattern mixes these
            out += ["\0 " + part] if k % 2 else self.find(part)
        return out

    def _learn(self, new: list[str]) -> None:
        for k in range(0, len(new), TOGETHER):
            some = new[k : k + TOGETHER]
            marked = [p.startswith("\0 ") for p in some]
            ids, begin = self.v.merge([b"" if m else p.encode() for p, m in zip(some, marked)])
            if any(marked):
                lists = [np.array([self.v.added[p[2:]]]) if m else ids[begin[i] : begin[i + 1]] for i, (p, m) in enumerate(zip(some, marked))]
                ids, begin = np.concatenate(lists), np.r_[0, np.cumsum([len(x) for x in lists])]
            self.begin = np.r_[self.begin, len(self.ids) + begin[1:]]
            self.ids = np.r_[self.ids, ids]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and where each text's ids begin (and the last ones end)."""
        if len(self.known) > STORE:
            self._empty()
        number = self.known.__getitem__
        counts = [0]
        flat: list[int] = []
        for t in texts:
            if t:
                flat.extend(map(number, self.pieces(t)))
            counts.append(len(flat))
        new, self.known.new = self.known.new, []
        self._learn(new)
        which = np.array(flat, np.int64)
        size = self.begin[which + 1] - self.begin[which]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        ids = self.ids[np.arange(total) + np.repeat(self.begin[which] - (end - size), size)]
        upto = np.r_[0, end][np.array(counts)]
        return ids, upto

    def decode(self, ids: np.ndarray, upto: np.ndarray) -> list[str]:
        data = self.v.bytes_of(ids)
        at = np.r_[0, np.cumsum(self.v.token_len[ids])][upto]
        whole = data.tobytes()
        return [whole[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:])]


def vocabulary_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def coder_in_worker(spark: SparkSession, path: str, encode_special: bool = True):
    """A function that gives the coder inside a worker. The tables (some MB, fixed by the file) are broadcast, so workers need no file."""
    shared = spark.sparkContext.broadcast(Vocabulary(path))
    made: list[Coder] = []

    def get() -> Coder:
        if not made:
            made.append(Coder(shared.value, encode_special))
        return made[0]

    return get


def _slices(texts: list[str | None]) -> list[tuple[int, int]]:
    """Runs of texts of about common.BLOCK_BYTES."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= common.BLOCK_BYTES:
            out.append((start, i + 1))
            start, size = i + 1, 0
    return [*out, (start, len(texts))] if start < len(texts) else out


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> for each row; null and empty texts have no ids."""
    get = coder_in_worker(docs.sparkSession, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, ids, upto = batch.column(1).to_pylist(), [], [np.zeros(1, np.int64)]
        for a, b in _slices(texts):
            x, u = get().encode(texts[a:b])
            ids.append(x)
            upto.append(u[1:] + upto[-1][-1])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(upto), pa.int32()), pa.array(np.concatenate([*ids, np.zeros(0, np.int64)]), pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; a null list decodes to the empty text. Bytes that aren't UTF-8 become U+FFFD."""
    get = coder_in_worker(encoded.sparkSession, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = [np.array(x or [], np.int64) for x in batch.column(1).to_pylist()]
        texts = get().decode(np.concatenate(lists), np.r_[0, np.cumsum([len(x) for x in lists])])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return common.map_batches(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, text string")


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text is encoded, and its ids decoded again, in one pass.

    A null text is empty and has no tokens; repeated rows give repeated rows; an empty table gives none; other columns
    aren't read."""
    get = coder_in_worker(docs.sparkSession, path)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        n, of_ids, of_text = [], [], []
        for a, b in _slices(texts):
            ids, upto = get().encode(texts[a:b])
            back = get().decode(ids, upto)
            for k, text in enumerate(back):
                own = ids[upto[k] : upto[k + 1]]
                n.append(len(own))
                of_ids.append(hashlib.sha256(",".join(map(str, own.tolist())).encode()).hexdigest())
                of_text.append(hashlib.sha256(text.encode()).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return common.map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), vocabulary_path())
