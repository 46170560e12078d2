"""Language-model scoring with an n-gram trie in Elias-Fano levels, cut into shards.

Texts are dealt into chunks of bounded size. A chunk sends its distinct unigrams, word
pairs and triples to shards, with their counts in its training texts. A shard adds the
counts of all chunks, builds its part of the trie, maps it into memory from a file, and
answers every chunk for what that chunk asked. The chunk then adds up the probabilities.
No table of n-grams passes through the driver or is held whole anywhere.

The model interpolates orders 3, 2 and 1 with Dirichlet smoothing: an order's estimate is
``(count + k * lower) / (context count + k)``, and the lowest is add-one over all words.
"""

from __future__ import annotations

import ctypes
import inspect
import mmap
import os
import sys
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.llm.hashing import mix, word_hashes

_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Hash of the token that ends every text.
END = np.uint64(0x5851F42D4C957F2D)
#: Bits of a word pair's and of a following word's identity inside the trie.
PAIR_BITS, WORD_BITS = 42, 24


class EliasFano:
    """A rising sequence of whole numbers: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low = n, low_bits, low
        ones = np.flatnonzero(np.unpackbits(high, bitorder="little"))[:n] if n else np.zeros(0, np.int64)
        self.high = ones - np.arange(n)

    @staticmethod
    def encode(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
        n = len(values)
        if not n:
            return 0, 0, b"", b""
        values = values.astype(np.uint64)
        bits = max(0, ((int(values[-1]) + 1) // n).bit_length() - 1)
        low = values & np.uint64((1 << bits) - 1)
        words = np.zeros((n * bits + 63) // 64 + 1, np.uint64)
        at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(words, word, low << shift)
        over = shift + np.uint64(bits) > 64
        np.bitwise_or.at(words, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        unary = np.zeros(int(ones[-1]) + 1, bool)
        unary[ones] = True
        return n, bits, words.tobytes(), np.packbits(unary, bitorder="little").tobytes()

    def get(self, at: np.ndarray) -> np.ndarray:
        """Values at positions."""
        if not self.low_bits:
            return self.high[at].astype(np.uint64)
        bit = at.astype(np.uint64) * np.uint64(self.low_bits)
        word, shift = (bit >> np.uint64(6)).astype(np.int64), bit & np.uint64(63)
        value = self.low[word] >> shift
        over = shift > 0
        value[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return (self.high[at].astype(np.uint64) << np.uint64(self.low_bits)) | (value & np.uint64((1 << self.low_bits) - 1))

    def successor(self, wanted: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """First position in [start, stop) whose value is not below the wanted one, else stop."""
        start, stop = start.copy(), stop.copy()
        while (open_ := np.flatnonzero(start < stop)).size:
            middle = (start[open_] + stop[open_]) >> 1
            below = self.get(middle) < wanted[open_]
            start[open_[below]] = middle[below] + 1
            stop[open_[~below]] = middle[~below]
        return start

    def bucket(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of positions that share the wanted values' high bits."""
        high = (wanted >> np.uint64(self.low_bits)).astype(np.int64)
        return np.searchsorted(self.high, high, "left"), np.searchsorted(self.high, high, "right")


@dataclass(frozen=True)
class Quantiser:
    """Logarithms (base 10) in [least, 0] as codes 1 to 255; 0 is for what is not there."""

    least: float

    def codes(self, p: np.ndarray) -> np.ndarray:
        return np.clip(np.rint(1 + 254 * (np.log10(p) - self.least) / -self.least), 1, 255).astype(np.uint8)

    def values(self, codes: np.ndarray) -> np.ndarray:
        table = np.concatenate(([0.0], 10 ** (self.least - self.least * np.arange(255) / 254)))
        return table[codes]


#: Joint probability of a pair, and probability of a word after a pair.
PAIR_Q, NEXT_Q = Quantiser(-13.0), Quantiser(-7.0)


class Trie:
    """Pairs and the words after them, in three memory-mapped levels.

    Level one holds the pairs' identities and quantised joint probabilities. Monotone
    pointers lead to a pair's children. Level two holds, per pair, the identities of the
    words that follow it, made rising by the pair's number, and quantised probabilities.
    """

    def __init__(self, folder: str, pairs: np.ndarray, pair_codes: np.ndarray, pointers: np.ndarray, words: np.ndarray, word_codes: np.ndarray):
        parent = np.repeat(np.arange(len(pairs), dtype=np.uint64), np.diff(pointers))
        rising = (parent << np.uint64(WORD_BITS)) | words.astype(np.uint64)
        self.pairs = self._level(folder, "pairs", pairs)
        self.pointers = self._level(folder, "pointers", pointers)
        self.words = self._level(folder, "words", rising)
        self.pair_codes = self._map(folder, "pair_codes", pair_codes.tobytes(), np.uint8)
        self.word_codes = self._map(folder, "word_codes", word_codes.tobytes(), np.uint8)

    def _map(self, folder: str, name: str, data: bytes, kind) -> np.ndarray:
        if not data:
            return np.zeros(0, kind)
        with open(os.path.join(folder, name), "w+b") as f:
            f.write(data)
            f.flush()
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), kind)

    def _level(self, folder: str, name: str, values: np.ndarray) -> EliasFano:
        n, bits, low, high = EliasFano.encode(values)
        return EliasFano(n, bits, self._map(folder, name + "_low", low, np.uint64), self._map(folder, name + "_high", high, np.uint8))

    def find_pairs(self, wanted: np.ndarray) -> np.ndarray:
        """Numbers of the pairs, -1 for those that are not there."""
        start, stop = self.pairs.bucket(wanted)
        at = self.pairs.successor(wanted, start, stop)
        found = at < stop
        found[found] = self.pairs.get(at[found]) == wanted[found]
        return np.where(found, at, -1)

    def find_words(self, pair: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Codes of words after pairs (numbers, or -1); 0 for those that are not there."""
        out, known = np.zeros(len(pair), np.uint8), np.flatnonzero(pair >= 0)
        p = pair[known]
        start, stop = (self.pointers.get(p + k).astype(np.int64) for k in (0, 1))
        wanted = (p.astype(np.uint64) << np.uint64(WORD_BITS)) | words[known].astype(np.uint64)
        at = self.words.successor(wanted, start, stop)
        hit = at < stop
        hit[hit] = self.words.get(at[hit]) == wanted[hit]
        out[known[hit]] = self.word_codes[at[hit]]
        return out


def _sums(keys: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of sorted key columns, and their summed counts."""
    if not len(counts):
        return keys, counts
    new = np.zeros(len(counts), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return [k[at] for k in keys], np.add.reduceat(counts, at)


def _numbered(values: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values, the number of each value among them, and how often each was learnt."""
    distinct, number = np.unique(values, return_inverse=True)
    number = number.astype(np.int32)
    return distinct, number, np.bincount(number[learnt], minlength=len(distinct))


def _range_shard(identity: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the identities, which are hashes: even, and close together inside a shard."""
    return ((identity >> np.uint64(PAIR_BITS - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as planes of bytes, as many as the largest needs; the shuffle compresses empty planes away."""
    values = values.astype(np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(np.uint64).ravel()


class Chunk:
    """The tokens of some texts, numbered by distinct unigram, pair and triple."""

    def __init__(self, texts: list[str | None], train: np.ndarray, shards: int):
        words, at = word_hashes(texts)
        self.offsets = at + np.arange(len(at))  # one more token per text
        size, lengths = int(self.offsets[-1]), np.diff(self.offsets)
        tokens = np.empty(size, np.uint64)
        ends = self.offsets[1:] - 1
        is_word = np.ones(size, bool)
        is_word[ends] = False
        tokens[is_word], tokens[ends] = words, END
        del words, is_word
        place = np.arange(size, dtype=np.int32) - np.repeat(self.offsets[:-1].astype(np.int32), lengths)
        self.at2, self.at3 = (np.flatnonzero(place >= k).astype(np.int32) for k in (1, 2))
        del place
        learnt = np.repeat(train, lengths)
        self.words, self.word_of, self.word_counts = _numbered(tokens, learnt)
        self.word_shard = _range_shard(self.words >> np.uint64(64 - PAIR_BITS), shards)

        with np.errstate(over="ignore"):
            pair = mix(tokens[self.at2 - 1] * _STEP + tokens[self.at2]) >> np.uint64(64 - PAIR_BITS)
        self.pairs, self.pair_of, self.pair_counts = _numbered(pair, learnt[self.at2])
        self.pair_shard = _range_shard(self.pairs, shards)
        del pair

        number = np.zeros(size, np.int32)
        number[self.at2] = self.pair_of
        triple = (number[self.at3 - 1].astype(np.uint64) << np.uint64(WORD_BITS)) | (tokens[self.at3] >> np.uint64(64 - WORD_BITS))
        del number, tokens
        triples, self.triple_of, self.triple_counts = _numbered(triple, learnt[self.at3])
        self.triple_pair = (triples >> np.uint64(WORD_BITS)).astype(np.int32)
        self.triple_word = (triples & np.uint64((1 << WORD_BITS) - 1)).astype(np.uint32)
        self.triple_shard = self.pair_shard[self.triple_pair]

    def parts(self, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(shard, indexes of its words, pairs and triples), each in rising order."""
        orders = [np.argsort(s, kind="stable") for s in (self.word_shard, self.pair_shard, self.triple_shard)]
        bounds = [
            np.searchsorted(s[o], np.arange(shards + 1)) for s, o in zip((self.word_shard, self.pair_shard, self.triple_shard), orders, strict=True)
        ]
        for k in range(shards):
            found = [o[b[k] : b[k + 1]] for o, b in zip(orders, bounds, strict=True)]
            if any(map(len, found)):
                yield k, *found


def _message(c: Chunk, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> list[bytes]:
    """What a chunk sends to one shard: rising values as differences, triples grouped by pair."""
    children = np.bincount(np.searchsorted(pairs, c.triple_pair[triples]), minlength=len(pairs)) if len(pairs) else np.zeros(0, int)
    rising = [np.diff(x, prepend=np.uint64(0)) for x in (c.words[words], c.pairs[pairs])]
    sent = [rising[0], c.word_counts[words], rising[1], c.pair_counts[pairs], children, c.triple_word[triples], c.triple_counts[triples]]
    return [pack(x) for x in sent]


_MESSAGE = ("words", "word_counts", "pairs", "pair_counts", "children", "triple_words", "triple_counts")


def _read_message(row: list[bytes]) -> list[np.ndarray]:
    words, word_counts, pairs, pair_counts, children, triple_words, triple_counts = map(unpack, row)
    whole = [x.astype(np.int64) for x in (word_counts, pair_counts, children, triple_counts)]
    return [np.cumsum(words, dtype=np.uint64), whole[0], np.cumsum(pairs, dtype=np.uint64), whole[1], whole[2], triple_words.astype(np.uint32), whole[3]]


def _known(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    (values,), counts = _sums([values[order]], counts[order])
    return values[counts > 0], counts[counts > 0]


def answer(messages: list[list[bytes]], total: int, k: float) -> list[tuple[bytes, bytes, bytes]]:
    """A shard's answers: per message the words' counts, the pairs' and the triples' codes."""
    read = [_read_message(m) for m in messages]
    words, word_counts = _known(np.concatenate([r[0] for r in read]), np.concatenate([r[1] for r in read]))
    pairs, pair_counts = _known(np.concatenate([r[2] for r in read]), np.concatenate([r[3] for r in read]))
    parents, nexts, counts = [], [], []
    for r in read:  # only what training texts hold enters the trie
        seen = r[6] > 0
        parents.append(np.repeat(r[2], r[4])[seen])
        nexts.append(r[5][seen])
        counts.append(r[6][seen])
    parent, word, count = np.concatenate(parents), np.concatenate(nexts), np.concatenate(counts)
    number = np.searchsorted(pairs, parent).astype(np.uint64)
    key = (number << np.uint64(WORD_BITS)) | word
    order = np.argsort(key, kind="stable")
    (key,), count = _sums([key[order]], count[order])
    number = (key >> np.uint64(WORD_BITS)).astype(np.int64)
    pointers = np.searchsorted(number, np.arange(len(pairs) + 1)).astype(np.int64)
    pair_codes = PAIR_Q.codes(pair_counts / max(total, 1))
    context = PAIR_Q.values(pair_codes) * max(total, 1)
    word_codes = NEXT_Q.codes(np.minimum(count / (context[number] + k), 1.0))
    out = []
    with tempfile.TemporaryDirectory() as folder:
        trie = Trie(folder, pairs, pair_codes, pointers, (key & np.uint64((1 << WORD_BITS) - 1)).astype(np.uint32), word_codes)
        for r in read:
            at = np.searchsorted(words, r[0])
            at[at == len(words)] = 0
            hit = words[at] == r[0] if len(words) else np.zeros(len(r[0]), bool)
            found = np.where(hit, word_counts[at] if len(words) else 0, 0)
            numbers = trie.find_pairs(r[2])
            codes = np.where(numbers >= 0, trie.pair_codes[numbers] if len(pairs) else 0, 0).astype(np.uint8)
            nexts_ = trie.find_words(np.repeat(numbers, r[4]), r[5])
            out.append((pack(found), codes.tobytes(), nexts_.tobytes()))
        del trie
    return out


def score(c: Chunk, counts: np.ndarray, pair_codes: np.ndarray, next_codes: np.ndarray, total: int, distinct: int, k: float) -> dict[str, np.ndarray]:
    """Per text the columns of the result."""
    floor = total + 1 * (distinct + 1)
    one = counts[c.word_of]
    p = (one + 1) / floor
    base = np.log10(p)
    joint = np.zeros(len(one))
    joint[c.at2] = PAIR_Q.values(pair_codes[c.pair_of]) * max(total, 1)
    p2 = p.copy()
    p2[c.at2] = (joint[c.at2] + k * p[c.at2]) / (np.maximum(one[c.at2 - 1], joint[c.at2]) + k)
    p3 = p2.copy()
    context = joint[c.at3 - 1]
    p3[c.at3] = NEXT_Q.values(next_codes[c.triple_of]) + k / (context + k) * p2[c.at3]
    starts = c.offsets[:-1]
    add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0, x.dtype)
    return {
        "n_tokens": np.diff(c.offsets), "n_known": add((one > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(np.minimum(p3, 1.0))),
    }


def _dealt(documents: DataFrame, chunk_bytes: int) -> tuple[DataFrame, int]:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = documents.select(F.col("doc_id").cast("long"), held.alias("held_out"), text.alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    chunks = max(1, -(-int(size) // chunk_bytes))
    # the text takes part, so that rows that repeat an id spread
    chunk = F.pmod(F.xxhash64("doc_id", F.substring("text", 1, 64)), F.lit(chunks)).cast("int")
    return rows.withColumn("chunk", chunk).repartition(chunks, "chunk"), chunks


def vocabulary_size(documents: DataFrame) -> tuple[int, int]:
    """(training tokens, distinct training tokens); only sums reach the driver."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = documents.filter(~held).select(F.col("text").cast("string"))
    shards = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = [], 0

        def flush() -> pa.RecordBatch:
            every = np.unique(np.concatenate([*seen, np.array([END], np.uint64)]))
            shard = (every % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            bounds = np.searchsorted(shard[order], np.arange(shards + 1))
            blobs = [every[order[i:j]].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(range(shards), pa.int32()), pa.array(blobs, pa.binary()), pa.array([n] + [0] * (shards - 1), pa.int64())], names=["shard", "words", "n"])

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                found, _ = word_hashes(batch.column("text").slice(at, 512).to_pylist())
                n += len(found) + min(512, batch.num_rows - at)
                seen.append(np.unique(found))
                if sum(map(len, seen)) > 3_000_000:
                    yield flush()
                    seen, n = [], 0
        if n:
            yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held_words, n, distinct = None, [], 0, 0
        merged = np.zeros(0, np.uint64)
        for batch in batches:
            for shard, blob, m in zip(*(batch.column(c).to_pylist() for c in ("shard", "words", "n")), strict=True):
                if shard != now:
                    distinct += len(np.unique(np.concatenate([merged, *held_words])))
                    now, held_words, merged = shard, [], np.zeros(0, np.uint64)
                held_words.append(np.frombuffer(blob, np.uint64))
                n += m
                if sum(map(len, held_words)) > 2_000_000:
                    merged, held_words = np.unique(np.concatenate([merged, *held_words])), []
        distinct += len(np.unique(np.concatenate([merged, *held_words])))
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([distinct], pa.int64())], names=["n", "distinct"])

    sent = rows.mapInArrow(words, "shard int, words binary, n long").repartition(shards, "shard").sortWithinPartitions("shard")
    row = sent.mapInArrow(count, "n long, distinct long").agg(F.sum("n"), F.sum("distinct")).first()
    return int(row[0] or 0), int(row[1] or 0)


def _tidy(work):
    """``work`` that hands freed memory back after every group, so that a worker's size does not grow."""

    def run(*tables: pa.Table) -> pa.Table:
        out = work(*tables)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)
        return out

    if len(inspect.signature(work).parameters) == 2:  # Spark looks at the number of arguments
        return lambda left, right: run(left, right)
    return lambda table: run(table)


def score_documents(documents: DataFrame, k: float = 6.0, chunk_bytes: int = 8_000_000, chunks_per_shard: int = 1) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the documents whose crc32(doc_id) mod 7 is not 2 and scores
    all. Words are compared as 64-bit hashes, after A-Z became a-z; every text ends
    with one more token. Null and empty texts have that token alone. A null id counts
    as a training text. Repeated rows each count and each give a row. Without training
    texts all words are unknown. Other columns are not read.
    """
    total, distinct = vocabulary_size(documents)
    dealt, chunks = _dealt(documents, chunk_bytes)
    shards = max(1, -(-chunks // chunks_per_shard))

    def ask(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        c = Chunk(table.column("text").to_pylist(), ~np.array(table.column("held_out").to_pylist(), bool), shards)
        rows = [(shard, chunk, *_message(c, *found)) for shard, *found in c.parts(shards)]
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * len(_MESSAGE)]
        return pa.table([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["shard", "chunk", *_MESSAGE])

    def reply(table: pa.Table) -> pa.Table:
        messages = list(zip(*(table.column(m).to_pylist() for m in _MESSAGE), strict=True))
        found = answer(messages, total, k)
        return pa.table(
            [table.column("chunk"), table.column("shard"), *(pa.array([f[i] for f in found], pa.binary()) for i in range(3))],
            names=["chunk", "shard", "counts", "pair_codes", "next_codes"],
        )

    def finish(texts: pa.Table, replies: pa.Table) -> pa.Table:
        held = texts.column("held_out").to_pylist()
        c = Chunk(texts.column("text").to_pylist(), ~np.array(held, bool), shards)
        by_shard = dict(zip(replies.column("shard").to_pylist(), zip(*(replies.column(x).to_pylist() for x in ("counts", "pair_codes", "next_codes")), strict=True), strict=True))
        counts, pairs, nexts = np.zeros(len(c.words), np.int64), np.zeros(len(c.pairs), np.uint8), np.zeros(len(c.triple_word), np.uint8)
        for shard, w, p, t in c.parts(shards):
            a, b, d = by_shard[shard]
            counts[w], pairs[p], nexts[t] = unpack(a), np.frombuffer(b, np.uint8), np.frombuffer(d, np.uint8)
        s = score(c, counts, pairs, nexts, total, distinct, k)
        return pa.table(
            [texts.column("doc_id"), pa.array(held, pa.bool_()), pa.array(s["n_tokens"], pa.int64()), pa.array(s["n_known"], pa.int64()),
             pa.array([total] * len(held), pa.int64()), pa.array(s["base_score"], pa.float64()), pa.array(s["score"], pa.float64())],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    ask, reply, finish = _tidy(ask), _tidy(reply), _tidy(finish)
    blobs = ", ".join(f"{m} binary" for m in _MESSAGE)
    asked = dealt.groupBy("chunk").applyInArrow(ask, f"shard int, chunk int, {blobs}")
    replied = asked.groupBy("shard").applyInArrow(reply, "chunk int, shard int, counts binary, pair_codes binary, next_codes binary")
    done = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return dealt.groupBy("chunk").cogroup(replied.groupBy("chunk")).applyInArrow(finish, done)
