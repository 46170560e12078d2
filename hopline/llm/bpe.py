"""Byte-level BPE, encoded fragment by fragment between certain cuts.

Two neighbouring bytes that never stand side by side inside any vocabulary token can
never end up in one token, so a cut between them is certain. Every pre-token is split
at such cuts, the fragments are encoded independently, and their ids concatenated.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.llm.common import text_of

#: How the byte-level tokenizers part text before merging (fixed value).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_NEVER = np.int32(2**31 - 1)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


#: Letters and numbers that the pattern engine knows and the tokenizers library does not yet (fixed values).
NEWER_LETTERS = (
    "\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    "\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    "\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    "\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    "\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    "\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


#: Neither letter, number nor white space.
_PRIVATE = "\ue000"


class Encoder:
    """Encodes and decodes with one vocabulary file of the ``tokenizers`` library.

    Only byte-level BPE without a normalizer is accepted. Added tokens found in a text
    become their ids, longest first at each place. ``cache_words`` bounds the memory
    kept between batches; what was forgotten is encoded again.
    """

    def __init__(self, spec: dict, cache_words: int = 300_000):
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        if model.get("type", "BPE") != "BPE" or pre.get("type") != "ByteLevel" or spec.get("normalizer") or odd or pre.get("add_prefix_space"):
            raise ValueError("not a plain byte-level BPE vocabulary")
        letters = _byte_letters()
        self.bytes_of = {i: bytes(letters[c] for c in t) for t, i in model["vocab"].items()}
        ids = {t: i for i, t in self.bytes_of.items()}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        raw = lambda t: bytes(letters[c] for c in t)
        self.merges = {}
        for rank, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            self.merges.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.inside = np.zeros((256, 256), bool)
        for token in self.bytes_of.values():
            pairs = np.frombuffer(token, np.uint8)
            self.inside[pairs[:-1], pairs[1:]] = True
        # merges as sorted arrays, for many lookups at once
        keys = np.array([(a << 32) | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64(2**63 - 1))
        self.ranks = np.append(np.array([r for r, _ in self.merges.values()], np.int32)[order], _NEVER)
        self.result = np.zeros(len(merges) + 1, np.int32)
        for rank, new in self.merges.values():
            self.result[rank] = new
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        if any(t.get(k) for t in spec.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.tokens = dict(self.bytes_of) | {i: t.encode() for t, i in self.added.items()}
        self.pre = regex.compile(PRE_TOKEN)
        self.newer = re.compile(f"[{NEWER_LETTERS}]")
        marks = sorted(self.added, key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, marks))) if marks else None
        self.cache: dict[str, bytes] = {}
        self.cache_words = cache_words

    @classmethod
    def load(cls, path: str, **options) -> Encoder:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f), **options)

    def fragments(self, data: bytes) -> list[bytes]:
        """The pieces between certain cuts."""
        if len(data) < 2:
            return [data]
        b = np.frombuffer(data, np.uint8)
        cuts = np.flatnonzero(~self.inside[b[:-1], b[1:]]) + 1
        if not len(cuts):
            return [data]
        edges = [0, *cuts.tolist(), len(data)]
        return [data[i:j] for i, j in zip(edges, edges[1:], strict=False)]

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        want = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, want)
        return np.where((self.keys[at] == want) & (left >= 0) & (right >= 0), self.ranks[at], _NEVER)

    def _merge_many(self, fragments: list[bytes]) -> list[bytes]:
        """Ids (little-endian uint32) of fragments of similar length, one merge of each per round."""
        width = max(map(len, fragments))
        symbols = np.full((len(fragments), width + 1), -1, np.int32)
        for n in {len(f) for f in fragments}:
            rows = [k for k, f in enumerate(fragments) if len(f) == n]
            flat = np.frombuffer(b"".join(fragments[k] for k in rows), np.uint8).reshape(len(rows), n)
            symbols[rows, :n] = self.byte_ids[flat]
        ranks = self._rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(fragments), width)
        done = np.empty((len(fragments), width), np.int32)
        rows, cols = np.arange(len(fragments)), np.arange(width)
        while len(rows):
            best = ranks.argmin(1)
            at = np.arange(len(rows))
            rank = ranks[at, best]
            over = rank == _NEVER
            if over.any():
                done[rows[over]] = symbols[over, :width]
                rows, symbols, ranks, best, rank = (x[~over] for x in (rows, symbols, ranks, best, rank))
                at = np.arange(len(rows))
                if not len(rows):
                    break
            move = cols[None, :] > best[:, None]
            symbols[:, :width] = np.where(move, symbols[:, 1:], symbols[:, :width])
            symbols[:, width] = -1
            symbols[at, best] = self.result[rank]
            ranks[:, : width - 1] = np.where(move[:, : width - 1], ranks[:, 1:], ranks[:, : width - 1])
            ranks[:, width - 1] = _NEVER
            ranks[at, best] = self._rank(symbols[at, best], symbols[at, best + 1])
            has = best > 0
            ranks[at[has], best[has] - 1] = self._rank(symbols[at[has], best[has] - 1], symbols[at[has], best[has]])
        sizes = (done >= 0).sum(1)
        flat, ends = done[done >= 0].astype("<u4").tobytes(), np.cumsum(sizes) * 4
        return [flat[e - 4 * n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]

    def _merge_long(self, fragment: bytes) -> bytes:
        """One long fragment, with a heap of pairs over a linked list."""
        ids = self.byte_ids[np.frombuffer(fragment, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        found = lambda i, j: (self.merges[ids[i], ids[j]][0], i, ids[i], ids[j])
        heap = [found(i, i + 1) for i in range(len(ids) - 1) if (ids[i], ids[i + 1]) in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j >= len(ids) or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
                if (ids[i], ids[after[i]]) in self.merges:
                    heapq.heappush(heap, found(i, after[i]))
            if before[i] >= 0 and (ids[before[i]], ids[i]) in self.merges:
                heapq.heappush(heap, found(before[i], i))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def encode_fragments(self, fragments: list[bytes], short: int = 24, rows: int = 20_000) -> list[bytes]:
        out: list[bytes] = [b""] * len(fragments)
        by_length: dict[int, list[int]] = {}
        for k, f in enumerate(fragments):
            by_length.setdefault(-(-len(f) // 4) if len(f) <= short else 0, []).append(k)
        for size, places in by_length.items():
            for at in range(0, len(places), rows):
                part = places[at : at + rows]
                ids = self._merge_many([fragments[k] for k in part]) if size else [self._merge_long(fragments[k]) for k in part]
                for k, x in zip(part, ids, strict=True):
                    out[k] = x
        return out

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.cache]
        if len(self.cache) + len(new) > self.cache_words:
            self.cache, new = {}, list(words)
        data = [w.encode("utf-8", "replace") for w in new]
        flat = np.frombuffer(b"".join(data), np.uint8)
        ends = list(accumulate(map(len, data)))
        cuts = np.flatnonzero(~self.inside[flat[:-1], flat[1:]]) + 1 if len(flat) > 1 else np.zeros(0, int)
        starts = [0, *ends[:-1]] if ends else []
        inner = (np.searchsorted(cuts, ends, "left") > np.searchsorted(cuts, starts, "right")).tolist()
        pieces, counts = [], []
        for k, d in enumerate(data):
            if not inner[k]:
                pieces.append(d)
                counts.append(1)
            else:
                parts = self.fragments(d)
                pieces += parts
                counts.append(len(parts))
        at, ids = 0, self.encode_fragments(pieces)
        for w, n in zip(new, counts, strict=True):
            self.cache[w] = ids[at] if n == 1 else b"".join(ids[at : at + n])
            at += n

    def _parts(self, text: str) -> list[tuple[bool, str]]:
        """Ordinary stretches and added tokens, in order."""
        if self.marks is None:
            return [(False, text)]
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [(False, text[at : m.start()]), (True, m[0])]
            at = m.end()
        return [*out, (False, text[at:])]

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without added tokens."""
        if _latin(text) or not self.newer.search(text):
            return self.pre.findall(text)
        return [text[m.start() : m.end()] for m in self.pre.finditer(self.newer.sub(_PRIVATE, text))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian uint32."""
        split = []
        for text in texts:
            words = []
            for mark, part in self._parts(text):
                words += [(part,)] if mark else self.words(part)
            split.append(words)
        self._learn({w for words in split for w in words if w.__class__ is str})
        marks = {(t,): np.array([i], "<u4").tobytes() for t, i in self.added.items()}
        known = self.cache
        if not marks:
            return [b"".join(map(known.__getitem__, words)) for words in split]
        return [b"".join([known[w] if w.__class__ is str else marks[w] for w in words]) for words in split]

    def decode(self, ids: bytes) -> str:
        tokens = self.tokens
        return b"".join([tokens[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_LOADED: dict[str, Encoder] = {}


def _encoder(name: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if name not in _LOADED:
        _LOADED[name] = Encoder.load(SparkFiles.get(name))
    return _LOADED[name]


def slices(texts: list[str], chars: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts with about ``chars`` code points together."""
    start = size = 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])


def round_trip(documents: DataFrame, vocabulary: str, chars: int = 1_000_000) -> DataFrame:
    """Each document's ids (binary, little-endian uint32) and the text they decode to.

    ``vocabulary`` is a file on the driver; it is handed to the executors through
    Spark's own file distribution. Every row is encoded whole and on its own; null
    is the empty text, which has no ids. Texts are taken ``chars`` code points at a
    time. Repeated rows each give a row; other columns are not read.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = vocabulary.rsplit("/", 1)[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(name)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices(texts, chars):
                ids = encoder.encode(texts[i:j])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(ids, pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.string())],
                    schema=SCHEMA,
                )

    given = documents.select(F.col("doc_id").cast("long"), text_of("text").alias("text"))
    return given.mapInArrow(run, "doc_id long, ids binary, decoded string")
