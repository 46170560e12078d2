"""Benchmark decontamination by spaced seeds: hashes of fixed positions, then a look at the overlap."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.llm.common import let, text_of, words_of
from hopline.plans.lineage import cut


@dataclass(frozen=True)
class Seeds:
    """Masks over neighbouring words (1: counts, 0: any word) and what an overlap must hold.

    Of 12 to 20 words with every fifth replaced, wherever they are, the two masks
    always have a hit; lengths at which ``masks`` could miss one get a lighter mask.
    """

    masks: tuple[str, ...] = ("111101", "1100111")
    #: Words compared around a hit, or the whole item if it is shorter.
    window: int = 20
    least_percent: int = 80
    #: Shorter items are phrases, not passages, and are not searched.
    least_words: int = 5
    #: Seed tables up to this many rows (two numbers each) may be broadcast.
    broadcast_rows: int = 1_000_000
    #: ``masks`` are used where no more patterns than this prove that they miss nothing.
    patterns: int = 100_000

    def masks_for(self, words: int) -> tuple[str, ...]:
        """Masks of which one hits whatever passes among ``words`` words (the window at most).

        If ``masks`` do not, a run of ones does: the replaced words part the others
        into one run more than they are, and the longest run has at least the mean length.
        """
        size = min(words, self.window)
        replaced = size * (100 - self.least_percent) // 100
        if not 0 <= replaced < size:
            raise ValueError("an overlap must share a word")
        if comb(size, replaced) <= self.patterns:
            hits = [{s + k for k, c in enumerate(m) if c == "1"} for m in self.masks for s in range(size - len(m) + 1)]
            if all(any(h.isdisjoint(gone) for h in hits) for gone in combinations(range(size), replaced)):
                return self.masks
        return ("1" * -(-(size - replaced) // (replaced + 1)),)


def _words(text: Column) -> Column:
    return words_of(F.lower(text))


def _seed_rows(rows: DataFrame, keys: list[str], words: str, masks: list[str]) -> DataFrame:
    """Rows (keys, at, h): the hash of every place under every mask; null where the mask juts out."""
    hashed = rows.select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("_w"))

    def under(w: Column, mask: str) -> Column:
        ones = [k for k, c in enumerate(mask) if c == "1"]
        held = lambda i: F.xxhash64(F.lit(mask), *[F.get(w, i + k) for k in ones])
        return F.transform(w, lambda x, i: F.when(i + len(mask) <= F.size(w), held(i)))

    made = hashed.select(
        *keys, F.size("_w").alias("_n"), F.posexplode(F.concat(*[under(F.col("_w"), m) for m in masks])).alias("_pos", "h")
    )
    return made.filter(F.col("h").isNotNull()).select(*keys, (F.col("_pos") % F.col("_n")).alias("at"), "h")


def _items(benchmark: DataFrame, seeds: Seeds) -> DataFrame:
    items = benchmark.select(F.col("item_id").alias("item_id"), _words(text_of("text")).alias("item"))
    return cut(items.filter(F.size("item") >= seeds.least_words).distinct())


def _row_key() -> Column:
    """What marks a document's row between the two looks at the table."""
    return F.xxhash64(F.col("doc_id"), text_of("text"))


def overlaps(documents: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds()) -> DataFrame:
    """Pairs (doc_id, item_id, at, matched, compared, row_key): a benchmark item inside a document.

    A pair counts when, at some alignment, ``least_percent`` of the words of a
    ``window`` of the item (of a shorter item as a whole) stand in the document in the
    same places. The masks of each length of item have a hit wherever that holds.
    ``at`` is where the item's first word falls (below 0 if it is cut off).
    Of several alignments the best is returned, the first of equals.

    Words are runs without white space, in lower case. Null and empty texts have none;
    an item of fewer than ``least_words`` words is never found. Repeated rows of either
    table give one pair. Items with a null id are reported with it. Other columns are not
    read. The seeds of the items are counted before they are broadcast; beyond the bound
    the join is a shuffled one.
    """
    items = _items(benchmark, seeds)
    compared = F.least(F.lit(seeds.window), F.size("item"))
    lengths: dict[tuple[str, ...], list[int]] = {}
    for n in sorted(r["n"] for r in items.select(compared.alias("n")).distinct().collect()):
        lengths.setdefault(seeds.masks_for(n), []).append(n)
    lengths = lengths or {seeds.masks: []}  # no items
    of_items = None
    for masks, sizes in lengths.items():
        made = _seed_rows(items.filter(compared.isin(sizes)), ["item_id"], "item", list(masks))
        of_items = made if of_items is None else of_items.union(made)
    of_items = cut(of_items)
    of_items = of_items.select("item_id", F.col("at").alias("item_at"), "h").distinct()
    if of_items.limit(seeds.broadcast_rows + 1).count() <= seeds.broadcast_rows:
        of_items = F.broadcast(of_items)

    texts = documents.select("doc_id", _row_key().alias("row_key"), _words(text_of("text")).alias("words"))
    places = _seed_rows(texts, ["doc_id", "row_key"], "words", sorted({m for masks in lengths for m in masks}))
    hits = places.join(of_items, "h").select("doc_id", "row_key", "item_id", (F.col("at") - F.col("item_at")).alias("at"))
    hits = cut(hits.distinct())

    wanted = hits.select("row_key").distinct()
    read = documents.select("doc_id", _row_key().alias("row_key"), text_of("text").alias("text"))
    read = read.join(wanted, "row_key", "left_semi").select("row_key", _words(F.col("text")).alias("words"))
    seen = hits.join(read.dropDuplicates(["row_key"]), "row_key")
    item_words = items.withColumnRenamed("item_id", "_item")
    seen = seen.join(item_words, F.col("item_id").eqNullSafe(F.col("_item")))
    length = F.size("item")
    agree = F.transform(
        "item",
        lambda w, j: F.when(
            (F.col("at") + j >= 0) & F.coalesce(F.get(F.col("words"), F.greatest(F.col("at") + j, F.lit(0))) == w, F.lit(False)), 1
        ).otherwise(0),
    )

    def best(agree: Column) -> Column:
        starts = F.sequence(F.lit(0), length - compared)
        return F.array_max(F.transform(starts, lambda s: F.aggregate(F.slice(agree, s + 1, compared), F.lit(0), lambda a, x: a + x)))

    found = seen.select("doc_id", "row_key", "item_id", "at", let(agree, best).alias("matched"), compared.alias("compared"))
    found = found.filter(100 * F.col("matched") >= seeds.least_percent * F.col("compared"))
    pairs = found.groupBy("doc_id", "row_key", "item_id").agg(
        F.max_by(F.struct("at", "matched", "compared"), F.struct("matched", -F.col("at"))).alias("b")
    )
    return pairs.select("doc_id", "item_id", "b.at", "b.matched", "b.compared", "row_key")


def clean(documents: DataFrame, benchmark: DataFrame, seeds: Seeds = Seeds()) -> DataFrame:
    """The documents without any benchmark item inside, with all their columns."""
    leaked = cut(overlaps(documents, benchmark, seeds).select(F.col("doc_id").alias("_d"), F.col("row_key").alias("_k")).distinct())
    hit = documents["doc_id"].eqNullSafe(leaked["_d"]) & (_row_key() == leaked["_k"])
    return documents.join(leaked, hit, "left_anti")
