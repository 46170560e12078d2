"""Quality rules: how far a text's character classes and common words lie from its language's."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hopline.llm.common import let, let_all, text_of, total, words_of

#: Frequent words by language (fixed values).
COMMON = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "ein", "dem", "nicht"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "was", "on", "as", "with", "be", "by"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "a"),
}

#: Character classes after a-z and white space, in the order they are taken off the text; what remains is not ASCII.
CLASSES = ("[A-Z]+", "[0-9]+", r"[.,;:!?'\"()-]+", "[#*$%&|<>]+", r"[\x00-\x7F]+")
#: Where white space and the symbols #*$%&|<> stand among the classes, and how many classes there are.
SPACES_AT, SYMBOLS_AT, N_CLASSES = 1, 5, 8

#: Words that are a mark alone, counted as one of the word bins (fixed values).
MARKS = ("|", "-", "*", "#", "&", "<", ">", "/", "\\", "+", "=", "~", "_", "\u2013", "\u2014", "\u2022", "\u00b7", "\u00bb", "\u00ab")

_INDEX_BITS = 20


@dataclass(frozen=True)
class Rules:
    """Bounds of the verdict; distances are Jensen-Shannon distances in [0, 1]."""

    min_words: int = 50
    max_repeat_percent: int = 50
    #: Shorter texts are not compared with a reference.
    compare_chars: int = 200
    compare_words: int = 50
    max_char_distance: float = 0.3
    max_word_distance: float = 0.32
    #: Texts with a larger share of symbols do not shape the references.
    reference_symbol_percent: int = 2
    common: dict = field(default_factory=lambda: dict(COMMON))

    def bins(self) -> int:
        return max(map(len, self.common.values()), default=0)


#: By language, mean shares of the character classes and of the word bins.
References = dict[str, tuple[list[float], list[float]]]


def class_counts(text: Column, spaces: Column) -> Column:
    """Code points per class; ``spaces`` of them are white space.

    a-z and white space, most of a text, go in one replacement of long runs; each
    class after them is taken off the little that the classes before have left.
    """

    def take(sizes: list[Column], rest: Column, classes: tuple[str, ...]) -> Column:
        sizes = [*sizes, F.length(rest)]
        if classes:
            return let(F.regexp_replace(rest, classes[0], ""), lambda r: take(sizes, r, classes[1:]))
        counts = [a - b for a, b in zip(sizes, sizes[1:], strict=False)]
        return F.array(F.length(text) - sizes[0] - spaces, spaces, *counts, sizes[-1])

    return let(F.regexp_replace(text, r"[a-z\x20\x09-\x0D]+", ""), lambda r: take([], r, CLASSES))


def space_count(text: Column, words: Column) -> Column:
    return F.length(text) - F.length(F.array_join(words, ""))


def word_counts(words: Column, lang: Column, rules: Rules) -> Column:
    """Counts of the language's common words (in lower case or capitalised), padded to one length,
    of bare marks, and of all other words.

    An unknown language has no common words.
    """

    def counts(common: tuple[str, ...]) -> Column:
        def split(hits: Column) -> Column:
            own = [F.size(hits) - F.size(F.array_remove(hits, c)) for c in common]
            pad = [F.lit(0)] * (rules.bins() - len(own))
            return let(
                F.array(*own, *pad),
                lambda bins: F.concat(bins, F.array(F.size(hits) - total(bins).cast("int"), F.size(words) - F.size(hits))),
            )

        written = [*common, *(c.capitalize() for c in common), *MARKS]
        return let(F.transform(F.filter(words, lambda w: w.isin(*written)), F.lower), split)

    out = F.when(F.lit(False), F.array(*[F.lit(0)] * (rules.bins() + 2)))
    for name, common in sorted(rules.common.items()):
        out = out.when(lang == name, counts(tuple(common)))
    return out.otherwise(counts(()))


def _window(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i + k) for k in range(3)]


def repeat_words(words: Column) -> Column:
    """Words covered by three-word windows that stand in the text twice or more.

    Windows are sorted as packed longs: high bits of a hash, low bits the place.
    Equal neighbours are compared word by word; a clash of hashes, or a text too
    long to pack, is sorted by the words themselves.
    """
    low = (1 << _INDEX_BITS) - 1

    def cover(starts: Column) -> Column:
        return total(F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3)))))

    heads = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
    gram = lambda x: F.concat_ws(" ", *_window(words, place(x)))

    def twice(order: Column, same, at) -> Column:
        """Words covered by the windows that equal their neighbour in ``order``."""
        return let(where_next(order, same), lambda ks: let(F.sort_array(F.array_distinct(F.flatten(F.transform(ks, lambda k: F.array(at(F.get(order, k)), at(F.get(order, k + 1))))))), cover))

    def where_next(order: Column, same) -> Column:
        marked = F.transform(order, lambda x, k: F.when(same(x, F.get(order, k + 1)), k).otherwise(F.lit(-1)))
        return F.array_remove(marked, -1)

    def fast(order: Column) -> Column:
        near = lambda x, y: x.bitwiseXOR(y).between(0, low)

        def check(ks: Column) -> Column:
            clash = F.exists(ks, lambda k: gram(F.get(order, k)) != gram(F.get(order, k + 1)))
            starts = F.flatten(F.transform(ks, lambda k: F.array(place(F.get(order, k)), place(F.get(order, k + 1)))))
            return F.when(F.size(ks) == 0, F.lit(0).cast("long")).when(clash, slow()).otherwise(let(F.sort_array(F.array_distinct(starts)), cover))

        return let(where_next(order, near), check)

    def slow() -> Column:
        grams = F.transform(heads, lambda w, i: F.struct(F.concat_ws(" ", *_window(words, i)).alias("g"), i.alias("i")))
        return let(F.array_sort(grams), lambda order: twice(order, lambda x, y: x["g"] == y["g"], lambda x: x["i"]))

    packed = F.transform(
        heads,
        lambda w, i: F.shiftleft(F.xxhash64(*_window(words, i)), _INDEX_BITS).bitwiseOR(i.cast("long")),
    )
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(
        F.when(F.size(words) > low, slow()).otherwise(let(F.sort_array(packed), fast))
    )


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2) of a histogram to a reference; 1 for an empty one."""

    def shares(size: Column) -> Column:
        terms = F.transform(
            F.arrays_zip(counts.alias("n"), F.array(*map(F.lit, reference)).alias("q")),
            lambda z: let_all([z["n"] / size, z["q"]], _divergence),
        )
        return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))

    return let(total(counts), lambda size: F.when(size > 0, shares(size)).otherwise(F.lit(1.0)))


def _divergence(p: Column, q: Column) -> Column:
    half = lambda x, m: F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(F.lit(0.0))
    return half(p, (p + q) / 2) + half(q, (p + q) / 2)


def nearest(counts: Column, lang: Column, references: References, which: int) -> Column:
    """Distance to the language's reference; without one, to the nearest (0 if there are none)."""
    if not references:
        return F.lit(0.0)
    out = None
    for name, reference in sorted(references.items()):
        d = distance(counts, reference[which])
        out = F.when(lang == name, d) if out is None else out.when(lang == name, d)
    if which:  # the common words of an unknown language are unknown too
        return out.otherwise(F.lit(0.0))
    every = [distance(counts, r[which]) for _, r in sorted(references.items())]
    return out.otherwise(F.least(*every) if len(every) > 1 else every[0])


def fit_references(documents: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang") -> References:
    """Mean histograms of every known language, over all documents long enough to compare.

    A document weighs as much as any other whatever its length. One row per
    language in ``rules.common`` reaches the driver. Null texts, short texts and
    unknown languages are left out.
    """
    known = documents.select(text_of(text).alias("t"), F.col(lang).alias("l")).filter(F.col("l").isin(*rules.common))

    def histograms(t: Column, words: Column, classes: Column) -> Column:
        return F.when(
            (F.length(t) >= max(rules.compare_chars, 1))
            & (F.size(words) >= max(rules.compare_words, 1))
            & (100 * classes[SYMBOLS_AT] <= rules.reference_symbol_percent * F.length(t)),
            F.struct(classes.alias("c"), word_counts(words, F.col("l"), rules).alias("w")),
        )

    measured = let(
        words_of(F.col("t")),
        lambda w: let(class_counts(F.col("t"), space_count(F.col("t"), w)), lambda c: histograms(F.col("t"), w, c)),
    )
    rows = known.select("l", measured.alias("h")).filter("h is not null")
    sizes = {"c": N_CLASSES, "w": rules.bins() + 2}
    shares = [
        F.avg(F.col(f"h.{k}")[i] / total(F.col(f"h.{k}"))).alias(f"{k}{i}") for k, n in sizes.items() for i in range(n)
    ]
    found = rows.groupBy("l").agg(*shares).collect()
    return {r["l"]: tuple([r[f"{k}{i}"] for i in range(n)] for k, n in sizes.items()) for r in found}


def measure(t: Column, lang: Column, references: References, rules: Rules) -> Column:
    """Struct of the counts, the two distances and the verdict of one text."""

    def build(t: Column, words: Column, chars: Column) -> Column:
        def verdict(n_words: Column, repeated: Column, by_char: Column, by_word: Column) -> Column:
            failed = (n_words < rules.min_words) | (100 * repeated > rules.max_repeat_percent * n_words)
            far = (F.length(t) >= rules.compare_chars) & (by_char > rules.max_char_distance)
            far = far | (n_words >= rules.compare_words) & (by_word > rules.max_word_distance)
            return F.struct(
                n_words.alias("n_words"),
                (F.length(t) - chars[SPACES_AT]).cast("long").alias("word_chars"),
                chars[SYMBOLS_AT].cast("long").alias("n_symbols"),
                dup_lines(t).cast("long").alias("n_dup_lines"),
                repeated.alias("n_repeat_words"),
                failed.alias("base_failed"),
                (~failed & ~far).alias("kept"),
                by_char.alias("char_distance"),
                by_word.alias("word_distance"),
            )

        return let_all(
            [
                F.size(words).cast("long"),
                repeat_words(words),
                F.round(nearest(chars, lang, references, 0), 6),
                F.round(let(word_counts(words, lang, rules), lambda c: nearest(c, lang, references, 1)), 6),
            ],
            verdict,
        )

    return let(t, lambda t: let(words_of(t), lambda w: let(class_counts(t, space_count(t, w)), lambda c: build(t, w, c))))


def judge(documents: DataFrame, references: References | None = None, rules: Rules = Rules()) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, char_distance, word_distance.

    Without ``references`` they are first fitted on all of ``documents``. A text of
    fewer than ``min_words`` words, or mostly repeated windows, fails the base
    rules; else it is kept unless a distance exceeds its bound. Texts under the
    guards are not compared. A null or empty text has no words and fails. A null
    or unknown language is compared with the nearest reference by characters only.
    Repeated rows each give a row; other columns are not read. One pass, no shuffle.
    """
    references = fit_references(documents, rules) if references is None else references
    measured = measure(text_of("text"), F.col("lang"), references, rules)
    return documents.select("doc_id", measured.alias("_m")).select("doc_id", "_m.*")


def keep(documents: DataFrame, references: References | None = None, rules: Rules = Rules()) -> DataFrame:
    """The kept documents, with all their columns."""
    references = fit_references(documents, rules) if references is None else references
    return documents.filter(measure(text_of("text"), F.col("lang"), references, rules)["kept"])
