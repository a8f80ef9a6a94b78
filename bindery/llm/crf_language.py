"""Language of every word by a linear-chain conditional random field.

A word's features are its affixes, its character n-grams and its place in word
lists learned per language; a transition weight joins neighbouring words.
Forward-backward gives each word's language given the whole text, so a text may
switch languages. A document's language is the one with the largest mean
probability over its words, and that mean is its score.

The field is fitted on a bounded, documented sample (``SAMPLE`` documents of
each language, ``SAMPLE_WORDS`` words of each); prediction reads every text
whole. Model size is fixed by ``TABLE`` and the number of languages.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from bindery.llm.rows import free_name, row_key

SAMPLE, SAMPLE_WORDS = 150, 400
LEXICON = 500
TABLE_BITS = 18
TABLE = 1 << TABLE_BITS
SEQUENCES, STEPS, MEAN_RUN, ROUNDS = 4000, 32, 12, 30
SEGMENT, BATCH_WORDS = 64, 100_000

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(table place, word number) of every feature of lower-cased words.

    Features are the 2- to 4-grams of ``^word$``, which hold the affixes of up to
    three letters, and the affixes of four.
    """
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    nth = np.arange(len(codes)) - (np.cumsum(sizes) - sizes)[word]
    left = sizes[word] - nth
    places, owners, gram = [], [], codes.copy()
    for n in range(2, 6):
        gram = gram[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
        fits = left[: len(gram)] >= n
        if n == 5:
            fits &= (nth[: len(gram)] == 0) | (left[: len(gram)] == n)
        hashed = (gram[fits] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        places.append((hashed >> np.uint64(64 - TABLE_BITS)).astype(np.int64))
        owners.append(word[: len(gram)][fits])
    return np.concatenate(places), np.concatenate(owners)


@dataclass
class Field:
    """Fitted weights. ``lexicon`` gives the bit mask of the word lists a word is in."""

    langs: list[str]
    weights: np.ndarray  # (TABLE + number of lists, languages)
    transitions: np.ndarray  # (languages, languages)
    lexicon: dict[str, int]

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Features with those of the word lists, by word."""
        places, owners = word_features(words)
        masks = np.fromiter((self.lexicon.get(w, 0) for w in words), np.int64, len(words))
        listed = [np.flatnonzero(masks >> i & 1) for i in range(len(self.langs))]
        places = np.concatenate([places, *[np.full(len(x), TABLE + i) for i, x in enumerate(listed)]])
        owners = np.concatenate([owners, *listed])
        order = np.argsort(owners, kind="stable")
        return places[order], owners[order]

    def scores(self, words: list[str]) -> np.ndarray:
        """The sum of each word's feature weights."""
        places, owners = self.features(words)
        return np.add.reduceat(self.weights[places], np.searchsorted(owners, np.arange(len(words))))


def positive(scores: np.ndarray) -> np.ndarray:
    """``exp`` scaled to a largest value of 1 in each row, never 0."""
    return np.exp(np.maximum(scores - scores.max(-1, keepdims=True), -60.0))


def fit(words_by_lang: dict[str, list[str]], seed: int = 7) -> Field:
    """Fit by AdaGrad on the log-likelihood of mixed sequences.

    Training sequences switch language after runs of random length drawn from
    the sample, so transitions learn to stay but can change.
    """
    langs = sorted(words_by_lang)
    k, rng = len(langs), np.random.default_rng(seed)
    lexicon: dict[str, int] = {}
    for i, lang in enumerate(langs):
        common = Counter(words_by_lang[lang]).most_common()
        for word, _ in sorted(common, key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[word] = lexicon.get(word, 0) | 1 << i
    field = Field(langs, np.zeros((TABLE + k, k), np.float32), np.zeros((k, k), np.float32), lexicon)
    if k < 2:
        return field

    vocabulary: dict[str, int] = {}
    streams = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_by_lang[x]]) for x in langs]
    size = len(vocabulary)
    flat, owner = field.features(list(vocabulary))
    used, flat = np.unique(flat, return_inverse=True)
    starts = np.searchsorted(owner, np.arange(size))
    by_feature = np.argsort(flat, kind="stable")
    feature_starts = np.searchsorted(flat[by_feature], np.arange(len(used)))

    total = SEQUENCES * STEPS
    switch = rng.random(total) < 1 / MEAN_RUN
    switch[0] = True
    label = rng.integers(0, k, total)[np.maximum.accumulate(np.where(switch, np.arange(total), 0))]
    at, next_word = np.zeros(total, np.int64), rng.integers(0, 1 << 30, k)
    for i in range(k):
        mine = np.flatnonzero(label == i)
        at[mine] = streams[i][(next_word[i] + np.arange(len(mine))) % len(streams[i])]
    at, label = at.reshape(SEQUENCES, STEPS), label.reshape(SEQUENCES, STEPS)

    weights, moves = np.zeros((len(used), k)), np.zeros((k, k))
    grown_w, grown_m = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    truth = np.zeros((size, k))
    np.add.at(truth, (at.ravel(), label.ravel()), 1)
    true_moves = np.zeros((k, k))
    np.add.at(true_moves, (label[:, :-1].ravel(), label[:, 1:].ravel()), 1)
    for _ in range(ROUNDS):
        e = positive(np.add.reduceat(weights[flat], starts))[at]
        a = positive(moves.reshape(1, -1)).reshape(k, k)
        forward, backward = np.empty_like(e), np.empty_like(e)
        forward[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for t in range(1, STEPS):
            x = forward[:, t - 1] @ a * e[:, t]
            forward[:, t] = x / x.sum(1, keepdims=True)
        backward[:, -1] = 1
        for t in range(STEPS - 2, -1, -1):
            x = (e[:, t + 1] * backward[:, t + 1]) @ a.T
            backward[:, t] = x / x.sum(1, keepdims=True)
        p = forward * backward
        p /= p.sum(2, keepdims=True)
        seen = np.stack([np.bincount(at.ravel(), p[:, :, i].ravel(), size) for i in range(k)], 1)
        pair = forward[:, :-1, :, None] * a * (e * backward)[:, 1:, None, :]
        expected_moves = (pair / pair.sum((2, 3), keepdims=True)).sum((0, 1))
        slope = np.add.reduceat((truth - seen)[owner[by_feature]], feature_starts) / total - 1e-5 * weights
        slope_m = (true_moves - expected_moves) / total
        grown_w += slope**2
        grown_m += slope_m**2
        weights += 0.3 * slope / np.sqrt(grown_w)
        moves += 0.3 * slope_m / np.sqrt(grown_m)
    field.weights[used] = weights
    field.transitions[:] = moves
    return field


def marginals(e: np.ndarray, a: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Forward-backward over many texts at once.

    ``e`` holds the words' emissions, text after text. Every text is cut into
    segments; the product of a segment's steps carries the recursion across it,
    so all segments are worked on together and the result is that of one pass.
    """
    n, k = e.shape
    pieces = -(-lengths // SEGMENT)
    text = np.repeat(np.arange(len(lengths)), pieces)
    first_piece = np.cumsum(pieces) - pieces
    nth = np.arange(len(text)) - first_piece[text]
    begin = (np.cumsum(lengths) - lengths)[text] + nth * SEGMENT
    size = np.minimum(SEGMENT, lengths[text] - nth * SEGMENT)
    place = begin[:, None] + np.arange(SEGMENT)
    there = np.arange(SEGMENT) < size[:, None]
    x = np.where(there[:, :, None], e[np.minimum(place, n - 1)], 1).astype(np.float64)
    opens = nth == 0

    through = np.broadcast_to(np.eye(k), (len(text), k, k)).copy()
    for t in range(SEGMENT):
        live = there[:, t]
        moved = (through.reshape(-1, k) @ a).reshape(-1, k, k)
        if t == 0:
            moved[opens] = through[opens]
        moved *= x[:, t, None, :]
        moved /= moved.max((1, 2), keepdims=True)
        through = np.where(live[:, None, None], moved, through)

    into, out = np.full((len(text), k), 1 / k), np.ones((len(text), k))
    for j in range(1, int(pieces.max(initial=1))):
        s = first_piece[pieces > j] + j
        v = np.einsum("si,sij->sj", into[s - 1], through[s - 1])
        into[s] = v / v.sum(1, keepdims=True)
    for j in range(int(pieces.max(initial=1)) - 2, -1, -1):
        s = first_piece[pieces > j + 1] + j
        v = np.einsum("sij,sj->si", through[s + 1], out[s + 1])
        out[s] = v / v.sum(1, keepdims=True)

    forward = np.empty_like(x)
    v = into
    for t in range(SEGMENT):
        moved = v @ a
        if t == 0:
            moved[opens] = v[opens]
        moved = moved * x[:, t]
        moved /= moved.sum(1, keepdims=True)
        v = np.where(there[:, t, None], moved, v)
        forward[:, t] = v
    p = np.empty_like(x)
    b = out
    for t in range(SEGMENT - 1, -1, -1):
        live = there[:, t, None]
        p[:, t] = forward[:, t] * b
        moved = (x[:, t] * b) @ a.T
        moved /= moved.sum(1, keepdims=True)
        b = np.where(live, moved, b)
    p /= p.sum(2, keepdims=True)
    return p[there]


class Tagger:
    """Labels words with a fitted field."""

    def __init__(self, field: Field):
        self.field = field
        self.a = positive(field.transitions.reshape(1, -1).astype(np.float64)).reshape(field.transitions.shape)

    def emit(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Emissions of the words that have a letter, and which these are."""
        at, distinct = pd.factorize(np.array(words, object))
        distinct = list(distinct)
        lettered = np.fromiter((w.isalpha() or any(map(str.isalpha, w)) for w in distinct), bool, len(distinct))
        e = positive(self.field.scores(distinct)) if distinct else np.zeros((0, len(self.field.langs)))
        kept = lettered[at]
        return e[at[kept]], kept

    def tag(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Per text the languages' probabilities for each lettered word."""
        sizes = np.array([len(t) for t in texts])
        e, kept = self.emit([w for t in texts for w in t])
        lengths = np.bincount(np.repeat(np.arange(len(texts)), sizes)[kept], minlength=len(texts))
        some = lengths[lengths > 0]
        p = marginals(e, self.a, some) if len(some) else np.zeros((0, len(self.field.langs)))
        return np.split(p, np.cumsum(lengths)[:-1])


def in_portions(texts: pd.Series) -> Iterator[list[list[str]]]:
    """The words of consecutive texts, cut into portions of bounded size between texts."""
    portion, size = [], 0
    for text in texts:
        words = WORD.findall(text.lower()) if text else []
        if portion and size + len(words) > BATCH_WORDS:
            yield portion
            portion, size = [], 0
        portion.append(words)
        size += len(words)
    if portion:
        yield portion


RUN = StructType().add("first", IntegerType()).add("words", IntegerType()).add("lang", StringType())
TAGGED = StructType().add("lang_pred", StringType()).add("score", DoubleType()).add("lang_runs", ArrayType(RUN))


def tagger_udf(spark, field: Field, with_runs: bool):
    shared = spark.sparkContext.broadcast(field)  # its size is fixed by TABLE and the languages

    def judged(p: np.ndarray) -> tuple:
        if not len(p):
            return UNKNOWN, 0.0, []
        mean = p.mean(0)
        best, runs = int(mean.argmax()), []
        if with_runs:
            label = p.argmax(1)
            cut = np.flatnonzero(np.diff(label, prepend=-1))
            ends = np.append(cut[1:], len(label))
            runs = [(int(s), int(e - s), shared.value.langs[label[s]]) for s, e in zip(cut, ends)]
        return shared.value.langs[best], float(min(mean[best], 1.0)), runs

    @F.pandas_udf(TAGGED)
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(shared.value) if shared.value.langs else None
        for texts in batches:
            if tagger:
                rows = [judged(p) for portion in in_portions(texts) for p in tagger.tag(portion)]
            else:
                rows = [(UNKNOWN, 0.0, [])] * len(texts)
            yield pd.DataFrame(rows, columns=TAGGED.names, index=texts.index)

    return tag


def training_words(docs: DataFrame, sample: int = SAMPLE, sample_words: int = SAMPLE_WORDS) -> dict[str, list[str]]:
    """Words of a sample of labelled texts: about ``sample`` documents of each language, picked by hash.

    Of a longer text a stretch of ``sample_words`` words from a hashed place.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = labelled.groupBy("lang").count().collect()  # one row per language
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, sample / r["count"]))])
    drawn = F.pmod(F.xxhash64("row_key"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30)
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    spare = F.greatest(F.size("words") - sample_words, F.lit(0)) + 1
    stretch = F.slice("words", (F.pmod(F.xxhash64("row_key"), spare) + 1).cast("int"), sample_words)
    rows = (
        labelled.select("lang", row_key().alias("row_key"), "text")
        .filter(drawn)
        .select("lang", "row_key", words.alias("words"))
        .select("lang", "row_key", stretch.alias("words"))
        .dropDuplicates(["lang", "row_key"])
        .collect()
    )
    out: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["lang"], r["row_key"])):
        out.setdefault(row["lang"], []).extend(row["words"])
    return {lang: words for lang, words in out.items() if words}


def held_out(fold: int = 2) -> Column:
    """Whether a document is kept out of training; false for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == fold, F.lit(False))


def identify(docs: DataFrame, with_runs: bool = False) -> DataFrame:
    """``docs`` with held_out, lang_pred, score and, if asked for, lang_runs.

    Learns from rows with language, id and text that are not held out; each
    prediction uses the text alone. Null texts and texts without a letter get
    ``und`` and 0, as does everything where nothing can be learned. Repeated
    rows get the same result. ``lang_runs`` has the maximal runs of words of one
    language as (first word, words, language), counting lettered words from 0.
    Columns of these names are replaced, others pass through.
    """
    field = fit(training_words(docs.filter(F.col("doc_id").isNotNull() & ~held_out())))
    tag = tagger_udf(docs.sparkSession, field, with_runs)
    out = docs.drop("held_out", *TAGGED.names)
    kept = [F.col(c) for c in out.columns]
    found = free_name(out, "_tagged")
    tagged = out.select(*kept, held_out().alias("held_out"), tag("text").alias(found))
    names = TAGGED.names if with_runs else TAGGED.names[:2]
    return tagged.select(*out.columns, "held_out", *[F.col(found)[n].alias(n) for n in names])


def digest(docs: DataFrame) -> DataFrame:
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def with_known_language(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text is in a learned language.

    Rejected: ``und``, and texts of which no language has at least ``least``.
    """
    field = fit(training_words(docs.filter(F.col("doc_id").isNotNull() & ~held_out())))
    name = free_name(docs, "_tagged")
    found = docs.select(*docs.columns, tagger_udf(docs.sparkSession, field, False)("text").alias(name))
    judged = F.col(name)
    return found.filter((judged["lang_pred"] != UNKNOWN) & (judged["score"] >= least)).select(*docs.columns)
