"""Reading level of each document, from the grades at which its words are acquired.

A word's grade is estimated from the distribution of its uses over graded texts:
the expected level under its rates per level, smoothed towards the distribution of
words of its length.  A sentence length is graded in the same way, as one more kind
of unit.  A document's features are quantiles of the grades of its known words (and
of its sentences); they are calibrated to levels by a multinomial model fitted on
graded documents, whose own grades are taken from the other folds.

Words are compared by their letters, so both scripts share their grades, and are
kept as 64-bit hashes of those letters.  Grades are estimated from all labels; only
the calibration uses a sample, of at most `sample` graded documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispan.functions.letters import code_points, letters_of_points
from lexispan.session import cut

LEVELS = np.arange(1, 5)
QUANTILES = np.array([0.05, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.95])
FOLDS = 5
ENGLISH, SANSKRIT, OTHER = 0, 1, -1
# Frequent function words, by their letters.
ENGLISH_WORDS = (
    "the", "a", "an", "of", "to", "and", "in", "that", "this", "which", "his", "her", "by", "with", "from", "for", "every", "is", "are", "was", "it",
    "as", "on", "at", "he", "she", "they", "when", "because", "not", "or", "their", "its", "be", "has", "have",
)
GERMAN_WORDS = (
    "der", "die", "das", "den", "dem", "des", "ein", "eine", "einer", "und", "ist", "nicht", "mit", "von", "zu", "im", "auf", "fur", "auch", "sich",
    "wird", "werden", "sind", "aus", "bei", "nach", "oder", "als", "wie", "dieser", "diese",
)
LONGEST = 40
_BASE = np.uint64(0x100000001B3)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(0, n - 1), _BASE)]))


def _hash_runs(points: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hash of each run of letters; none is empty."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    within = np.arange(len(points)) - np.repeat(starts, sizes)
    value = np.add.reduceat(points.astype(np.uint64) * _powers(int(sizes.max()))[within], starts) * _MIX
    return value ^ (value >> np.uint64(32))


def word_hash(word: str) -> int:
    """Hash of one word of letters."""
    points = np.array([ord(c) for c in word], dtype=np.int32)
    return int(_hash_runs(points, np.array([0]), np.array([len(points)]))[0])


_SPACE = np.zeros(0x3001, dtype=bool)
for _c in range(0x3001):
    _SPACE[_c] = chr(_c).isspace()
_STOP = np.zeros(0x3001, dtype=bool)
_STOP[[ord(c) for c in ".?!|।॥…"]] = True
_BREAK = np.zeros(0x3001, dtype=bool)  # what parts the entries of a list
_BREAK[[ord(c) for c in "\n\r,;—|।॥"]] = True
_END = np.zeros(0x3001, dtype=bool)  # of those the ones that end a line or verse, as often several together: `|| 2 ||\r\n`
_END[[ord(c) for c in "\n\r|।॥"]] = True
_DIGIT = np.array([chr(c).isdigit() for c in range(0x3001)])


@dataclass
class Words:
    """Words of a batch of texts, and what the texts are."""

    owner: np.ndarray  # text of each word
    size: np.ndarray  # letters of each word
    code: np.ndarray  # hash of each word
    count: np.ndarray  # words of each text
    sentences: np.ndarray  # sentences of each text; 0 if it has neither marks nor lines
    lang: np.ndarray  # of each text: ENGLISH, SANSKRIT or OTHER
    running: np.ndarray  # whether each text is running text


def _breaks(low: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of the breaks; of ends with only white space and digits between them the first alone."""
    at = np.flatnonzero(_BREAK[low])
    if not len(at):
        return at
    end = _END[low]
    other = np.cumsum(~(end | _SPACE[low] | _DIGIT[low]))
    owner = np.searchsorted(starts, at, side="right")
    ends = end[at]
    again = np.append(False, ends[1:] & ends[:-1] & (owner[1:] == owner[:-1]) & (other[at[1:]] == other[at[:-1]]))
    return at[~again]


def words_of(texts: list[str | None]) -> Words:
    """Words are stretches between white space with a letter in them."""
    points, starts = code_points(texts)
    n = len(starts) - 1
    low = np.minimum(points, 0x3000)
    gap = _SPACE[low]
    first = ~gap
    first[1:] &= gap[:-1]
    heads = starts[:-1][starts[:-1] < starts[1:]]
    first[heads] |= ~gap[heads]
    begin = np.flatnonzero(first)
    # Letters of each stretch: cut the points at the stretches' starts, white space has no letters.
    cuts = np.append(begin, len(points))
    letters, at = letters_of_points(points[cuts[0] :] if len(begin) else points[:0], cuts - (cuts[0] if len(begin) else 0))
    sizes = np.diff(at)
    owner = np.searchsorted(starts, begin, side="right") - 1
    # A text's first stretch may follow white space; its owner is the text that holds it.
    real = sizes > 0
    owner, word_sizes, word_at = owner[real], sizes[real], at[:-1][real]
    code = _hash_runs(letters, word_at, word_sizes)
    count = np.bincount(owner, minlength=n)
    point_owner = lambda where: np.searchsorted(starts, where, side="right") - 1
    stop = _STOP[low]
    runs = np.flatnonzero(stop & ~np.append(False, stop[:-1])) if len(stop) else np.zeros(0, dtype=np.int64)
    stops = np.bincount(point_owner(runs), minlength=n)
    lines = np.bincount(point_owner(np.flatnonzero(points == 10)), minlength=n)
    sentences = np.where(stops > 0, stops, np.where(lines > 0, lines + 1, 0))
    breaks = np.bincount(point_owner(_breaks(low, starts)), minlength=n)
    english = np.isin(code, _ENGLISH_CODES)
    german = np.isin(code, _GERMAN_CODES)
    en, de = np.bincount(owner[english], minlength=n), np.bincount(owner[german], minlength=n)
    lang = np.where(de > np.maximum(en, 0.08 * count), OTHER, np.where(en >= 0.08 * count, ENGLISH, SANSKRIT))
    running = (count >= 50) & (count > 1.5 * breaks)
    return Words(owner, word_sizes, code, count, sentences, lang, running)


_ENGLISH_CODES = np.array([word_hash(w) for w in ENGLISH_WORDS], dtype=np.uint64)
_GERMAN_CODES = np.array([word_hash(w) for w in GERMAN_WORDS], dtype=np.uint64)


def _kept_codes(words: Words) -> np.ndarray:
    """The word's hash with its language in the lowest bit."""
    lang = np.maximum(words.lang, 0)[words.owner].astype(np.uint64)
    return (words.code & ~np.uint64(1)) | lang


def _sentence_code(words: Words) -> np.ndarray:
    """Of each text: the bin of its mean sentence length (eighths of an octave), -1 if unknown."""
    mean = words.count / np.maximum(1, words.sentences)
    return np.where(words.sentences > 0, np.clip(np.round(4 * np.log2(np.maximum(mean, 1))), 0, 40), -1).astype(np.int64)


def consensus(labels: DataFrame) -> DataFrame:
    """(doc_id, low, high): the median grade of each document, over graders' latest grades; low = high unless two levels share it.

    Null levels and levels off the scale don't count; of one grader's grades the
    latest does (at the same time the higher one).
    """
    valid = labels.where(F.col("doc_id").isNotNull() & F.col("level").between(1, 4))
    latest = valid.groupBy("doc_id", "grader").agg(F.max(F.struct("graded_at", "level")).alias("row")).select("doc_id", F.col("row.level").alias("level"))
    middle = latest.groupBy("doc_id").agg(F.percentile("level", F.lit(0.5)).alias("middle"))
    return middle.select("doc_id", F.floor("middle").cast("int").alias("low"), F.ceil("middle").cast("int").alias("high"))


_UNIT = "kind int, lang int, code long, fold int, level int, n double"
_RARE = "array<struct<code: bigint, counts: array<float>>>"
_WORD, _LENGTH, _SENTENCE, _TEXT = 0, 1, 2, 3


def graded_units(graded: DataFrame) -> DataFrame:
    """Uses of words, word lengths and sentence lengths in graded texts, by fold and level, summed per batch: (kind, lang, code, fold, level, n).

    `graded` has (doc_id, text, low, high).  The kind _TEXT counts all words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column(1).to_pylist())
            fold = _fold(np.asarray(batch.column(0)))
            use = words.running & (words.lang >= 0)
            mine = use[words.owner]
            owner = words.owner[mine]
            out = []
            for level, share in ((batch.column(2), 0.5), (batch.column(3), 0.5)):
                of = np.asarray(level)
                ones = np.full(len(owner), share)
                texts = np.flatnonzero(use)
                known = texts[_sentence_code(words)[texts] >= 0]
                for kind, who, code, n in (
                    (_WORD, owner, _kept_codes(words)[mine].view(np.int64), ones),
                    (_LENGTH, owner, np.minimum(words.size[mine], LONGEST), ones),
                    (_SENTENCE, known, _sentence_code(words)[known], np.full(len(known), share)),
                    (_TEXT, owner, np.zeros(len(owner), dtype=np.int64), ones),
                ):
                    out.append((np.full(len(who), kind), words.lang[who], code, fold[who], of[who], n))
            kind, lang, code, fold_, level_, n = (np.concatenate([x[k] for x in out]) for k in range(6))
            table = pa.table(
                [kind.astype(np.int32), lang.astype(np.int32), code.astype(np.int64), fold_.astype(np.int32), level_.astype(np.int32), n],
                names=["kind", "lang", "code", "fold", "level", "n"],
            ).group_by(["kind", "lang", "code", "fold", "level"]).aggregate([("n", "sum")]).rename_columns(["kind", "lang", "code", "fold", "level", "n"])
            yield from table.to_batches()

    return graded.select("doc_id", "text", "low", "high").mapInArrow(run, _UNIT).groupBy("kind", "lang", "code", "fold", "level").agg(F.sum("n").alias("n"))


def _fold(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * _MIX
    return ((x ^ (x >> np.uint64(31))) % np.uint64(FOLDS)).astype(np.int32)


def unit_counts(units: DataFrame) -> DataFrame:
    """One row per unit, (kind, lang, code, counts): the counts by fold and level as one array of FOLDS * 4."""
    cell = (F.col("fold") * 4 + F.col("level") - 1).cast("int")
    sums = [F.sum(F.when(F.col("cell") == k, F.col("n")).otherwise(0.0)) for k in range(FOLDS * 4)]
    return units.withColumn("cell", cell).groupBy("kind", "lang", "code").agg(F.array(*sums).cast("array<float>").alias("counts"))


@dataclass
class Grader:
    """Grades of all known units; `without` leaves out one fold of the graded texts."""

    codes: np.ndarray  # sorted hashes of the known words
    counts: np.ndarray  # (words, folds, levels)
    lengths: np.ndarray  # (lang, length, fold, level)
    sentences: np.ndarray  # (lang, bin, fold, level)
    texts: np.ndarray  # (lang, fold, level)
    strength: float = 2.0

    def grades(self, without: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Grades of the words, of word lengths by language, and of sentence lengths by language."""
        keep = [f for f in range(FOLDS) if f != without]
        total = np.maximum(self.texts[:, keep].sum(1), 1e-9)  # (lang, level)
        mean = total.mean(1)

        def shape(counts: np.ndarray) -> np.ndarray:
            rate = (counts[:, :, keep].sum(2) + 1e-3) / total[:, None]
            return rate / rate.sum(-1, keepdims=True)

        lengths = shape(self.lengths)
        lang = (self.codes & np.uint64(1)).astype(np.int64)
        rate = self.counts[:, keep].sum(1, dtype=np.float64) / total[lang] * mean[lang][:, None]
        # Without its length at hand a known word is smoothed towards the whole; each word then meets its length's prior in features().
        both = rate.sum(1)
        sent = self.sentences[:, :, keep].sum(2) + 0.2
        sent = sent / np.maximum(1e-9, sent.sum(1, keepdims=True))
        sent /= sent.sum(-1, keepdims=True)
        return (np.stack([both, rate @ LEVELS], axis=1), lengths @ LEVELS, sent @ LEVELS)

    def with_words(self, codes: np.ndarray, counts: np.ndarray) -> Grader:
        """The grader of other words, with the same priors."""
        return Grader(codes, counts, self.lengths, self.sentences, self.texts, self.strength)

    def features(self, words: Words, tables: tuple[np.ndarray, np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """(texts, quantiles + 4): quantiles and mean of the grades of each text's words, the grade of its sentences and their length.

        `more` has codes and grades of further words.
        """
        known, lengths, sentences = tables
        lang = np.maximum(words.lang, 0)
        code = _kept_codes(words)
        mass, sums = np.zeros(len(code)), np.zeros(len(code))
        for codes, grades in ((self.codes, known), *([more] if more else [])):
            if len(codes):
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[at] == code
                mass[hit], sums[hit] = grades[at[hit], 0], grades[at[hit], 1]
        prior = lengths[lang[words.owner], np.minimum(words.size, LONGEST)]
        grade = (sums + self.strength * prior) / (mass + self.strength)
        n = len(words.count)
        order = np.lexsort((grade, words.owner))
        grade = grade[order]
        first = np.append(0, np.cumsum(words.count))[:-1]
        out = np.zeros((n, len(QUANTILES) + 4))
        some = words.count > 0
        for k, q in enumerate(QUANTILES):
            place = q * (words.count[some] - 1)
            low = np.floor(place).astype(np.int64)
            high = np.minimum(low + 1, words.count[some] - 1)
            a, b = grade[first[some] + low], grade[first[some] + high]
            out[some, k] = a + (b - a) * (place - low)
        out[some, len(QUANTILES)] = np.add.reduceat(grade, first[some]) / words.count[some] if some.any() else 0
        bins = _sentence_code(words)
        told = bins >= 0
        out[told, -3] = sentences[lang[told], bins[told]] - 2.5
        out[told, -2] = np.log2(np.maximum(1, words.count[told] / words.sentences[told])) - 3.5
        out[~told, -1] = 1
        return out


@dataclass
class Calibration:
    """A multinomial model of the level for each language, on the features and their squares."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @staticmethod
    def _wide(x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.ones((len(x), 1)), x, x[:, :-1] ** 2], axis=1)

    def levels(self, features: np.ndarray, lang: np.ndarray) -> np.ndarray:
        out = np.zeros(len(features), dtype=np.int32)
        for g in (ENGLISH, SANSKRIT):
            of = lang == g
            if of.any():
                x = self._wide((features[of] - self.centre[g]) / self.scale[g])
                out[of] = (x @ self.weights[g]).argmax(1) + 1
        return out

    @classmethod
    def fit(cls, features: np.ndarray, lang: np.ndarray, targets: np.ndarray, *, rounds: int = 600, rate: float = 0.5, decay: float = 1e-3) -> Calibration:
        """`targets`: share of each level for each row.  A language without rows gives level 1."""
        n = features.shape[1]
        centre, scale, weights = np.zeros((2, n)), np.ones((2, n)), np.zeros((2, 2 * n, 4))
        for g in (ENGLISH, SANSKRIT):
            of = lang == g
            if not of.any():
                continue
            centre[g] = features[of].mean(0)
            spread = features[of].std(0)
            scale[g] = np.where(spread > 1e-9, spread, 1)
            x = np.clip(cls._wide((features[of] - centre[g]) / scale[g]), -9, 9)
            w, speed = weights[g], np.zeros_like(weights[g])
            for _ in range(rounds):
                z = x @ w
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                speed = 0.9 * speed - rate * 0.1 * (x.T @ (p - targets[of]) / len(x) + decay * w)
                w += speed
        return cls(centre, scale, weights)


def known_units(units: DataFrame, *, min_uses: float = 2.0) -> DataFrame:
    """unit_counts of words with at least `min_uses` uses in graded texts, and of all other units."""
    counts = unit_counts(units)
    uses = F.aggregate("counts", F.lit(0.0), lambda a, b: a + b.cast("double"))
    return counts.where((F.col("kind") != _WORD) | (uses >= min_uses))


def grader_of(units: DataFrame) -> Grader:
    """The grader on the driver; for as many known words as `reading_levels` broadcasts."""
    table = units.toArrow().combine_chunks()
    kind, lang, code = (np.asarray(table.column(k)) for k in ("kind", "lang", "code"))
    flat = np.asarray(table.column("counts").combine_chunks().flatten()) if table.num_rows else np.zeros(0)
    counts = flat.reshape(-1, FOLDS, 4)
    word = kind == _WORD
    codes = code[word].view(np.uint64)
    order = np.argsort(codes)
    lengths, sentences, texts = np.zeros((2, LONGEST + 1, FOLDS, 4)), np.zeros((2, 41, FOLDS, 4)), np.zeros((2, FOLDS, 4))
    for what, into in ((_LENGTH, lengths), (_SENTENCE, sentences)):
        rows = np.flatnonzero(kind == what)
        into[lang[rows], code[rows]] = counts[rows]
    rows = np.flatnonzero(kind == _TEXT)
    texts[lang[rows]] = counts[rows]
    return Grader(codes[order], counts[word][order], lengths, sentences, texts)


_UNLISTED = "doc_id long, code long"


def _with_rare(documents: DataFrame, rare: DataFrame | None, shared: Broadcast) -> DataFrame:
    """Adds `rare`, the (code, counts) of those of each document's words that are in `rare` and not in the broadcast grader; null without such.

    Frequent words are in the broadcast, so no code of the join is shared by very many documents of the graded kind.
    """
    if rare is None:
        return documents.withColumn("rare", F.lit(None).cast(_RARE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.codes
        for batch in batches:
            words = words_of(batch.column(1).to_pylist())
            mine = (words.running & (words.lang >= 0))[words.owner]
            code, owner = _kept_codes(words)[mine], words.owner[mine]
            if len(known):
                new = known[np.minimum(np.searchsorted(known, code), len(known) - 1)] != code
                code, owner = code[new], owner[new]
            pairs = pa.table([batch.column(0).take(pa.array(owner)), pa.array(code.view(np.int64))], names=["doc_id", "code"])
            yield from pairs.group_by(["doc_id", "code"]).aggregate([]).to_batches()

    asked = documents.select("doc_id", "text").mapInArrow(run, _UNLISTED).distinct()
    met = asked.join(rare, "code").groupBy("doc_id").agg(F.collect_list(F.struct("code", "counts")).cast(_RARE).alias("rare"))
    return documents.join(met, "doc_id", "left")


def _further(column: pa.Array, own: Grader) -> Grader | None:
    """The grader of the further words of a batch."""
    rows = column.flatten()  # without those of null lists
    if not len(rows):
        return None
    codes, first = np.unique(np.asarray(rows.field("code")).view(np.uint64), return_index=True)
    counts = np.asarray(rows.field("counts").flatten()).reshape(-1, FOLDS, 4)
    return own.with_words(codes, counts[first])


def calibrate(graded: DataFrame, grader: Grader, rare: DataFrame | None = None, *, sample: int = 20_000) -> Calibration:
    """Fits the calibration on graded documents, each by grades from the other folds.  Of more than `sample` about so many are taken, those whose hash of the id is below a bound."""
    shared = graded.sparkSession.sparkContext.broadcast(grader)
    width = len(QUANTILES) + 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        tables = [own.grades(without=f) for f in range(FOLDS)]
        for batch in batches:
            words = words_of(batch.column(1).to_pylist())
            fold = _fold(np.asarray(batch.column(0)))
            further = _further(batch.column(4), own)
            more = [further and (further.codes, further.grades(without=f)[0]) for f in range(FOLDS)]
            every = np.stack([own.features(words, t, m) for t, m in zip(tables, more, strict=True)])
            x = every[fold, np.arange(len(fold))]
            use = np.flatnonzero(words.running & (words.lang >= 0))
            at = pa.array(use)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words.lang[use].astype(np.int32)), batch.column(2).take(at), batch.column(3).take(at), pa.array(list(x[use]), type=pa.list_(pa.float64()))],
                names=["lang", "low", "high", "features"],
            )

    n = graded.count()
    few = graded if n <= sample else graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < (1 << 30) * sample // n)
    if rare is not None:
        few = cut(few)
    table = _with_rare(few, rare, shared).select("doc_id", "text", "low", "high", "rare").mapInArrow(run, "lang int, low int, high int, features array<double>").toArrow()
    x = np.asarray(table.column("features").combine_chunks().flatten()).reshape(-1, width) if table.num_rows else np.zeros((0, width))
    lang, low, high = (np.asarray(table.column(k)) for k in ("lang", "low", "high"))
    return Calibration.fit(x, lang, (np.eye(4)[low - 1] + np.eye(4)[high - 1]) / 2 if len(low) else np.zeros((0, 4)))


def reading_levels(documents: DataFrame, labels: DataFrame, *, sample: int = 20_000, max_words: int = 1_000_000) -> DataFrame:
    """(doc_id, level) of every document (doc_id, text) with running text in Sanskrit or English of at least 50 words.

    Running text has more than three words for each two line ends, commas,
    semicolons, dashes and dandas, where dandas, bars, verse numbers and line ends
    that follow each other count once; the language is told from function words, not from
    a column.  German is not graded.  Defined cases: null, empty and short texts
    aren't listed; a word without a grade takes that of its length; without usable
    labels no document is listed; rows with a null doc_id are left out.

    Of the known words at most `max_words`, the most used ones, are broadcast.  The
    others are joined to the documents that hold them by a shuffle, so every known
    word keeps its grade at every size.
    """
    docs = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    graded = cut(docs.where(F.col("text").isNotNull()).join(consensus(labels), "doc_id"))
    units = cut(graded_units(graded))
    known, least = cut(known_units(units)), 2.0
    is_word, uses = F.col("kind") == _WORD, F.aggregate("counts", F.lit(0.0), lambda a, b: a + b.cast("double"))
    rare = None
    if known.where(is_word).count() > max_words:
        while known.where(is_word & (uses >= least)).count() > max_words:
            least *= 2
        rare = known.where(is_word & (uses < least)).select("code", "counts")
        known = known.where(~is_word | (uses >= least))
    grader = grader_of(known)
    if not grader.texts.any():
        return docs.limit(0).select("doc_id", F.lit(1).alias("level"))
    calibration = calibrate(graded, grader, rare, sample=sample)
    light = grader.with_words(grader.codes, np.zeros((0, FOLDS, 4), dtype=np.float32))  # the counts stay here
    context = docs.sparkSession.sparkContext
    shared, listed = context.broadcast((light, grader.grades(), calibration)), context.broadcast(light) if rare is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables, model = shared.value
        for batch in batches:
            words = words_of(batch.column(1).to_pylist())
            use = np.flatnonzero(words.running & (words.lang >= 0))
            further = _further(batch.column(2), own)
            levels = model.levels(own.features(words, tables, further and (further.codes, further.grades()[0])), words.lang)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(use)), pa.array(levels[use])], names=["doc_id", "level"])

    return _with_rare(docs, rare, listed).select("doc_id", "text", "rare").mapInArrow(run, "doc_id long, level int")


def level_profile(levels: DataFrame, documents: DataFrame) -> DataFrame:
    """(source, level, documents): how the documents of each source are spread over the levels."""
    return levels.join(documents.select("doc_id", "source"), "doc_id").groupBy("source", "level").agg(F.count(F.lit(1)).alias("documents"))
