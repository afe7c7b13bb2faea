"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

The lexicon, words and beginnings of words that mark toxic documents, is learnt from the whole labelled sample.
The trees are fitted on features by lexicons of the other half of the sample each, so they see a lexicon at work
on texts it wasn't drawn from; the calibration on margins that each fifth gets from trees fitted on the other four.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm import textstats as ts
from covenant.llm import trees
from covenant.llm.cluster import discard, materialised, prepare, remainder, tidy
from covenant.llm.learning import SAMPLE, labelled_sample
from covenant.llm.words import Words, slices

#: Insults that are known from the start.
SEEDS = ("idiot", "idiots", "stupid", "moron", "morons", "loser", "losers", "scum", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumb", "fool", "garbage", "vermin", "filth", "dummkopf", "trottel", "abschaum", "imbécile", "crétin", "connard", "idiota", "estúpido", "imbécil", "basura")
SECOND_PERSON = ("you", "your", "yours", "yourself", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "tu", "toi", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "vosotros")
NEAR = 5
PREFIXES = (4, 5)
#: Documents that a lexicon entry was seen in at least, and evidence it needs (twice the log-likelihood ratio's half). The sample bounds the entries.
LEAST_DOCS, LEAST_EVIDENCE = 3, 6.5
#: Parts of the sample for the calibration.
FOLDS = 5

_STRIP = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»„“”’…¡¿"
_UNMASK = str.maketrans("0134578@$!|+", "oieastbasilt")
_MASKED = re.compile(r"[^\W\d_][0-9@$*!|+.\-_]+[^\W\d_]")
_LONG_RUN = re.compile(r"(.)\1{3,}")

FEATURES = {"log_words": 0, "words_hit": 1, "starts_hit": 1, "seeds_hit": 1, "masked_hit": 1, "words_rate": 1, "starts_rate": 1, "seeds_rate": 1, "near_second_person": 1, "second_person_rate": 0, "strongest": 1, "caps_rate": 0, "upper": 0, "bangs": 0, "questions": 0, "masked_rate": 0, "long_runs": 0, "symbols": 0, "kinds_hit": 1}


def bare(word: str) -> str:
    """A word in lower case without the punctuation around it."""
    return word.lower().strip(_STRIP)


def terms(word: str) -> tuple[str, ...]:
    """What the lexicon may know of a bare word: itself, and beginnings, which are written with a trailing hyphen."""
    return (word, *(f"{word[:k]}-" for k in PREFIXES if len(word) > k)) if word else ()


@dataclass
class Model:
    lexicon: dict[str, float]
    forest: trees.Forest
    at: np.ndarray
    probability: np.ndarray

    def score(self, features: np.ndarray) -> np.ndarray:
        """Calibrated probabilities; where the calibration is flat, a thousandth of the trees' own keeps the order."""
        margin = self.forest.margin(features)
        return 0.999 * np.interp(margin, self.at, self.probability) + 0.001 * trees.sigmoid(margin)


class Features:
    """Computes features with one lexicon; keeps what it found out of each distinct word, up to a bound."""

    SEED, WORD, START, MASKED, MASKED_HIT, SECOND, CAPS, RUN = (1 << k for k in range(8))

    def __init__(self, lexicon: dict[str, float], keep: int = 500_000):
        self.lexicon, self.keep, self.known = lexicon, keep, {}
        self.seeds, self.second = frozenset(SEEDS), frozenset(SECOND_PERSON)

    def look(self, raw: bytes) -> tuple[int, float]:
        text = raw.decode()
        word = bare(text)
        flags, weight = 0, 0.0
        if not word:
            return 0, 0.0
        if word in self.seeds:
            flags |= self.SEED
        for k, term in enumerate(terms(word)):
            found = self.lexicon.get(term)
            if found is not None:
                flags |= self.START if k else self.WORD
                weight = max(weight, found)
        if word in self.second:
            flags |= self.SECOND
        if len(word) > 1 and text.isupper():
            flags |= self.CAPS
        if not word.isalpha() and _MASKED.search(word):
            flags |= self.MASKED
            plain = re.sub(r"[*.\-_]", "", word.translate(_UNMASK))
            if plain in self.seeds or plain in self.lexicon:
                flags |= self.MASKED_HIT
        if _LONG_RUN.search(word):
            flags |= self.RUN
        return flags, weight

    def __call__(self, texts: pa.Array) -> np.ndarray:
        words = Words(texts)
        vocab = words.vocab_bytes()
        if len(self.known) + len(vocab) > self.keep:
            self.known = {}
        known = self.known
        for w in vocab:
            if w not in known:
                known[w] = self.look(w)
        found = [known[w] for w in vocab]
        flags = np.fromiter((f for f, _ in found), np.int64, len(found))[words.codes] if found else np.zeros(0, np.int64)
        weights = np.fromiter((x for _, x in found), float, len(found))[words.codes] if found else np.zeros(0)
        starts, n = words.starts, words.counts
        count = lambda mask: ts.sums((flags & mask > 0).astype(np.int64), starts).astype(float)
        hit = flags & (self.SEED | self.WORD | self.START | self.MASKED_HIT) > 0
        total = np.concatenate(([0], np.cumsum(flags & self.SECOND > 0)))
        at, rows = np.nonzero(hit)[0], words.rows[hit]
        near = total[np.minimum(at + NEAR + 1, starts[1:][rows])] - total[np.maximum(at - NEAR, starts[:-1][rows])] > 0
        strongest = np.zeros(len(words))
        np.maximum.at(strongest, rows, weights[hit])
        size = int(words.codes.max()) + 1 if len(words.codes) else 1
        kinds = np.bincount(np.unique(rows * size + words.codes[hit]) // size, minlength=len(words))
        data, begins = ts.text_bytes(texts)
        kind = ts.kind_counts(data, begins)
        column = lambda name: kind[:, ts.KINDS.index(name)].astype(float)
        per_word, chars = np.maximum(n, 1), np.maximum(ts.word_chars(kind), 1)
        return np.stack(
            (np.log1p(n), count(self.WORD), count(self.START), count(self.SEED), count(self.MASKED_HIT), count(self.WORD) / per_word, count(self.START) / per_word, count(self.SEED) / per_word, np.bincount(rows, near, len(words)), count(self.SECOND) / per_word, strongest, count(self.CAPS) / per_word, column("upper") / chars, column("bang") / per_word, column("question") / per_word, count(self.MASKED) / per_word, count(self.RUN) / per_word, ts.symbol_count(kind) / chars, kinds), axis=1
        )


def _parts(sample: DataFrame) -> DataFrame:
    """Adds ``part``, 0 to 2 * ``FOLDS`` - 1: its remainder by two is the half, its half the fold."""
    return sample.withColumn("part", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(2 * FOLDS)).cast("int"))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Terms of ``sample(text, y)`` that toxic documents have much more often; they alone come to the driver."""

    def count(batches):
        for batch in slices(batches):
            words, y = Words(batch.column(0)), batch.column(1).to_numpy()
            names: dict[str, int] = {}
            of = [[names.setdefault(t, len(names)) for t in terms(bare(w.decode()))] for w in words.vocab_bytes()]
            sizes = np.fromiter(map(len, of), np.int64, len(of))
            flat, first = np.array([t for x in of for t in x], np.int64), np.concatenate(([0], np.cumsum(sizes)))
            size = len(of) or 1
            pairs = np.unique(words.rows * size + words.codes)
            rows, codes = pairs // size, pairs % size
            n = sizes[codes]
            at = np.arange(n.sum()) + np.repeat(first[:-1][codes] - (np.cumsum(n) - n), n)
            pairs = np.unique(np.repeat(rows, n) * (len(names) or 1) + flat[at])
            rows, found = pairs // (len(names) or 1), pairs % (len(names) or 1)
            yield pa.RecordBatch.from_pydict({"term": list(names), "docs": np.bincount(found, minlength=len(names)).astype(np.int64), "toxic": np.bincount(found, y[rows], len(names)).astype(np.int64)})

    part = sample.select("text", "y")
    n, toxic = part.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if not 0 < toxic < n:
        return {}
    rate = toxic / n
    rest = F.col("docs") - F.col("toxic")
    evidence = F.col("toxic") * F.log(F.col("toxic") / F.col("docs") / rate) + F.when(rest > 0, rest * F.log(rest / F.col("docs") / (1 - rate))).otherwise(0.0)
    found = (
        part.mapInArrow(tidy(count), "term string, docs long, toxic long")
        .groupBy("term")
        .agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
        .where((F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") > F.col("docs") * (rate + 1) / 2))
        .withColumn("evidence", evidence)
        .where(F.col("evidence") >= LEAST_EVIDENCE)
    )
    return {r["term"]: r["evidence"] for r in found.collect()}


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents whose crc32(doc_id) mod 3 isn't 1 (see ``labelled_sample``)."""

    prepare(docs.sparkSession)
    rows = materialised(_parts(labelled_sample(docs, labels, label, sample)), "toxic-sample")
    halves = [learn_lexicon(rows.where(f"part % 2 = {1 - half}")) for half in (0, 1)]  # each of the other half

    def gather(batches):
        features = [Features(lexicon) for lexicon in halves]
        for batch in slices(batches):
            half = batch.column(3).to_numpy() % 2
            x = np.where(half[:, None] == 0, features[0](batch.column(1)), features[1](batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "part", "x"])

    gathered = rows.select("doc_id", "text", "y", "part").mapInArrow(tidy(gather), "doc_id long, y double, part int, x array<double>").toArrow().sort_by("doc_id")
    x, y, part = np.array(gathered["x"].to_pylist(), float).reshape(len(gathered), len(FEATURES)), gathered["y"].to_numpy(), gathered["part"].to_numpy()
    lexicon = learn_lexicon(rows)
    discard(rows)
    monotone = np.array(list(FEATURES.values()))
    margin = np.zeros(len(x))
    for fold in range(FOLDS):
        mine = part // 2 == fold
        margin[mine] = trees.fit(x[~mine], y[~mine], monotone, trees=50).margin(x[mine])
    return Model(lexicon, trees.fit(x, y, monotone, trees=50), *trees.isotonic(margin, y))


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """A row for each document: doc_id, held_out (crc32(doc_id) mod 3 is 1), score (0 to 1, higher: likelier toxic), predicted.

    A null or empty text has no words and gets the score of a text without any sign. Rows that repeat an id
    are scored each by itself; an empty table gives no rows, and other columns play no part.
    """

    prepare(docs.sparkSession)

    def run(batches):
        features = Features(model.lexicon)
        for batch in slices(batches):
            s = np.clip(model.score(features(batch.column(1))), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], schema=OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder(F.col("doc_id").cast("long"), 3) == 1).alias("held_out")).mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``.

    A null or empty text is judged as one without words; its score is the model's for no sign at all, so it
    stays wherever clean texts do. Rows with a null or a repeated id are judged each by itself. An empty table
    stays empty, and columns of any name but ``text`` pass through as they are.
    """
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        features = Features(model.lexicon)
        for batch in slices(batches):
            yield batch.filter(pa.array(model.score(features(batch.column(at))) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
