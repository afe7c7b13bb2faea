"""Quality classifier: a linear-chain conditional random field labels every line of a document good or bad.

A line's features are counts of its own and of the lines beside it. Only documents have labels, so lines get
theirs by turns with the fit: a good document's lines are good but for those that look bad beyond doubt, and a
bad document's lines are those that look bad, its worst at least. So chains hold both labels and transitions
are learnt. Forward-backward gives each line's probability of being good; weighted by the lines' lengths they
make the document's score, which a logistic curve of two parameters fits to the labels. For documents of very many lines
the same weighted sum comes out of one pass over blocks of lines, by products of transfer matrices and their derivatives.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm import textstats as ts
from covenant.llm.cluster import prepare, remainder, tidy
from covenant.llm.learning import SAMPLE, labelled_sample
from covenant.llm.trees import sigmoid
from covenant.llm.words import Words, slices

#: Lines of a batch that are handled at once, lines of a document that forward-backward takes, and bytes in a block of a longer one.
LINES, CHAIN, BLOCK_BYTES = 100_000, 4096, 128 << 10
#: Labelled documents of more lines aren't learnt from.
LEARNT_LINES = 200
#: Turns of labelling lines and fitting; the odds of being good below which a good document's line counts as bad.
TURNS, DOUBT = 3, 0.02

_STEPS = {"symbols": (0.005, 0.03, 0.1), "bangs": (0.05, 0.3), "upper": (0.12, 0.4), "pipes": (0.05, 0.3), "again": (0.05, 0.3), "repeated": (0.1, 0.5), "seen": (0.5,)}
N_FEATURES = 1 + 14 + 7 + 7 + 7 + 2


@dataclass
class Lines:
    """The lines of a batch: ``features`` (lines x features), where each document's lines start, and their lengths."""

    features: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def _measured(flat: pa.Array, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's own features, its marks (what its neighbours look at), and its length; ``seen`` says whether an equal line came before."""
    words = Words(flat)
    data, begins = ts.text_bytes(flat)
    counts = ts.kind_counts(data, begins)
    kind = lambda name: counts[:, ts.KINDS.index(name)].astype(np.float32)
    n = words.counts.astype(np.float32)
    chars = np.maximum(ts.word_chars(counts), 1).astype(np.float32)
    per_word = np.maximum(n, 1)
    again = np.zeros(len(words.codes), np.int64)
    again[1:] = words.codes[1:] == words.codes[:-1]
    again[words.starts[:-1][n > 0]] = 0
    rate = {
        "symbols": kind("symbol") / chars,
        "bangs": kind("bang") / per_word,
        "upper": kind("upper") / chars,
        "pipes": kind("pipe") / per_word,
        "again": ts.sums(again, words.starts) / per_word,
        "repeated": ts.repeated_windows(words) / per_word,
        "seen": (seen & (n > 0)).astype(np.float32),
    }
    own = [rate[k] > s for k, at in _STEPS.items() for s in at]
    own += [kind("digit") / chars > 0.1, n == 0, (n > 0) & (n < 4), n > 150, ts.word_chars(counts) / per_word > 9, ts.word_chars(counts) / per_word < 3, kind("stop") == 0]
    return np.stack(own, axis=1), np.stack([rate[k] > at[0] for k, at in _STEPS.items()], axis=1), chars


def _assembled(own: np.ndarray, marks: np.ndarray, heads: np.ndarray, tails: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
    """Features of all lines; ``heads`` and ``tails`` are documents' first and last lines, ``before`` and ``after`` the marks of the lines beside the whole."""
    k, m = own.shape[1], marks.shape[1]
    out = np.zeros((len(own), N_FEATURES), np.float32)
    out[:, 0] = 1
    out[:, 1 : k + 1] = own
    out[1:, k + 1 : k + 1 + m] = marks[:-1]
    out[:-1, k + 1 + m : k + 1 + 2 * m] = marks[1:]
    if before is not None and len(out):
        out[0, k + 1 : k + 1 + m] = before
    if after is not None and len(out):
        out[-1, k + 1 + m : k + 1 + 2 * m] = after
    out[heads, k + 1 : k + 1 + m] = 0
    out[tails, k + 1 + m : k + 1 + 2 * m] = 0
    out[heads, -2], out[tails, -1] = 1, 1
    return out


def line_features(texts: pa.Array) -> Lines:
    flat, starts = ts.lines(texts)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.unique(rows * (int(codes.max()) + 1 if len(codes) else 1) + codes, return_index=True)[1]
    seen = np.ones(len(flat), bool)
    seen[first] = False
    own, marks, lengths = _measured(flat, seen)
    return Lines(_assembled(own, marks, starts[:-1], starts[1:] - 1), starts, lengths.astype(float))


def _blocks(text: str | bytes):
    """The lines of one text, some of them at a time."""
    data = text.encode() if isinstance(text, str) else text
    at = 0
    while True:
        end = len(data)
        if at + BLOCK_BYTES < end:
            end = data.rfind(b"\n", at, at + BLOCK_BYTES)
            end = data.find(b"\n", at + BLOCK_BYTES) if end < 0 else end
            end = len(data) if end < 0 else end
        yield ts.lines(pa.array([data[at:end].decode()], pa.large_string()))[0]
        if end == len(data):
            return
        at = end + 1


def long_features(text: str | bytes):
    """(features, lengths) of the lines of one text, by blocks; equal to ``line_features`` of the whole. Distinct lines' 64-bit hashes are held."""
    known = np.zeros(0, np.uint64)
    before, waiting = None, None
    for flat in _blocks(text):
        coded = flat.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))
        seen = np.ones(len(flat), bool)
        seen[np.unique(codes, return_index=True)[1]] = False
        seen |= np.isin(hashes, known)[codes]
        known = np.union1d(known, hashes)
        now = _measured(flat, seen)
        if waiting:
            own, marks, lengths, head = waiting
            yield _assembled(own, marks, [0] if head else [], [], before, now[1][0]), lengths
            before = marks[-1]
        waiting = (*now, waiting is None)
    own, marks, lengths, head = waiting
    yield _assembled(own, marks, [0] if head else [], [len(own) - 1], before), lengths


def forward_backward(ratio: np.ndarray, starts: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(good) for every line, and the expected number of each pair of neighbouring labels [bad, good] x [bad, good].

    ``ratio`` is exp(score of good minus score of bad) of each line, ``pair`` the factors of neighbours.
    All chains go one line further at a time; longer chains come first, so those still going are a prefix.
    """
    counts = np.diff(starts)
    order = np.argsort(-counts, kind="stable")
    begin, length = starts[:-1][order], counts[order]
    longest = int(length[0]) if len(length) else 0
    going = np.searchsorted(-length, -np.arange(longest), side="left")  # chains longer than t
    n = len(ratio)
    forward = np.empty(n)
    good = None
    for t in range(longest):
        k = int(going[t])
        at = begin[:k] + t
        r = ratio[at]
        if t:
            g = good[:k]
            to_good, to_bad = g * pair[1, 1] + (1 - g) * pair[0, 1], g * pair[1, 0] + (1 - g) * pair[0, 0]
            good = r * to_good / (r * to_good + to_bad)
        else:
            good = r / (r + 1)
        forward[at] = good
    marginal, pairs = np.empty(n), np.zeros((2, 2))
    later = np.ones((len(length), 2))
    for t in range(longest - 1, -1, -1):
        k = int(going[t])
        at = begin[:k] + t
        b = later[:k]  # rest of the chain given bad, good
        f = forward[at]
        g = f * b[:, 1]
        marginal[at] = g / (g + (1 - f) * b[:, 0])
        if t:
            r = ratio[at]
            p = forward[at - 1]
            joint = np.stack(((1 - p) * pair[0, 0] * b[:, 0], (1 - p) * pair[0, 1] * r * b[:, 1], p * pair[1, 0] * b[:, 0], p * pair[1, 1] * r * b[:, 1]), axis=1)
            pairs += (joint / joint.sum(1, keepdims=True)).sum(0).reshape(2, 2)
            bad_back = pair[0, 0] * b[:, 0] + pair[0, 1] * r * b[:, 1]
            good_back = pair[1, 0] * b[:, 0] + pair[1, 1] * r * b[:, 1]
            total = bad_back + good_back
            later[:k, 0], later[:k, 1] = bad_back / total, good_back / total
    return marginal, pairs


def transfer(ratio: np.ndarray, weight: np.ndarray, pair: np.ndarray, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Product of the lines' transfer matrices [bad, good] x [bad, good], and its derivative by the weights of good lines, both to one scale.

    The chain's first line has no transition into it: it starts from the state bad.
    """
    m = np.empty((len(ratio), 2, 2))
    m[:, :, 0], m[:, :, 1] = pair[:, 0], pair[:, 1] * ratio[:, None]
    if first:
        m[0] = (1, ratio[0]), (0, 0)
    d = m * np.array((0.0, 1.0)) * weight[:, None, None]
    while len(m) > 1:
        rest = len(m) % 2
        a, b, da, db = m[: len(m) - rest : 2], m[1::2], d[: len(m) - rest : 2], d[1::2]
        both, slope = a @ b, a @ db + da @ b
        if rest:
            both, slope = np.concatenate((both, m[-1:])), np.concatenate((slope, d[-1:]))
        scale = both.sum((1, 2), keepdims=True)
        m, d = both / scale, slope / scale
    return m[0], d[0]


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray
    slope: float
    bias: float

    def ratio(self, features: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(features @ self.weights, -30, 30))

    def raw(self, lines: Lines) -> np.ndarray:
        """Length-weighted mean of the lines' probabilities of being good, for each document."""
        marginal, _ = forward_backward(self.ratio(lines.features), lines.starts, np.exp(self.pair))
        return ts.sums(marginal * lines.lengths, lines.starts) / np.maximum(ts.sums(lines.lengths, lines.starts), 1e-9)

    def raw_long(self, text: str | bytes) -> float:
        """``raw`` of one text, some of its lines at a time."""
        mass, slope, total, pair = np.array((1.0, 0.0)), np.zeros(2), 0.0, np.exp(self.pair)
        for k, (features, lengths) in enumerate(long_features(text)):
            m, d = transfer(self.ratio(features), lengths.astype(float), pair, k == 0)
            mass, slope = mass @ m, mass @ d + slope @ m
            mass, slope, total = mass / mass.sum(), slope / mass.sum(), total + float(lengths.sum(dtype=float))
        return float(slope.sum() / mass.sum() / total)

    def score(self, texts: pa.Array) -> np.ndarray:
        """The score of each text, from 0 to 1."""
        counts = pc.add(pc.count_substring(pc.fill_null(texts, ""), "\n"), 1).to_numpy(zero_copy_only=False).astype(np.int64)
        raw = np.empty(len(texts))
        total, first = np.cumsum(counts), 0
        while first < len(texts):
            before = total[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(total, before + LINES, side="right")))
            long = np.nonzero(counts[first:last] > CHAIN)[0] + first
            short = np.nonzero(counts[first:last] <= CHAIN)[0] + first
            if len(short):
                raw[short] = self.raw(line_features(texts.take(pa.array(short))))
            for k in long.tolist():
                raw[k] = self.raw_long(texts[k].as_buffer().to_pybytes())
            first = last
        return sigmoid(self.slope * _logit(raw) + self.bias)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def line_labels(odds: np.ndarray, starts: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels of lines by their own probabilities of being good and their documents' labels (see the top)."""
    good = np.repeat(y, np.diff(starts)) > 0
    labels = np.where(good, odds >= DOUBT, odds > 0.5).astype(float)
    worst = np.minimum.reduceat(odds, starts[:-1])
    labels[~good & (odds <= np.repeat(worst, np.diff(starts)))] = 0
    return labels


def fit_crf(features: np.ndarray, starts: np.ndarray, labels: np.ndarray, steps: int = 80, rate: float = 0.1, l2: float = 1e-3, theta: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and pair scores of greatest likelihood of the lines' labels; Adam on all chains."""
    inner = np.ones(len(labels), bool)
    inner[starts[:-1]] = False
    at = np.nonzero(inner)[0]
    seen = np.bincount((2 * labels[at - 1] + labels[at]).astype(int), minlength=4).reshape(2, 2)
    theta = np.zeros(features.shape[1] + 4) if theta is None else theta
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, pair = theta[:-4], theta[-4:].reshape(2, 2)
        marginal, pairs = forward_backward(np.exp(np.clip(features @ w, -30, 30)), starts, np.exp(pair))
        gradient = np.concatenate((features.T @ (labels - marginal), (seen - pairs).ravel())) / max(len(labels), 1) - l2 * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def fit_curve(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and bias of a logistic curve by Newton's method, with a weak pull to slope 1 and bias 0."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        h = p * (1 - p)
        g = np.array([((y - p) * z).sum() - 0.1 * (a - 1), (y - p).sum() - 0.1 * b])
        hess = np.array([[(h * z * z).sum() + 0.1, (h * z).sum()], [(h * z).sum(), h.sum() + 0.1]])
        step = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a + step[0], b + step[1]
    return float(max(a, 1e-3)), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE // 2) -> Model:
    """Fits on at most ``sample`` labelled documents whose crc32(doc_id) mod 3 isn't 1 (see ``labelled_sample``).

    Lines' features come to the driver packed as bits. Without labels of both classes the score is a constant near the labels' share.
    """
    prepare(docs.sparkSession)

    def gather(batches):
        for batch in slices(batches):
            counts = pc.add(pc.count_substring(pc.fill_null(batch.column(1), ""), "\n"), 1)
            batch = batch.filter(pc.less_equal(counts, LEARNT_LINES))
            lines = line_features(batch.column(1))
            bits = np.packbits(lines.features.astype(bool), axis=1)
            cut = lines.starts.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([bits[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([lines.lengths[a:b].tolist() for a, b in zip(cut, cut[1:], strict=False)], pa.list_(pa.float64()))], names=["doc_id", "y", "bits", "lengths"])

    rows = labelled_sample(docs, labels, label, sample).mapInArrow(tidy(gather), "doc_id long, y double, bits binary, lengths array<double>").toArrow().sort_by("doc_id")
    y = rows["y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), 1.0, float(_logit(np.array((y.sum() + 0.5) / (len(y) + 1)))))
    counts = np.array([len(x) for x in rows["lengths"].to_pylist()])
    width = -(-N_FEATURES // 8)
    features = np.unpackbits(np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint8).reshape(-1, width), axis=1)[:, :N_FEATURES].astype(np.float32)
    starts = np.concatenate(([0], np.cumsum(counts)))
    weights, pair = fit_crf(features, starts, np.repeat(y, counts))
    for _ in range(TURNS - 1):
        weights, pair = fit_crf(features, starts, line_labels(sigmoid(features @ weights), starts, y), 40, theta=np.append(weights, pair))
    model = Model(weights, pair, 1.0, 0.0)
    raw = model.raw(Lines(features, starts, np.array(pc.list_flatten(rows["lengths"]).to_pylist(), float)))
    model.slope, model.bias = fit_curve(_logit(raw), y)
    return model


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each document: doc_id, held_out (crc32(doc_id) mod 3 is 1), score (0 to 1, higher: likelier good), predicted.

    Lines are cut at \\n; a null or empty text is one empty line. Rows that repeat an id are scored each by itself.
    """
    prepare(docs.sparkSession)

    def run(batches):
        for batch in slices(batches):
            s = model.score(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], schema=OUT)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder(F.col("doc_id").cast("long"), 3) == 1).alias("held_out")).mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, predicted int")
