"""A log-bilinear language model and its unigram base, learnt from all training documents and applied to all texts.

Tokens are words with A-Z lowered, and one end for each document. Spark counts every token and, for the
model's vocabulary, every pair of neighbours. The vocabulary follows the corpus: the most frequent words, as
many as ``BREADTH`` times the square root of the training tokens, the end, and one class for all other words.
So the table of all scores, which normalising takes, grows in proportion to the corpus and no faster.

A token's score is the product of its predecessor's context vector and its own target vector, whose last place
is a bias. Noise-contrastive estimation fits them by turns: the pairs are kept once by context and once by
target, and with one side given, each vector of the other is a logistic regression of the pairs that were seen
against noise drawn from the unigram distribution, climbed by Newton steps. A task owns the vectors that it
fits, so what comes back from all tasks together is each vector once. Matrix products by blocks normalise the
scores into token log-probabilities. A word outside the vocabulary has its class's probability times its
add-one share among such words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.llm import textstats as ts
from covenant.llm.cluster import BATCH_ROWS, discard, materialised, prepare, remainder, tidy
from covenant.llm.words import Words, slices

#: Words in the model's vocabulary for each square root of a training token.
BREADTH = 2.0
#: Words whose counts every task has at hand besides the vocabulary's; others are looked up by a join.
AT_HAND = 150_000
#: Numbers in a vector, noise draws for each token, draws that count for those of some vectors, how many vectors share them, rounds, Newton steps in each, and the pull of vectors towards 0.
DIMENSIONS, NOISE, DRAWS, SHARING, ROUNDS, STEPS, PULL = 32, 10, 1024, 64, 3, 1, 4.0
#: Pairs in a row of the two tables, and targets that are normalised over at once.
ROW_PAIRS, BLOCK = 1 << 18, 4096
#: Distinct pairs that a task adds up before it sends them.
HELD_PAIRS = 1_500_000
#: Bytes of text that a pass works on at once; its arrays are some 15 times as large.
SLICE = 1 << 20
END = ""  # no word is empty
HELD_WORDS = 200_000


def count_tokens(texts: DataFrame) -> DataFrame:
    """(word, n) for every distinct token of ``texts(text)``; the end has the word ''. Tasks add up what they can hold before the shuffle."""

    def run(batches):
        held: dict[str, int] = {}

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()

        for batch in slices(batches, SLICE):
            words = Words(batch.column(0), lower=True)
            for w, n in zip(words.vocab.to_pylist(), np.bincount(words.codes, minlength=len(words.vocab)).tolist(), strict=True):
                held[w] = held.get(w, 0) + n
            held[END] = held.get(END, 0) + batch.num_rows
            if len(held) > HELD_WORDS:
                yield from out()
        if held:
            yield from out()

    return texts.mapInArrow(tidy(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, most: int) -> Column:
    """A condition on ``counts(word, n)`` that about ``most`` of the most frequent words meet.

    Counts are put into steps of a 64th of an octave, so some 4,000 rows come to the driver at most. Of the step
    that holds the limit, words are taken by their hash.
    """
    step = F.floor(F.log2("n") * 64)
    left, least, last, share = most, 1 << 62, 1 << 62, 0
    for n, words in sorted(((r["n"], r["w"]) for r in counts.groupBy(step).agg(F.min("n").alias("n"), F.count("*").alias("w")).collect()), reverse=True):
        last = n
        if words > left:
            share = (left << 20) // words
            break
        left, least = left - words, n
    return (F.col("n") >= least) | ((F.col("n") >= last) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < share)) | (F.col("word") == END)


@dataclass
class Table:
    """Counts of the words at hand by the words' 64-bit hashes, and their numbers in the model's vocabulary."""

    hashes: np.ndarray
    counts: np.ndarray
    numbers: np.ndarray
    size: int  # of the model's vocabulary with the end and the class of others

    OTHER, STOP = 0, 1

    @staticmethod
    def of(rows: list[tuple[str, int]], vocabulary: int) -> Table:
        """The vocabulary is the ``vocabulary`` most frequent words."""
        import xxhash

        rows = sorted(rows, key=lambda r: (-r[1], r[0]))
        chosen = {w: k + 2 for k, (w, _) in enumerate([r for r in rows if r[0] != END][:vocabulary])} | {END: Table.STOP}
        hashes = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w, _ in rows], np.uint64)
        order = np.argsort(hashes)
        return Table(hashes[order], np.array([n for _, n in rows], np.int64)[order], np.array([chosen.get(w, Table.OTHER) for w, _ in rows], np.int64)[order], len(chosen) + 1)

    def look(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count (0 if not at hand) and number (OTHER if not in the vocabulary) of each hash."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes
        return np.where(hit, self.counts[at], 0), np.where(hit, self.numbers[at], self.OTHER)


def sequence(words: Words, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token's predecessor and number, words and then the end of every text; where each text's tokens start."""
    starts = words.starts + np.arange(len(words) + 1)
    tokens = np.insert(numbers[words.codes], words.starts[1:], Table.STOP)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[starts[:-1]] = Table.STOP
    return before, tokens, starts


def count_pairs(texts: DataFrame, table: Table) -> DataFrame:
    """(before, token, n): how often each number follows each in ``texts(text)``. Tasks add up what they can hold before the shuffle."""
    size = table.size
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        held, waiting = [], 0

        def out():
            pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)
            held.clear()
            for k in range(0, len(pairs), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + (1 << 16)]), pa.array(n[k : k + (1 << 16)])], names=["pair", "n"])

        for batch in slices(batches, SLICE):
            words = Words(batch.column(0), lower=True)
            before, tokens, _ = sequence(words, shared.value.look(words.vocab_hashes())[1])
            held.append(np.unique(before * size + tokens, return_counts=True))
            waiting += len(held[-1][0])
            if waiting > HELD_PAIRS:
                yield from out()
                waiting = 0
        if held:
            yield from out()

    added = texts.mapInArrow(tidy(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return materialised(added.select(F.expr(f"pair div {size}").cast("int").alias("before"), (F.col("pair") % size).cast("int").alias("token"), "n"), "pairs")


def rows_by(pairs: DataFrame, own: str, other: str) -> DataFrame:
    """``pairs`` as rows of packed arrays (seed, ids, cuts, others, n): the ``other`` sides of some ``own`` sides, each of which lies whole in one row.

    An ``own`` side has the vocabulary's size of pairs at most.
    """

    def run(batches):
        held, waiting, made, task = [], 0, 0, TaskContext.get().partitionId()

        def out(last: bool):
            nonlocal held, waiting, made
            mine, others, n = (np.concatenate(c) for c in zip(*held, strict=True))
            end = len(mine) if last else int(np.searchsorted(mine, mine[-1]))  # the last one may go on
            held, waiting = [(mine[end:], others[end:], n[end:])], len(mine) - end
            if end:
                ids, first = np.unique(mine[:end], return_index=True)
                made += 1
                packed = (ids.astype("<i4"), np.append(first, end).astype("<i8"), others[:end].astype("<i4"), n[:end].astype("<i8"))
                yield pa.RecordBatch.from_arrays([pa.array([(task << 32) + made]), *(pa.array([x.tobytes()], pa.binary()) for x in packed)], names=["seed", "ids", "cuts", "others", "n"])

        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            waiting += batch.num_rows
            if waiting >= ROW_PAIRS:
                yield from out(False)
        if waiting:
            yield from out(True)

    dealt = pairs.select(own, other, "n").repartition(own).sortWithinPartitions(own, other)
    return materialised(dealt.mapInArrow(tidy(run), "seed long, ids binary, cuts binary, others binary, n binary"), f"by-{own}")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def climb(x: np.ndarray, given: np.ndarray, offset: np.ndarray, up: np.ndarray, down: np.ndarray, steps: int = STEPS, pull: float = PULL) -> np.ndarray:
    """The vector that ``steps`` Newton steps from ``x`` on reach in sum(up * log s + down * log(1 - s)) - pull / 2 * |x|^2, s the sigmoid of ``given @ x + offset``.

    The objective is concave; a step that doesn't climb is halved.
    """

    def value(x):
        z = given @ x + offset
        return float(up @ -np.logaddexp(0, -z) + down @ -np.logaddexp(0, z)) - pull / 2 * float(x @ x)

    best = None
    for _ in range(steps):
        s = _sigmoid(given @ x + offset)
        slope = given.T @ (up * (1 - s) - down * s) - pull * x
        bend = (given * ((up + down) * s * (1 - s))[:, None]).T @ given + pull * np.eye(len(x), dtype=x.dtype)
        step = np.linalg.solve(bend, slope)
        best = value(x) if best is None else best
        for _ in range(4):
            new = value(x + step)
            if new >= best:
                x, best = x + step, new
                break
            step = step / 2
    return x


def fit_sampled(by_context: DataFrame, by_target: DataFrame, unigram: np.ndarray, contexts: np.ndarray, dimensions: int = DIMENSIONS, noise: int = NOISE, rounds: int = ROUNDS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Context vectors with a 1 behind, and target vectors with the bias behind, of the model of ``rows_by``' two tables.

    The noise is ``unigram``, ``noise`` draws for each token: ``SHARING`` vectors share ``DRAWS`` draws, which
    count for so many and are drawn one from each of as many equal parts of the distribution. For a target the draws are of contexts, by how often each was seen (``contexts``), since
    noise of this target comes beside each context in that proportion. Start and pull are the unigram itself.
    """
    spark, size = by_context.sparkSession, len(unigram)
    rng = np.random.default_rng(seed)
    context = (rng.normal(size=(size, dimensions + 1)) * 0.1).astype(np.float32)
    context[:, -1] = 1
    target = np.zeros((size, dimensions + 1), np.float32)
    base = np.log(unigram).astype(np.float32)
    total = float(contexts.sum())
    reach = {"context": np.cumsum(unigram), "target": np.cumsum(contexts + 1e-12)}
    for turn in range(rounds):
        for side, rows in (("target", by_target), ("context", by_context)):
            shared = spark.sparkContext.broadcast((context, target, base, reach[side]))

            def run(batches, shared=shared, side=side, turn=turn):
                context, target, base, reach = shared.value
                for batch in batches:
                    for key, ids, cuts, others, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        ids, cuts, others, n = np.frombuffer(ids, "<i4"), np.frombuffer(cuts, "<i8").tolist(), np.frombuffer(others, "<i4"), np.frombuffer(n, "<i8").astype(np.float32)
                        rng = np.random.default_rng((seed, turn, key))
                        seen_zero, drawn_zero = np.zeros(len(others), np.float32), np.zeros(DRAWS, np.float32)
                        out = []
                        for j, (i, a, b) in enumerate(zip(ids.tolist(), cuts, cuts[1:], strict=False)):
                            if j % SHARING == 0:
                                drawn = np.minimum(np.searchsorted(reach, (np.arange(DRAWS) + rng.random(DRAWS)) / DRAWS * reach[-1]), len(base) - 1)
                            at = np.concatenate((others[a:b], drawn))
                            up = np.concatenate((n[a:b], drawn_zero))
                            down = np.concatenate((seen_zero[a:b], drawn_zero))
                            if side == "context":  # the target's bias without its unigram's logarithm is the offset
                                down[b - a :] = noise / DRAWS * n[a:b].sum()
                                given, offset = target[at, :-1], target[at, -1] - np.float32(np.log(noise))
                                out.append(climb(context[i, :-1], given, offset, up, down))
                            else:
                                down[b - a :] = noise / DRAWS * total * np.exp(base[i])
                                out.append(climb(target[i], context[at], np.float32(-np.log(noise)), up, down))
                        yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([np.array(out, "<f4").tobytes()], pa.binary())], names=["ids", "vectors"])

            found = rows.mapInArrow(tidy(run), "ids binary, vectors binary").toArrow().to_pylist()
            context, target = context.copy(), target.copy()
            for r in found:
                ids, vectors = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["vectors"], "<f4")
                into = context[:, :-1] if side == "context" else target
                into[ids] = vectors.reshape(len(ids), -1)
            shared.unpersist()
    target[:, -1] += base
    return context, target


def log_sums(context: np.ndarray, target: np.ndarray, rows: int = 256) -> np.ndarray:
    """ln of the sum of exp over all targets for each context, by blocks of both."""
    out = np.empty(len(context))
    for k in range(0, len(context), rows):
        top, total = np.full(len(context[k : k + rows]), -np.inf), np.zeros(len(context[k : k + rows]))
        for j in range(0, len(target), BLOCK):
            s = context[k : k + rows] @ target[j : j + BLOCK].T
            new = np.maximum(top, s.max(1))
            s -= new.astype(np.float32)[:, None]
            total = total * np.exp(top - new) + np.exp(s, out=s).sum(1, dtype=float) * np.exp(new.astype(np.float32) - new)
            top = new
        out[k : k + rows] = top + np.log(total)
    return out


def normalisers(spark, context: np.ndarray, target: np.ndarray, rows: int = 512) -> np.ndarray:
    """``log_sums`` of all contexts, ``rows`` of them to a row of Spark."""
    shared = spark.sparkContext.broadcast((context, target))

    def run(batches):
        context, target = shared.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"id": pa.array([k]), "sums": pa.array([log_sums(context[k * rows : (k + 1) * rows], target).tobytes()])})

    blocks = -(-len(context) // rows)
    found = spark.range(0, blocks, 1, min(blocks, BATCH_ROWS)).mapInArrow(tidy(run), "id long, sums binary").toArrow().to_pylist()
    shared.unpersist()
    return np.concatenate([np.frombuffer(r["sums"]) for r in sorted(found, key=lambda r: r["id"])])


@dataclass
class Model:
    table: Table
    context: np.ndarray  # with a last place of 1
    target: np.ndarray  # with the bias in the last place
    log_sums: np.ndarray
    tokens: int  # N
    types: int  # V
    other_tokens: int
    other_types: int

    def log_pairs(self, before: np.ndarray, after: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """log10 P(after | before) of numbers."""
        out = np.empty(len(before))
        for k in range(0, len(before), step):
            c = before[k : k + step]
            out[k : k + step] = np.einsum("ij,ij->i", self.context[c], self.target[after[k : k + step]]) - self.log_sums[c]
        return out / np.log(10)


PART = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("log_counts", pa.float64()), ("n_other", pa.int64()), ("log_other", pa.float64()), ("log_model", pa.float64()), ("words", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))])


def _prepared(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (remainder(F.col("doc_id").cast("long"), 7) == 2).alias("held_out"))


def train(docs: DataFrame, breadth: float = BREADTH, at_hand: int = AT_HAND) -> tuple[Model, DataFrame]:
    """The model of ``docs(doc_id, text)`` whose crc32(doc_id) mod 7 isn't 2, and the counts (word, n) of those tokens that its table doesn't hold."""
    spark = docs.sparkSession
    training = _prepared(docs).where("not held_out").select("text")
    counts = materialised(count_tokens(training), "token-counts")
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    vocabulary = int(np.ceil(breadth * np.sqrt(tokens)))
    frequent = most_frequent(counts, vocabulary + 1 + at_hand)
    near = [(r["word"], r["n"]) for r in counts.where(frequent).collect()]
    table = Table.of(near, vocabulary)
    in_vocabulary = table.numbers != Table.OTHER
    other_tokens, other_types = int(tokens - table.counts[in_vocabulary].sum()), int(types - in_vocabulary.sum())
    unigram = np.ones(table.size)
    unigram[table.numbers[in_vocabulary]] += table.counts[in_vocabulary]
    unigram[Table.OTHER] += other_tokens
    pairs = count_pairs(training, table)
    by_context, by_target = rows_by(pairs, "before", "token"), rows_by(pairs, "token", "before")
    discard(pairs)
    context, target = fit_sampled(by_context, by_target, unigram / unigram.sum(), unigram - 1)
    discard(by_context, by_target)
    model = Model(table, context, target, normalisers(spark, context, target), tokens, types, other_tokens, other_types)
    return model, counts.where(~frequent)


def score_documents(docs: DataFrame, breadth: float = BREADTH, at_hand: int = AT_HAND) -> DataFrame:
    """A row for each document of ``docs(doc_id, text)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose crc32(doc_id) mod 7 is 2 are held out of all that is learnt. A null or empty text is
    its end alone. ``base_score`` sums log10((c + 1) / (N + V + 1)); ``score`` is the model's log10
    probability of all tokens. Without training documents the base is add-one over nothing and the model
    knows the end and one class. Rows that repeat an id are scored each by itself.
    """
    return score(docs, *train(docs, breadth, at_hand))


def score(docs: DataFrame, model: Model, rest: DataFrame) -> DataFrame:
    """``score_documents`` by a model that ``train`` has made, and the counts that came with it."""
    texts, tokens, types = _prepared(docs), model.tokens, model.types
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        held, task, made = shared.value, TaskContext.get().partitionId(), 0
        stop = int(held.table.counts[held.table.numbers == Table.STOP].sum())
        for batch in slices(batches, SLICE):
            words = Words(batch.column(1), lower=True)
            count, number = held.table.look(words.vocab_hashes())
            before, after, starts = sequence(words, number)
            c = count[words.codes]
            logs = np.log10(c + 1.0)
            other = number[words.codes] == Table.OTHER
            far = c == 0
            rows, size = words.rows, max(len(words.vocab), 1)
            pairs, times = np.unique(rows[far] * size + words.codes[far], return_counts=True)
            cut = pa.array(np.searchsorted(pairs // size, np.arange(len(words) + 1)).astype(np.int32))
            spelt = words.vocab.take(pa.array(pairs % size)).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((task << 40) + made + np.arange(len(words))),
                    batch.column(0),
                    batch.column(2),
                    pa.array(words.counts + 1),
                    pa.array(ts.sums((~far).astype(np.int64), words.starts) + (stop > 0)),
                    pa.array(ts.sums(logs, words.starts) + np.log10(stop + 1.0)),
                    pa.array(ts.sums(other.astype(np.int64), words.starts)),
                    pa.array(ts.sums(np.where(other, logs, 0.0), words.starts)),
                    pa.array(ts.sums(held.log_pairs(before, after), starts)),
                    pa.ListArray.from_arrays(cut, spelt),
                    pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int64))),
                ],
                schema=PART,
            )
            made += len(words)

    kinds = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, n_other long, log_other double, log_model double, words array<string>, times array<long>"
    parts = materialised(texts.mapInArrow(tidy(run), kinds), "scored")
    # Words whose counts weren't at hand: looked up by a join, and added to their documents.
    far = parts.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    found = far.join(rest, "word").groupBy("row").agg(F.sum("times").alias("far_known"), F.sum(F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("far_logs"))
    whole = parts.drop("words", "times").join(found, "row", "left").na.fill(0, ["far_known", "far_logs"])
    base = F.col("log_counts") + F.col("far_logs") - F.col("n_tokens") * F.lit(float(np.log10(tokens + types + 1)))
    score = F.col("log_model") + F.col("log_other") + F.col("far_logs") - F.col("n_other") * F.lit(float(np.log10(model.other_tokens + model.other_types + 1)))
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("far_known")).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))
