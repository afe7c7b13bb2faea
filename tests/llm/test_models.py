"""Operators that learn or search: held-out accuracy, invariants, and brute force where there is one."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from covenant.llm import decontaminate, language_model, line_crf, rules, toxicity, trees
from tests.llm import fixtures as fx

ROWS = fx.corpus()


def labelled(spark, n=420, seed=2):
    """Good and junk texts, a tenth of them with insults."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = "\n".join(fx.sentence(rng, rng.randint(8, 20)) for _ in range(rng.randint(2, 6)))
        quality, toxic = int(rng.random() < 0.7), int(rng.random() < 0.25)
        if not quality:
            text = "\n".join(" ".join(w + rng.choice(("###", "$$$")) for w in line.split()) for line in text.split("\n"))
        if toxic:
            w = text.split(" ")
            for _ in range(4):
                w.insert(rng.randrange(len(w)), rng.choice(("zorgling", "idiot", "you moron", "grubnard")))
            text = " ".join(w)
        rows.append((i, text))
        labels.append((i, quality, toxic))
    labels += [(None, 1, 0), (0, labels[0][1], labels[0][2]), (5000, 1, 1), (3, None, None)]
    return fx.documents(spark, rows + [(None, "x"), (n + 1, None), (n + 2, "")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, {x[0]: x for x in labels}


@pytest.mark.parametrize(("module", "label", "at"), [(line_crf, "quality", 1), (toxicity, "toxic", 2)])
def test_classifiers(spark, module, label, at):
    docs, labels, rows, known = labelled(spark)
    got = module.score(docs, module.fit(docs, labels)).collect()
    assert len(got) == len(rows) + 3
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.5 if at == 1 else 0.7)) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < len(rows)]
    assert all(r.held_out == (fx.crc(r.doc_id, 3) == 1) for r in got if r.doc_id is not None)
    assert np.mean([r.predicted == known[r.doc_id][at] for r in held]) > 0.9
    assert module.score(docs.where("false"), module.fit(docs, labels.where("false"))).count() == 0
    constant = module.score(docs, module.fit(docs, labels.where("false"))).collect()
    assert len({round(r.score, 6) for r in constant}) <= 4


def test_toxic_rows_go(spark):
    docs, labels, rows, known = labelled(spark)
    kept = toxicity.keep_clean(docs, toxicity.fit(docs, labels))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    clean = [i for i, _ in rows if not known[i][2]]
    assert len(ids & set(clean)) > 0.97 * len(clean) and None in ids


def test_quality_rules(spark):
    docs, labels, rows, known = labelled(spark)
    got = {r.doc_id: r for r in rules.apply_rules(docs, rules.fit(docs, labels)).collect()}
    sure = [i for i, _ in rows if fx.crc(i, 3) == 1 and not got[i].base_failed]
    assert np.mean([got[i].kept == bool(known[i][1]) for i in sure]) > 0.95
    assert all(not r.kept for r in got.values() if r.base_failed)


def test_trees_keep_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 0] - x[:, 1] + 0.5 * x[:, 2] ** 2 + rng.normal(size=3000) * 0.3 > 0.3).astype(float)
    forest = trees.fit(x, y, np.array([1, -1, 0, 0]))
    assert ((forest.predict(x) > 0.5) == y).mean() > 0.85
    for j, sign in ((0, 1), (1, -1)):
        for row in rng.normal(size=(20, 4)):
            line = np.repeat(row[None], 60, 0)
            line[:, j] = np.linspace(-3, 3, 60)
            assert (np.diff(forest.margin(line)) * sign >= -1e-12).all()


def test_isotonic():
    at, p = trees.isotonic(np.array([1, 2, 3, 4, 4, 5.0]), np.array([0, 1, 0, 1, 0, 1.0]))
    assert (np.diff(p) >= 0).all() and np.interp(1, at, p) == 0 and np.interp(5, at, p) == 1


def test_forward_backward_is_exact():
    from itertools import product

    rng = np.random.default_rng(1)
    pair = np.exp(rng.normal(size=(2, 2)))
    counts = [1, 4, 3]
    ratio = np.exp(rng.normal(size=sum(counts)))
    starts = np.concatenate(([0], np.cumsum(counts)))
    got, pairs = line_crf.forward_backward(ratio, starts, pair)
    expected, both = [], np.zeros((2, 2))
    for a, b in zip(starts, starts[1:], strict=False):
        weight = {}
        for y in product((0, 1), repeat=b - a):
            weight[y] = np.prod([ratio[a + k] if v else 1 for k, v in enumerate(y)]) * np.prod([pair[u, v] for u, v in zip(y, y[1:], strict=False)])
        total = sum(weight.values())
        expected += [sum(w for y, w in weight.items() if y[k]) / total for k in range(b - a)]
        for y, w in weight.items():
            for u, v in zip(y, y[1:], strict=False):
                both[u, v] += w / total
    assert np.allclose(got, expected) and np.allclose(pairs, both)


def test_long_documents_are_scored_by_blocks(monkeypatch):
    rng = random.Random(8)
    texts = ["\n".join(rng.choice(("", "one two three", "##### $$$ !!", "A LOUD LINE!", fx.sentence(rng, 9))) for _ in range(n)) for n in (1, 2, 3, 700, 5000)] + ["\n\n", "", None, "x" * 3000 + "\nshort"]
    model = line_crf.Model(np.random.default_rng(2).normal(size=line_crf.N_FEATURES), np.array([[0.7, -0.4], [-0.2, 0.5]]), 1.0, 0.0)
    whole = model.raw(line_crf.line_features(pa.array(texts, pa.string())))
    monkeypatch.setattr(line_crf, "BLOCK_BYTES", 64)
    assert np.allclose(whole, [model.raw_long(t or "") for t in texts], atol=1e-6)
    one = model.score(pa.array(texts, pa.string()))
    monkeypatch.setattr(line_crf, "CHAIN", 2)
    monkeypatch.setattr(line_crf, "LINES", 10)
    assert np.allclose(one, model.score(pa.array(texts, pa.string())), atol=1e-6)


def test_very_many_lines_take_little_memory():
    import resource

    model = line_crf.Model(np.zeros(line_crf.N_FEATURES), np.zeros((2, 2)), 1.0, 0.0)
    texts = pa.array(["\n" * (4 << 20)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert abs(model.score(texts)[0] - 0.5) < 1e-6
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def test_line_labels():
    got = line_crf.line_labels(np.array([0.9, 0.01, 0.9, 0.2, 0.7, 0.8]), np.array([0, 2, 4, 6]), np.array([1.0, 0.0, 0.0]))
    assert got.tolist() == [1, 0, 1, 0, 0, 1]


def test_language_model(spark):
    rows = [r for k, r in enumerate(ROWS) if r not in ROWS[:k] and r[0] is not None]
    docs = fx.documents(spark, rows)
    model, rest = language_model.train(docs, breadth=0.5, at_hand=50)
    got = {r.doc_id: r for r in language_model.score(docs, model, rest).collect()}
    tokens = {i: [*fx.words((t or "").translate(fx.LOWER)), ""] for i, t in rows}
    c = Counter()
    for i, w in tokens.items():
        if fx.crc(i, 7) != 2:
            c.update(w)
    total, types = sum(c.values()), len(c)
    number = dict(zip(c, model.table.look(np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in c], np.uint64))[1].tolist(), strict=True))
    assert 0 < model.table.size - 2 <= math.ceil(0.5 * math.sqrt(total)) and number[""] == model.table.STOP
    raw = np.exp(model.context.astype(float) @ model.target.astype(float).T)
    chance = raw / raw.sum(1, keepdims=True)
    others = [w for w in c if number[w] == model.table.OTHER]
    assert (model.other_types, model.other_tokens) == (len(others), sum(c[w] for w in others)) and rest.count() > 0
    for i, w in tokens.items():
        r = got[i]
        base = sum(math.log10((c[x] + 1) / (total + types + 1)) for x in w)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(c[x] > 0 for x in w), total, fx.crc(i, 7) == 2)
        assert abs(r.base_score - base) < 1e-6 * abs(base)
        direct, before = 0.0, model.table.STOP
        for x in w:
            now = number.get(x, model.table.OTHER)
            direct += math.log10(chance[before, now])
            if now == model.table.OTHER:
                direct += math.log10((c[x] + 1) / (model.other_tokens + model.other_types + 1))
            before = now
        assert abs(r.score - direct) < 1e-4 * abs(direct)
    assert language_model.score_documents(docs.where("false")).count() == 0
    assert language_model.score_documents(fx.documents(spark, [(2, "only held"), (None, None)])).count() == 2


def test_vocabulary_follows_the_corpus(spark):
    """Each name has one successor. Names after the 1,022 most frequent words are scored by their own predecessor too."""
    rng = random.Random(9)
    names = [f"n{k}" for k in range(1500)]
    rows = [(i, " ".join(f"{w} {w}s" for w in rng.choices(names, [4] * 600 + [1] * 900, k=150))) for i in range(1500)]
    rows = [r for r in rows if fx.crc(r[0], 7) != 2]
    ids = [i for i in range(2000, 2400) if fx.crc(i, 7) == 2]
    for i, j in zip(ids[::2], ids[1::2], strict=False):  # the same words in the right and in the wrong order
        chosen = rng.sample(names[600:], 30)
        rows += [(i, " ".join(f"{w} {w}s" for w in chosen)), (j, " ".join(f"{w} {v}s" for w, v in zip(chosen, chosen[1:] + chosen[:1], strict=True)))]
    got = {r.doc_id: r.score for r in language_model.score_documents(fx.documents(spark, rows), breadth=8).collect()}
    right = [got[i] > got[j] + 1 for i, j in zip(ids[::2], ids[1::2], strict=False)]
    assert len(right) > 20 and np.mean(right) > 0.9


def test_sampled_model_is_normalised(spark):
    rng = np.random.default_rng(3)
    context, target = (rng.normal(size=(5000, 9)).astype(np.float32) for _ in range(2))
    sums = language_model.normalisers(spark, context[:700], target)
    assert np.allclose(np.exp(context[:700] @ target.T - sums[:, None]).sum(1), 1, atol=1e-3)


def test_scoring_a_large_batch_takes_little_memory(spark, monkeypatch):
    import tracemalloc
    from unittest.mock import MagicMock

    rng = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(5000)])
    texts = [" ".join(words[rng.integers(0, 5000, 140)]) for _ in range(6000)]
    table = language_model.Table.of([("", 6000), *((w, 9) for w in words[:3000].tolist())], 400)
    vectors = rng.normal(size=(table.size, 5)).astype(np.float32)
    model = language_model.Model(table, vectors, vectors, np.zeros(table.size), 10**6, 5001, 100, 50)
    docs = MagicMock()
    docs.sparkSession.sparkContext.broadcast.return_value.value = model
    monkeypatch.setattr(language_model, "_prepared", lambda x: x)
    monkeypatch.setattr(language_model, "materialised", lambda x, name: x)
    monkeypatch.setattr(language_model, "TaskContext", MagicMock(**{"get.return_value.partitionId.return_value": 0}))
    language_model.score(docs, model, MagicMock())
    run = docs.mapInArrow.call_args[0][0]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6000)), pa.array(texts), pa.array([False] * 6000)], names=["doc_id", "text", "held_out"])
    tracemalloc.start()
    rows = sum(out.num_rows for out in run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 6000 and peak < 30e6, peak


def test_climb_finds_the_greatest_value():
    rng = np.random.default_rng(1)
    given, up, down = rng.normal(size=(200, 3)), rng.random(200) * 9, rng.random(200) * 9
    x = language_model.climb(np.zeros(3), given, np.float64(-0.5), up, down, steps=12)
    s = 1 / (1 + np.exp(-(given @ x - 0.5)))
    assert np.abs(given.T @ (up * (1 - s) - down * s) - language_model.PULL * x).max() < 1e-5


def test_pairs_are_whole(spark):
    """Every neighbour is counted, and each side's pairs lie in one row of its table."""
    rows = [r for r in ROWS if r[0] is not None]
    texts = fx.documents(spark, rows).select("text")
    table = language_model.Table.of([("", 1), *((w, 2) for w in "abcdefghij")], 5)
    pairs = language_model.count_pairs(texts, table)
    assert pairs.agg({"n": "sum"}).first()[0] == sum(len(fx.words(t)) + 1 for _, t in rows)
    every = {(r.before, r.token): r.n for r in pairs.collect()}
    for own, other in (("before", "token"), ("token", "before")):
        met, found = set(), {}
        for r in language_model.rows_by(pairs, own, other).collect():
            ids, cuts, others, n = (np.frombuffer(x, t) for x, t in ((r.ids, "<i4"), (r.cuts, "<i8"), (r.others, "<i4"), (r.n, "<i8")))
            assert not met & set(ids.tolist())
            met |= set(ids.tolist())
            for k, i in enumerate(ids.tolist()):
                found |= {((i, o) if own == "before" else (o, i)): m for o, m in zip(others[cuts[k] : cuts[k + 1]].tolist(), n[cuts[k] : cuts[k + 1]].tolist(), strict=True)}
        assert found == every


def edits_inside(pattern, text):
    """Least edits of the pattern against any part of the text."""
    row = np.zeros(len(text) + 1, int)
    for i, p in enumerate(pattern):
        new = np.empty_like(row)
        new[0] = i + 1
        for j, t in enumerate(text):
            new[j + 1] = min(row[j] + (p != t), row[j + 1] + 1, new[j] + 1)
        row = new
    return row.min()


def test_decontamination(spark):
    rng = random.Random(4)
    items = [(k, fx.sentence(rng, rng.randint(8, 16))) for k in range(12)] + [(50, None), (51, ""), (52, "too short"), (53, "Ünïcödé wörds ärë föund tóo whén théy stand " + fx.sentence(rng, 5))]
    rows = []
    for i in range(90):
        text = fx.sentence(rng, rng.randint(3, 30))
        if i % 2:
            s = list(rng.choice([t for _, t in items if t and len(t) > 30]))
            for _ in range(rng.randrange(0, 14)):
                p = rng.randrange(len(s))
                s[p : p + 1] = rng.choice(([], ["x"], [s[p], "q"]))
            text = f"{text} {''.join(s).upper() if i % 3 == 0 else ''.join(s)}\n\n{fx.sentence(rng, 4)}"
        rows.append((i, text))
    rows += [(200, None), (201, ""), (202, " ".join(["the"] * 5000)), (203, rows[1][1])]
    got = decontaminate.find_contamination(fx.documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    fold = lambda t: "".join(map(chr, decontaminate.folded(pa.array([t])).points.tolist())).rstrip("\0").strip()
    expected = set()
    for k, t in items:
        p = fold(t or "")
        if len(p) >= decontaminate.LEAST:
            budget = min(int(0.1 * len(p)), (len(p) - 8) // 8)
            expected |= {(i, k) for i, x in rows if i != 202 and edits_inside(p, fold(x or "")) <= budget}
    assert {(r.doc_id, r.item_id) for r in got} == expected and len(expected) > 20
    for r in got:
        assert r.edits <= 0.1 * len(fold(dict(items)[r.item_id])) and fold(dict(rows)[r.doc_id][r.start : r.end])
    clean = decontaminate.drop_contaminated(fx.documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in expected}


def test_copies_side_by_side_are_rows_of_their_own(spark):
    rng = random.Random(6)
    for size in (84, 90, 94, 165, 180, 340):
        item = fx.sentence(rng, size)[:size].rstrip(" .") + "z"
        edited, other = (f"{item[:k]}#{item[k + 1 :]}" if item[k] != " " else f"{item[:k]}9{item[k + 1 :]}" for k in (size // 2, size // 3))
        rows = [(1, f"{edited} {item}"), (2, f"{item} {edited}"), (3, f"{edited} {other}"), (4, f"{item} {item}"), (5, f"{edited} {item} {other}")]
        got = Counter(r[0] for r in decontaminate.search(pa.array([t for _, t in rows]), decontaminate.make_index([(1, item)])))
        assert got == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}, (size, got)


def test_short_items_are_found_exactly(spark):
    items = [(1, "Too short!"), (2, "x"), (3, "one two one"), (4, "..."), (5, "too SHORT"), (6, fx.sentence(random.Random(1), 12))]
    rows = [(1, "It is too, short."), (2, "it is too shorter, or xx"), (3, "one two one two one two one"), (4, "x"), (5, "too"), (6, "short"), (7, None), (8, "é X")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for held in (benchmark, benchmark.where("item_id < 6")):
        got = {tuple(r) for r in decontaminate.find_contamination(fx.documents(spark, rows), held).collect()}
        assert got == {(1, 1, 6, 16, 0), (1, 5, 6, 16, 0), (3, 3, 0, 11, 0), (3, 3, 16, 27, 0), (4, 2, 0, 1, 0), (8, 2, 2, 3, 0)}
        assert {r.doc_id for r in decontaminate.drop_contaminated(fx.documents(spark, rows), held).collect()} == {2, 5, 6, 7}


def test_typographic_punctuation_and_letters_of_many_bytes():
    item = "“Don’t panic” — said the guide… überall wörtlich, 東京都 строка"
    index = decontaminate.make_index([(1, item)])
    plain = "\"Don't panic\" - said the guide... überall wörtlich, 東京都 строка"
    assert [(a, b, e) for _, _, a, b, e in decontaminate.search(pa.array([f"x {plain}!"]), index)] == [(3, 2 + len(plain), 0)]
    budget = int(index.budget[0])
    changed = plain.replace("東京都", "京東府").replace("ü", "u")  # four characters, not twelve bytes
    assert budget >= 4 and [e for *_, e in decontaminate.search(pa.array([changed]), index)] == [4]
    assert decontaminate.folded(pa.array(["a\u0301 \U0001f600b\u00a0c"])).points.tolist() == [*map(ord, "a\u0301 b c"), 0]


def test_letters_that_share_a_byte_stay_apart():
    same = {}
    for c in range(0x4E00, 0x5200):
        same.setdefault(decontaminate.folded(pa.array([chr(c)])).letters[0], []).append(chr(c))
    one, other = next(x for x in same.values() if len(x) > 1)[:2]
    index = decontaminate.make_index([(1, one * 20), (2, one * 40)])
    assert decontaminate.search(pa.array([other * 20, other * 40]), index) == []
    assert [x[:2] for x in decontaminate.search(pa.array([one * 20, one * 40]), index)] == [(1, 0), (0, 1)]


def test_benchmark_in_blocks(spark):
    items = [(k, t) for k, t in enumerate(fx.sentence(random.Random(k), 12) for k in range(30))]
    df = spark.createDataFrame(items, "item_id long, text string")
    found = [i for index in decontaminate.indexes(df, block_bytes=400) for i in index.item_ids]
    assert sorted(found) == list(range(30))
    assert decontaminate.find_contamination(fx.documents(spark, ROWS), df.where("false")).count() == 0
