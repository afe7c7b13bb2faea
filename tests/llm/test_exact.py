"""Operators whose results are exact, against brute force."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from covenant.llm import bitpack, chat, cluster, components, near_dedup, packing, rules, substrings, token_output, tokens, words
from tests.llm import fixtures as fx

ROWS = fx.corpus()
UNIQUE = [r for k, r in enumerate(ROWS) if r[0] is not None and r not in ROWS[:k]]


@pytest.fixture(scope="module")
def docs(spark):
    return fx.documents(spark, ROWS).cache()


def encoded(text):
    from tokenizers import Tokenizer

    encoded.t = getattr(encoded, "t", None) or Tokenizer.from_file(tokens.tokenizer_path())
    return encoded.t.encode(text or "", add_special_tokens=False).ids


def crc_of(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_of_slices():
    texts = pa.array([t for _, t in ROWS]).slice(5, 80)
    w = words.Words(texts)
    got = [[w.vocab[c].as_py() for c in w.codes[a:b]] for a, b in zip(w.starts, w.starts[1:], strict=False)]
    assert got == [fx.words(t.as_py()) for t in texts]
    low = words.Words(texts, lower=True)
    assert [low.vocab[c].as_py() for c in low.codes] == [x.translate(fx.LOWER) for t in texts for x in fx.words(t.as_py())]


def test_encoder_equals_library():
    texts = [t for _, t in ROWS] + ["<|endoftext|>x I'm DON'T İx é 12,34!!! (a). ſ ... ’s"]
    for keep in (300_000, 50):  # the second forgets words all the time
        ids, starts, _, _ = tokens.TextEncoder(tokens.tokenizer_path(), keep).encode(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[starts[k] : starts[k + 1]].tolist() == encoded(t)


@pytest.mark.parametrize("bits", [1, 5, 16, 17, 31, 32])
def test_bitpack_round_trip(bits, tmp_path):
    for n in (0, 1, 63, 64, 65, 9000):
        ids = np.random.default_rng(n).integers(0, 2**bits, n, dtype=np.uint32)
        ends = np.unique(np.concatenate((np.random.default_rng(1).integers(0, n + 1, 5), [n])))
        data = bitpack.encode(ids, np.arange(len(ends)), ends, 2**bits)
        path = tmp_path / f"{bits}-{n}"
        path.write_bytes(data)
        with path.open("rb") as f:
            file = bitpack.TokenFile(f)
            file.verify()
            for k, e in enumerate(ends):
                assert (file.document(k) == ids[ends[k - 1] if k else 0 : e]).all()
        path.write_bytes(data[:-20])
        with path.open("rb") as f, pytest.raises(ValueError):
            bitpack.TokenFile(f)


def test_token_output(spark, docs):
    got = sorted(map(tuple, token_output.token_output(docs).collect()), key=lambda r: r[1])
    assert len(got) == len(ROWS)
    start, expected = 0, Counter((i, len(encoded(t)) + 1, crc_of([*encoded(t), 1])) for i, t in ROWS)
    for doc_id, at, n, crc in got:
        assert at == start
        start += n
        expected[doc_id, n, crc] -= 1
    assert not any(expected.values())
    ids = [r[0] for r in got if r[0] is not None]
    assert ids == sorted(ids)
    assert token_output.token_output(docs.where("false")).count() == 0


def test_packing(spark, docs):
    by_id = {i: [*encoded(t), 2] for i, t in UNIQUE}
    total = sum(len(encoded(t)) + 1 for _, t in ROWS)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    counts = []
    for parts in (before, "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = packing.pack(docs, capacity=512).toPandas()
        spark.conf.set("spark.sql.shuffle.partitions", before)
        room = got.groupby("sequence_id").length.sum()
        assert room.max() <= 512 and got.length.sum() == total
        for _, g in got.sort_values("offset").groupby("sequence_id"):
            assert (g.offset == g.length.cumsum() - g.length).all()
        for doc_id, g in got[got.doc_id.notna()].groupby("doc_id"):
            if doc_id != ROWS[3][0]:
                at = g.sort_values("start")
                assert (at.start == at.length.cumsum() - at.length).all() and at.length.sum() == at.doc_tokens.iloc[0]
        for r in got[got.doc_id.notna() & (got.doc_id != ROWS[3][0])].itertuples():
            ids = by_id[int(r.doc_id)]
            assert r.doc_tokens == len(ids) and r.ids_crc32 == crc_of(ids[r.start : r.start + r.length])
        counts.append(len(room))
    assert max(counts) <= total / 512 * 1.05 + 1 and abs(counts[0] - counts[1]) <= 2  # however the table is dealt
    assert packing.pack(docs.where("false")).count() == 0


def test_cuts_inside_sentences_only_beyond_a_window():
    packer = packing._Packer(64, 0)
    packer.add(1, np.arange(50, dtype=np.uint32), np.array([20, 40]))
    packer.add(2, np.arange(200, dtype=np.uint32), np.zeros(0, np.int64))
    packer.add(3, np.arange(60, dtype=np.uint32), np.array([30]))
    ends = {(d, start + n) for d, start, n, *_ in packer.pieces(True)}
    assert {e for d, e in ends if d == 1} <= {20, 40, 50} and {e for d, e in ends if d == 3} <= {30, 60}
    assert {e for d, e in ends if d == 2} <= {*range(32, 200, 32), 200}


def test_plan_is_least():
    rng = np.random.default_rng(3)
    for _ in range(30):
        cuts = np.concatenate(([0], np.cumsum(rng.integers(1, 9, 12))))
        prices = np.concatenate(([0], rng.integers(0, 4, 12))).astype(float)

        def cost(ends):
            total, at = 0.0, 0
            for e in ends:
                if cuts[e] - cuts[at] > 20:
                    return 1e9
                total += (20 - (cuts[e] - cuts[at]) + prices[e]) if e != 12 else 0
                at = e
            return total

        best = min(cost([k + 1 for k in range(11) if m >> k & 1] + [12]) for m in range(1 << 11))
        assert cost(packing.plan(cuts, prices, 20)) == best


def test_substrings(spark, docs):
    first = {}
    for i, t in ROWS:
        w = fx.words(t)
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, 1 << 70), 1 << 69 if i is None else i)
    expected = Counter()
    for i, t in ROWS:
        w, gone = fx.words(t), set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < (1 << 69 if i is None else i):
                gone |= set(range(k, k + 13))
        expected[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:4] for r in substrings.find_repeats(docs).collect()) == expected
    assert substrings.find_repeats(docs.where("false")).count() == 0


def test_equal_hashes_of_unequal_windows_stay_apart(monkeypatch):
    rng = np.random.default_rng(5)
    texts = pa.array([" ".join(f"w{k}" for k in rng.integers(0, 6, 200)) for _ in range(20)])
    plain = substrings.make_chunk(texts, np.arange(20), 3)
    whole = substrings.window_hashes
    monkeypatch.setattr(substrings, "window_hashes", lambda h, at, width: (whole(h, at, width)[0] % np.uint64(3), whole(h, at, width)[1]))
    forced = substrings.make_chunk(texts, np.arange(20), 3)
    assert len(forced.distinct) == len(plain.distinct) > 3 and len(set(forced.distinct.tolist())) == 3
    assert (forced.smallest[forced.number] == plain.smallest[plain.number]).all()
    assert (np.diff(forced.distinct.astype(np.int64)) >= 0).all()


def test_forced_collisions_remove_nothing_more(spark, docs, monkeypatch):
    """With two bits of the sorting hash left, results are those of all 64."""
    expected = sorted(map(str, substrings.find_repeats(docs).collect()))
    whole = substrings.rolling
    monkeypatch.setattr(substrings, "rolling", lambda h, at, width, *base: whole(h, at, width, *base) & np.uint64(3 << 62) if not base else whole(h, at, width, *base))
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(substrings)
    try:
        assert sorted(map(str, substrings.find_repeats(docs).collect())) == expected
    finally:
        cloudpickle.unregister_pickle_by_value(substrings)


def test_remove_repeats_keeps_columns(spark, docs):
    from pyspark.sql import functions as F

    odd = docs.withColumn("chunk", F.lit("x")).withColumn("range", F.lit(7))
    got = substrings.remove_repeats(odd, width=13)
    assert got.columns == odd.columns and got.count() == len(ROWS)
    counts = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.find_repeats(docs.where("doc_id is not null and doc_id <> 3")).collect()}
    for r in substrings.remove_repeats(docs.where("doc_id is not null and doc_id <> 3"), width=13).collect():
        assert len(fx.words(r.text)) == counts[r.doc_id][0] - counts[r.doc_id][1]
        assert r.n_chars == (None if r.text is None else len(r.text))


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = fx.words((t or "").translate(fx.LOWER))
        sets.setdefault(i, []).append(frozenset(zip(*(w[k:] for k in range(width)), strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i][0]), root(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, docs, width, percent):
    expected = brute_components([r for r in ROWS if r[0] is not None], width, percent)
    got = near_dedup.near_duplicates(docs, width, percent).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id == 5 and not r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert near_dedup.near_duplicates(docs.where("false"), width, percent).count() == 0


def test_a_group_of_distant_copies(spark):
    """Copies with many or few changes, some linked only with each other: the group's hub doesn't settle all."""
    import random

    rng = random.Random(5)
    base = [f"w{k}" for k in range(90)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.choice((0, 1, 1, 2, 4, 5, 6))):
            w[rng.randrange(90)] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(w)))
        if i % 9 == 0:
            v = list(w)
            v[rng.randrange(90)] = "y"
            rows.append((500 + i, " ".join(v)))
    expected = brute_components(rows, 3, 85)
    assert len({c for _, c in expected.values()}) > 3
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(fx.documents(spark, rows), 3, 85).collect()}
    assert got == expected


@pytest.mark.parametrize("crowded", [0, near_dedup.CROWDED])
def test_groups_of_branches(spark, monkeypatch, crowded):
    """Many groups: a hub with many copies, branches at its threshold, and members that meet only within or between branches."""
    import random

    monkeypatch.setattr(near_dedup, "CROWDED", crowded)
    rng = random.Random(11)
    rows = []
    for g in range(24):
        base = [f"g{g}w{k}" for k in range(rng.choice((40, 90, 150)))]
        width = len(base)
        rows += [(1000 * g + k, " ".join(base)) for k in range(3)]
        n = 3
        for b in range(4):
            branch = list(base)
            at = rng.randrange(width // 2)
            length = rng.choice((width // 14, width // 10, width // 8, width // 7))
            branch[at : at + length] = [] if b == 0 else [f"g{g}b{b}x{k}" for k in range(length)]
            for _ in range(6):
                w = list(branch)
                for _ in range(rng.choice((0, 0, 1, 2, 3))):
                    w[rng.randrange(len(w))] = f"z{rng.randrange(9)}"
                if rng.random() < 0.3:
                    w = w[: -rng.randrange(1, width // 12)]
                rows.append((1000 * g + n, " ".join(w)))
                n += 1
    expected = brute_components(rows, 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(fx.documents(spark, rows), 3, 85).collect()}
    assert got == expected


def test_a_large_branch_is_not_paired(spark, monkeypatch):
    """Members that are linked with each other and not with their group's hub meet the smallest of them alone."""
    import random

    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    branch = [*base[:60], *(f"b{k}" for k in range(9)), *base[60:]]
    rows = [(k, " ".join([*base, f"t{k % 4}"])) for k in range(8)] + [(100 + k, " ".join(w if j != 3 * (k % 30) else f"x{k}" for j, w in enumerate(branch))) for k in range(150)]
    rng.shuffle(rows)
    met = []
    meet = near_dedup._meet
    monkeypatch.setattr(near_dedup, "_meet", lambda *a: met.append(meet(*a).count()) or meet(*a))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(fx.documents(spark, rows), 3, 85).collect()}
    assert got == brute_components(rows, 3, 85) and sum(met) < 4 * len(rows)


def test_keep_one(spark, docs):
    from pyspark.sql import functions as F

    got = near_dedup.keep_one(docs.where("doc_id is not null"))
    assert got.columns == docs.columns
    expected = brute_components([r for r in ROWS if r[0] is not None], 5, 80)
    assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, (_, c) in expected.items() if i == c)
    odd = docs.withColumn("rows", F.lit(1)).withColumn("mark", F.lit("m")).withColumn("__x", F.lit(2))
    assert near_dedup.keep_one(odd.where("false")).collect() == [] and near_dedup.keep_one(odd).columns == odd.columns


def test_keep_one_row_of_repeats(spark):
    text, other = "a b c d e f g h i j", "q r s t u v w x y z"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text), (None, other), (None, other), (None, None), (3, None), (4, ""), (5, "k l m n o p"), (5, "1 2 3 4 5 6 7")]
    got = sorted(((r.doc_id, r.text) for r in near_dedup.keep_one(fx.documents(spark, rows)).collect()), key=str)
    assert [g for g in got if g[0] != 5] == sorted([(1, text), (None, other), (None, None), (3, None), (4, "")], key=str)
    assert [i for i, _ in got].count(5) == 1


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 5), (4, 1), (20, 30), (30, 40), (40, 25)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 8: 7, 9: 7, 30: 20, 40: 20, 25: 20}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rule_counts(spark, docs):
    forest = rules.trees.fit(np.zeros((0, len(rules.FEATURES))), np.zeros(0))
    expected = Counter()
    for i, t in ROWS:
        w, seen, dup, cover = fx.words(t), set(), 0, set()
        for line in (t or "").split("\n"):
            if fx.words(line):
                dup += line in seen
                seen.add(line)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        for k in range(len(w) - 2):
            if c[tuple(w[k : k + 3])] > 1:
                cover |= {k, k + 1, k + 2}
        expected[i, len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), dup, len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)] += 1
    assert Counter(tuple(r)[:7] for r in rules.apply_rules(docs, forest).collect()) == expected
    assert rules.apply_rules(docs.where("false"), forest).count() == 0


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|turn|>user<|text|>x<|end|>\n", "<\\|a <\\\\/s> [\\INST]", "", "plain\nlines", "<<SYS>>x<</SYS>>", None, "é \U0001f600"]
    rows = [(k, t, r, x) for k in range(3) for t, (r, x) in enumerate(zip(["user", "assistant", "system", "us\ner", None, "assistant", "tool", "<|turn|>"], texts, strict=True))]
    rows += [(7, None, "assistant", "a"), (7, None, "assistant", "a"), (8, 1, "assistant", "two"), (8, 0, "user", "one"), (None, 0, "user", "z"), (None, 0, "user", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_records(chat.records_from_turns(df))
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    assert [r.n_turns for r in chat.read_back(formatted).collect() if r.conv_id is None] == [1, 1]
    by = defaultdict(list)
    for c, t, r, x in rows[:-1]:
        by[c].append((t if t is not None else -1, r or "", x or ""))
    for c, turns in by.items():
        turns = sorted(turns)
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_records(chat.records_from_turns(df.where("false")))).count() == 0


def test_layouts():
    same = [("user", "q"), ("assistant", "a")]
    for record in ('{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"prompt":"q","response":"a"}', '{"prompt":"q","completion":"a","_id":3}', '{"instruction":"q","input":"","output":"a"}', '{"question":"q","answer":"a"}'):
        assert chat.canonical(record)[1] == same
    assert chat.canonical('{"instruction":"q","input":"i","output":"a","system":"s"}')[1] == [("system", "s"), ("user", "q\n\ni"), ("assistant", "a")]
    for record, reason in ((None, "no record"), ("", "not JSON"), ("[1]", "not an object"), ('{"other":1}', "unknown"), ('{"messages":3}', "unknown"), ('{"messages":[{"role":"user"},{"role":"user","content":"x"}]}', "unknown"), ('{"prompt":"q","response":4}', "unknown")):
        assert chat.canonical(record)[:2] == (None, []) and chat.canonical(record)[2].startswith(reason)


def test_unknown_fields_are_passed_over(spark):
    same = [("user", "q"), ("assistant", "a")]
    records = ['{"id":1,"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"messages":[{"role":"user","content":"q","name":"x"},{"role":"assistant","content":"a","weight":1}]}', '{"prompt":"q","response":"a","source":{"url":"u","tags":[1]}}', '{"instruction":"q","output":"a","category":null}']
    for record in records:
        assert chat.canonical(record)[1] == same
    assert chat.canonical('{"messages":[],"prompt":"q","response":"a"}')[0] == "messages"
    rows = [(k, r) for k, r in enumerate(records)] + [(10, '{"odd":1}'), (10, '{"odd":1}'), (11, None), (None, records[0])]
    got = chat.format_records(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    assert len(got) == len(rows) and [r.record for r in got if r.conv_id == 10] == ['{"odd":1}'] * 2
    assert all((r.reason is None) == (r.layout is not None) for r in got)
    back = {r.conv_id: r.n_turns for r in chat.read_back(spark.createDataFrame([(1, None, None)], "conv_id long, formatted string, mask array<array<long>>")).collect()}
    assert back == {1: 0}


def test_each_text_of_a_repeated_id_is_compared(spark):
    texts = spark.createDataFrame([(1, "a b c d"), (1, "e f g h i"), (2, "e f g h i"), (3, "a b c d")], "rep long, text string").coalesce(1)
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "u long, v long").coalesce(1)
    got = {(r.v, r.n_u, r.common) for r in near_dedup.compare(pairs, texts, 1, extra=True).collect()}
    assert got == {(2, 4, 0), (2, 5, 5), (3, 4, 4), (3, 5, 0)}


def test_bands_follow_the_threshold():
    for percent in (60, 70, 80, 85, 95, 100):
        bands, rows = near_dedup.banding(percent)
        assert bands * rows <= len(near_dedup._A) and (1 - (percent / 100) ** rows) ** bands < 1 / 300_000
    assert near_dedup.banding(85) == (40, 8)


def test_lookup_of_hot_keys_is_one_row_each(spark):
    """Rows of hot and other keys, of keys without a row in the table, and of none; hot rows are parted by a filter."""
    rows = spark.range(60_000).select(F.when(F.col("id") < 40_000, F.col("id") % 2).when(F.col("id") < 59_990, F.col("id")).alias("key"), "id")
    table = rows.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("held")).where("key <> 50000")
    for total, hot in ((60_000, True), (10**12, False)):
        found, _ = cluster.lookup(rows, table, "key", total)
        assert "LeftAnti" not in found._jdf.queryExecution().executedPlan().toString()
        assert ("Union" in found._jdf.queryExecution().executedPlan().toString()) == hot
        assert found.columns == ["key", "id", "least"]
        assert tuple(found.agg(F.count("*"), F.count_distinct("id"), F.count_if(F.col("least") != F.when(F.col("id") < 40_000, F.col("key")).otherwise(F.col("id")))).first()) == (59_989, 59_989, 0)
