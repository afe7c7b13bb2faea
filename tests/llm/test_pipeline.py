"""The pipeline's stages against plain Python, on a small corpus with planted cases."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from covenant.llm import queries, toxicity
from covenant.llm.cluster import materialised
from tests.llm import fixtures as fx
from tests.llm.test_exact import brute_components, encoded
from tests.llm.test_models import edits_inside

INSULTS = ("zorgling", "idiot", "you moron", "grubnard")


def corpus():
    """(doc_id, text), labels and benchmark: prose, toxic texts, copies, a shared passage and leaked items, empties and nulls."""
    rng = random.Random(12)
    items = [(k, fx.sentence(rng, 14)) for k in range(3)]
    passage = fx.sentence(rng, 60)
    rows, labels = [], []
    for i in range(420):
        text = "\n".join(fx.sentence(rng, rng.randint(8, 20)) for _ in range(rng.randint(3, 6)))
        if i == 11:
            text = fx.sentence(rng, 110)
        toxic = i % 5 == 0
        if toxic:
            w = text.split(" ")
            for _ in range(5):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
            text = " ".join(w)
        elif i % 29 == 3:
            text = f"{text} {passage} {fx.sentence(rng, 4)}"
        elif i % 31 == 4:
            s = rng.choice(items)[1]
            text = f"{text} {s[:20]}x{s[21:]}"
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    base = rows[11][1]
    w = base.split(" ")
    w[len(w) // 2] = "changed"
    rows += [(500, base), (501, " ".join(w)), (502, base), (503, None), (504, ""), (505, " \t")]
    return rows, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, labels, items = corpus()
    path = tmp_path_factory.mktemp("sf")
    fx.documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def without_repeats(texts, width):
    """Texts without the words that a window covers which also starts in a document of smaller id."""
    first = {}
    for i, t in sorted(texts.items()):
        w = fx.words(t)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, t in texts.items():
        w, gone = fx.words(t), set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_stages(spark, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near dedup", "substring dedup", "decontamination", "packing"]
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = materialised(stage(spark, docs, folder), "test")
        if name != "packing":
            assert docs.columns == columns
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
            assert docs.count() == len(kept[name])
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{folder}/labels.parquet"))
            judged = {r.doc_id for r in toxicity.score(before, model).collect() if not r.predicted}
            assert set(kept[name]) == judged

    rows, _, items = corpus()
    toxic = {i for i, _ in rows if i < 420 and i % 5 == 0}
    clean = {i for i, _ in rows} - toxic
    assert len(clean - set(kept["toxicity"])) <= 0.01 * len(clean) and len(toxic & set(kept["toxicity"])) <= 0.1 * len(toxic)

    groups = brute_components(list(kept["toxicity"].items()), 5, 80)
    assert kept["near dedup"] == {i: t for i, t in kept["toxicity"].items() if groups[i][1] == i}
    assert 11 in kept["near dedup"] and not {500, 501, 502} & set(kept["near dedup"])

    cut = without_repeats(kept["near dedup"], 40)
    assert {i: fx.words(t) for i, t in kept["substring dedup"].items()} == cut
    assert sum(len(fx.words(kept["near dedup"][i])) - len(w) for i, w in cut.items()) > 5 * 60

    fold = lambda t: " ".join("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    leaked = {i for i, t in kept["substring dedup"].items() for _, item in items if edits_inside(fold(item), fold(t)) <= min(len(fold(item)) // 10, (len(fold(item)) - 8) // 8)}
    assert set(kept["decontamination"]) == set(kept["substring dedup"]) - leaked and len(leaked) > 5

    pieces = defaultdict(list)
    for r in docs.collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(kept["decontamination"])
    room = defaultdict(int)
    for i, found in pieces.items():
        ids, at = [*encoded(kept["decontamination"][i]), 2], 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
            room[r.sequence_id] += r.length
        assert at == len(ids)
    assert max(room.values()) <= 4096 and len(room) <= sum(room.values()) / 4096 * 1.05 + 1


def test_run_and_empty_tables(spark, folder, tmp_path):
    got = corpus_pipeline.run(spark, folder)
    assert got.count() > 200 and got.where("doc_id % 5 = 0 and doc_id < 420").select("doc_id").distinct().count() < 10
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_a_query_for_each_operator():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
