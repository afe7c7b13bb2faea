"""A small corpus with every odd case, and plain Python that says what operators must give."""

import random
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghiklmnoprstuv") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."


def corpus(seed=1, n=60):
    """(doc_id, text) rows: prose, exact and near copies, shared passages, empties, nulls, one long text, odd spaces, a repeated row."""
    rng = random.Random(seed)
    rows = []
    passage = sentence(rng, 60)
    for i in range(n):
        text = "\n".join(sentence(rng, rng.randint(5, 25)) for _ in range(rng.randint(1, 6)))
        if i % 7 == 3:
            text = f"{text} {passage}"
        rows.append((i, text))
    base = rows[5][1]
    for k in range(14):  # near copies of growing distance
        w = base.split(" ")
        for _ in range(1 + k // 2):
            w[rng.randrange(len(w))] = f"changed{k}"
        rows.append((n + k, " ".join(w)))
    rows += [(n + 20, base), (n + 21, base), (n + 22, None), (n + 23, ""), (n + 24, " \t\n"), (n + 25, "One"), (n + 26, "one"), (n + 27, "two words")]
    rows += [(n + 28, "a\x0bb\x0cc\x1cd\x85e f É é   g"), (n + 29, " ".join(f"w{j % 701}" for j in range(30_000))), rows[3], (None, base)]
    return rows


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(3)


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m
