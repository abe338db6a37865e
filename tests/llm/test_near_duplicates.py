"""Near-duplicate classes against brute force over all pairs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from harrow.llm.components import connected_components
from harrow.llm.near_duplicates import near_duplicates, prob_min_hash, probability_jaccard

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text):
    w = WORDS.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
    n = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    return {k: 1 + math.log(v) for k, v in n.items()}


def similarity(a, b):
    out = 0.0
    for i in a.keys() & b.keys():
        out += 1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys())
    return out


def brute(rows):
    """class of each row by its place"""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    s = [shingles(t) if t is not None else {} for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] is not None and rows[i][1] == rows[j][1]
            if not same and s[i] and s[j]:
                bound = min(sum(s[i][k] for k in s[i].keys() & s[j].keys()) / sum(s[i].values()), 1)
                same = bound >= 0.8 - 1e-9 and similarity(s[i], s[j]) >= 0.8 - 1e-9
            if same:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, least[find(i)], d == least[find(i)]) for i, (d, _) in enumerate(rows)]


def near(rng, words, share):
    return " ".join(rng.choice(["foo", "bar", "qux"]) + str(rng.random()) if rng.random() < share else w for w in words)


@pytest.mark.parametrize("tile", [512, 3])
def test_against_brute_force(spark, sf, tile):
    rng = random.Random(5)
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 2500").limit(60).collect()]
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = real + [(1000 + i, near(rng, base, 0.015)) for i in range(40)]
    line = " ".join(f"r{i}" for i in range(12))
    rows += [(2000, "\n".join([line] * 9)), (2001, "\n".join([line] * 9) + " end"), (2002, "\n".join([line] * 3))]
    rows += [(3000, ""), (3001, ""), (3002, None), (3003, None), (3004, "!!!"), (3005, "One two"), (3006, "one, TWO."), (3007, "one two three")]
    df = spark.createDataFrame([(d, t, "x", 0) for d, t in rows], "doc_id long, text string, class_id string, key int").repartition(3)
    got = sorted(map(tuple, near_duplicates(df, tile=tile).collect()))
    assert got == sorted(brute(rows))


def test_empty_and_ids(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(none).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "lone"), (9, "q")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 7), (7, 7), (7, 7), (None, None), (9, 9)], key=repr)


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(0)
    a, b = {int(i): float(rng.integers(1, 5)) for i in range(1, 300)}, {int(i): float(rng.integers(1, 5)) for i in range(60, 360)}
    args = [f(x) for x in (a, b) for f in (lambda x: np.array(sorted(x), dtype=np.uint64), lambda x: np.array([x[k] for k in sorted(x)]))]
    exact = similarity(a, b)
    assert abs(probability_jaccard(*args) - exact) < 1e-12
    doc = np.repeat([0, 1], [len(a), len(b)])
    sig = prob_min_hash(doc, np.concatenate((args[0], args[2])), np.concatenate((args[1], args[3])), 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.03
    assert (sig > 0).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)] + [(7, 7), (None, 3)]
    got = {r.vertex: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a is not None and a != b:
            root[find(a)] = find(b)
    assert got.keys() == root.keys()
    assert len({(got[x], find(x)) for x in root}) == len({find(x) for x in root}) == len(set(got.values()))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
