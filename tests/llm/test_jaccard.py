import random
from itertools import combinations

import numpy as np
import pytest

from tests_support import classes

from platewise.llm.common import Scratch
from platewise.llm import jaccard
from platewise.llm.graph import components
from platewise.llm.jaccard import jaccard_classes, search


def corpus(seed=3, n=120):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = [rnd.choice(vocab) for _ in range(60)]
    rows = []
    while len(rows) < n:
        words = [rnd.choice(vocab) for _ in range(rnd.choice([1, 3, 6, 20, 60, 300]))]
        if rnd.random() < 0.3:
            words[len(words) // 2 : len(words) // 2] = passage
        for _ in range(rnd.choice([1, 1, 2, 8])):
            copy = list(words)
            for _ in range(rnd.randint(0, 1 + len(copy) // 60)):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((len(rows) * 3 % 1009, " ".join(copy).replace("w1 ", "W1\t\n")))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "É é x"), (5004, "é é x"), (5005, "One two"), (5006, "one  TWO"), (5006, "one  TWO"), (None, "one two"), (None, None)]
    rows.append((5010, "long " * 20_000))
    return rows


@pytest.mark.parametrize("limits", [{}, {"batch": 500, "bucket": 700, "room": 800, "heavy": (0.02, 3)}, {"batch": 2000, "bucket": 3000, "room": 100, "heavy": (0.3, 3)}])
def test_against_all_pairs(spark, limits):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_classes(docs, **limits)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect()), key=str) == classes(rows)


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_classes(docs).count() == 0
    docs = spark.createDataFrame([(1, "a b c", 7, "x"), (2, "a b c", 8, "y")], "doc_id long, text string, id int, n string")
    assert sorted(map(tuple, jaccard_classes(docs).collect())) == [(1, 1, 1), (2, 1, 1)]


def test_all_bits_of_a_shingle_travel():
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 64, 1000, np.uint64, endpoint=False))
    x = np.unique(np.concatenate((x, x ^ np.uint64(1 << 63), x ^ np.uint64(1), x ^ np.uint64(1 << 41))))
    assert (jaccard._from_planes(jaccard._planes(x)) == x).all() and len(jaccard._from_planes(jaccard._planes(x[:0]))) == 0


def test_large_group_of_near_copies_and_what_hangs_on_it(spark):
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(120)] = f"x{rnd.randrange(60)}"
        rows.append((1000 - i, " ".join(words)))
    rows += [(2000 + k, " ".join(base[: 100 - k])) for k in range(30)]  # shorter and shorter: a chain of links
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard_classes(docs, batch=2000, bucket=5000, room=1500, heavy=(0.9, 500))
    assert sorted(map(tuple, got.collect()), key=str) == classes(rows)


def test_search_connects_what_is_linked():
    rnd = np.random.default_rng(5)
    base = rnd.integers(0, 1 << 40, 60)
    sets = [np.unique(np.where(rnd.random(60) < 0.12, rnd.integers(0, 1 << 40, 60), base)) for _ in range(60)]
    sizes = np.array([len(s) for s in sets])
    links = {(i, j) for i, j in combinations(range(60), 2) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))}

    def groups(edges):
        label = list(range(60))
        for _ in range(60):
            for i, j in edges:
                label[i] = label[j] = min(label[i], label[j])
        return label

    for queries in (None, list(range(60))):
        found = search(sizes, sets, 80, queries)
        assert {tuple(sorted(x)) for x in found} <= links
        assert groups(found) == groups(links)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "links")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in range(100, 130)}
