"""The pipeline against plain Python on a small table, stage by stage."""

from collections import Counter, defaultdict

from tests_support import classes

import corpus_pipeline as pipeline
from platewise.llm.mixing import capped_targets


def test_stages_in_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(90_001, None, "en", "src0", 0), (90_002, "12 34 !!", "en", "src0", 8), (None, "a house of cards and a garden", "en", None, 5)], docs.schema)
    now = docs.union(extra)
    (_, language), (_, distinct), (_, mixing), (_, packing) = pipeline.STAGES
    kept = language(spark, now, "")
    rows = kept.collect()
    assert kept.columns == docs.columns and {r.doc_id for r in now.collect()} - {r.doc_id for r in rows} == {90_001, 90_002}
    one = distinct(spark, kept, "")
    texts = [(r.doc_id, r.text) for r in rows]
    want = {d for d, n, c in classes(texts) if d == c or d is None}
    assert Counter(r.doc_id for r in one.collect()) == Counter(want) and one.columns == docs.columns
    mixed = mixing(spark, one, "")
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 3 and set(copies) <= want and mixed.columns == docs.columns
    words, total = defaultdict(int), 0
    for r in one.collect():
        n = len((r.text or "").split())
        total += n
        words[r.source] += n * copies[r.doc_id]
    assert total * 0.9 <= sum(words.values()) <= total
    packed = packing(spark, mixed, "").collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == copies


def test_run(spark):
    assert pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_distinct_decides_by_row(spark):
    def text(k):
        return " ".join(f"w{k}x{i}" for i in range(40))

    rows = [
        ("a", 11, text(1)), ("b", 5, text(1) + " end"), ("c", None, text(1)),  # one class: b has the least id
        ("d", None, text(2)), ("e", None, text(2)), ("f", None, text(3)),  # copies without an id; f is alone
        ("g", 20, text(4)), ("h", 20, text(5)),  # one id, different texts
        ("i", 30, text(6)), ("j", 40, text(6) + " end"), ("k", 40, text(7)),  # j is a copy, k shares its id
        ("l", 20, text(4)), ("m", None, None), ("n", None, " "), ("o", 50, ""), ("p", 50, ""),  # without words: kept
    ]
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string").repartition(3)
    one = pipeline.distinct_stage(spark, docs, "")
    assert one.columns == docs.columns
    got = one.collect()
    assert all(tuple(r) in rows for r in got)
    names = sorted(r.source for r in got)
    assert len([x for x in names if x in "de"]) == 1 and len([x for x in names if x in "gl"]) == 1
    assert [x for x in names if x not in "degl"] == list("bfhikmnop")


def test_mixing_decides_by_row(spark):
    rows = []
    for i in range(900):
        source = f"src{i % 3}"
        rows.append((source, None if i % 9 < 3 else 7 if i % 9 < 5 else i, f"t{i} " + "word " * (i * 7 % 30), "en", i))
    docs = spark.createDataFrame(rows, "source string, doc_id long, text string, lang string, n_chars int").repartition(3)
    mixed = pipeline.mixing_stage(spark, docs, "")
    assert mixed.columns == docs.columns
    copies = Counter(tuple(r) for r in mixed.collect())
    assert set(copies) <= set(rows) and max(copies.values()) <= 3
    have, got = Counter(), Counter()
    for r in rows:
        have[r[0]] += len(r[2].split())
        got[r[0]] += len(r[2].split()) * copies[r]
    names = sorted(have)
    targets = capped_targets([have[s] for s in names], [5.0, 2.0, 1.0], sum(have.values()), 3)
    assert sum(got.values()) <= sum(have.values())
    for s, target in zip(names, targets, strict=True):
        assert abs(got[s] - target) <= 60
    # In each source a row comes as often as any other, or once more or less; rows of null or repeated id among them too.
    for s in names:
        for some in ([r for r in rows if r[0] == s and r[1] is None], [r for r in rows if r[0] == s and r[1] == 7], [r for r in rows if r[0] == s and r[1] not in (None, 7)]):
            n = [copies[r] for r in some]
            assert not n or max(n) - min(n) <= 1
