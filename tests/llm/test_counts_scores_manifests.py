"""Phrase collocations, language-model scores and Merkle manifests against plain Python, with odd rows."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from platewise.llm import manifest, phrases, scoring

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# 11 ------------------------------------------------------------------------------------------------------------------


def plain_collocations(rows, longest, least, percent, top):
    grams, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in range(1, longest + 1):
                grams[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in grams.items():
        often = {p: a for p, a in f.items() if a >= least}
        found = []
        for p, a in often.items():
            inside = [x for x in often if len(x) > len(p) and any(x[i : i + len(p)] == p for i in range(len(x)))]
            if len(p) > 1 and not any(100 * often[x] >= percent * a for x in inside):
                score, _, left, right = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def babble(seed, n=160):
    rnd = random.Random(seed)
    words = ["a", "b", "c", "don't", "É", "é", "日本", "x" * 200, "-"]
    marks = [" ", " ", " ", "\t", "  ", ".", ", ", "\n", " ! ", "\x0b", " ", " "]
    texts = ["".join(rnd.choice(["a b c ", "é 日本 - ", ""]) + rnd.choice(words).upper() * rnd.randint(0, 1) + rnd.choice(words) + rnd.choice(marks) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    texts += ["the same line again and again here " * 4] * 6 + ["a a a a a a a a"] * 3 + [None, "", " ", "...", "\x00 \x00 \x00"]
    return [(rnd.choice(["en", "de", None, "und"]), t) for t in texts]


@pytest.mark.parametrize(("words_at_once", "phrases_at_once", "percent", "longest"), [(1 << 18, 1 << 22, 100, 5), (3, 40, 60, 4)])
def test_collocations_against_plain_python(spark, monkeypatch, words_at_once, phrases_at_once, percent, longest):
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", words_at_once)
    monkeypatch.setattr(phrases, "PHRASES_AT_ONCE", phrases_at_once)
    rows = babble(percent + longest)
    docs = spark.createDataFrame([(x, t, "clash", 1) for x, t in rows], "lang string, text string, phrase string, id int").repartition(3)
    got = phrases.collocations(docs, longest=longest, least=6, percent=percent, top=40).drop("cut")
    want = plain_collocations(rows, longest, 6, percent, 40)
    assert len(want) > 15 and sorted(map(tuple, got.collect())) == want


def test_collocations_of_nothing_and_exact_arithmetic(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(none.union(spark.createDataFrame([("en", "once only")], none.schema)), least=2).count() == 0
    assert phrases.collocations(spark.createDataFrame([("x x",)], "text string"), least=1).collect()[0].lang == "und"
    big = spark.range(1).select(phrases.lowest_cut(F.lit(10**13 + 1), F.lit(10**15 + 7), F.array(F.lit(10**13 + 3), F.lit(10**13 + 1)).cast("array<bigint>"), F.array(F.lit(10**14 + 9), F.lit(10**14 + 11)).cast("array<bigint>")).alias("c")).first().c
    cuts = [(1000 * (10**13 + 1) * (10**15 + 7) // (left * right), k, left, right) for k, left, right in ((1, 10**13 + 3, 10**14 + 11), (2, 10**13 + 1, 10**14 + 9))]
    assert tuple(big) == min(cuts)


# 13 ------------------------------------------------------------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_manifest(rows, fanout, tamper):
    """Rows of (doc_id, source, lang, n_chars, text): what the contract asks for, by plain recursion."""

    def leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))

    def climb(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def siblings(levels, at):
        for level in levels[:-1]:
            run = at // fanout * fanout
            yield level[run:at], level[at + 1 : run + fanout]
            at //= fanout

    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in names:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = climb([leaf(r) for r in groups[lang]])
    top = climb([trees[x][-1][0] for x in names]) if names else [[None]]
    out = []
    for g, lang in enumerate(names):
        for i, r in enumerate(groups[lang]):
            way = [*siblings(trees[lang], i), *siblings(top, g)]
            changed = (*r[:3], r[3] + 1, r[4]) if r[0] is not None and r[3] is not None and tamper(r[0]) else r
            node = leaf(changed)
            for before, after in way:
                node = sha("".join(before) + node + "".join(after))
            out.append((str(r[0]), leaf(r), trees[lang][-1][0], top[-1][0], sha("".join("".join(b + a) for b, a in way)), node, node == top[-1][0]))
    return sorted(out)


def seventh(i):
    return zlib.crc32(str(i).encode()) % 7 == 0


@pytest.mark.parametrize(("fanout", "small"), [(2, 4), (3, 10_000)])
def test_manifest_against_plain_recursion(spark, monkeypatch, fanout, small):
    monkeypatch.setattr(manifest, "SMALL", small)
    rnd = random.Random(fanout)
    texts = [None, "", "-", "3:abc", "é🎉", "x" * 50_000, "a\x00b"]
    rows = [(rnd.choice([i, -i, (1 << 60) + i]), rnd.choice(["s", "", None, "1:s"]), rnd.choice(["en", "en", "en", None, "", "日"]), rnd.choice([None, 0, i]), rnd.choice([*texts, f"text {i}"])) for i in range(90)]
    rows += [(None, "s", "en", 1, "no id"), (None, None, None, None, None), (7, "s", "lone", 3, "lone"), *[(11, "s", "en", 5, "same")] * 5, (11, "t", "en", 5, "same id")]
    docs = spark.createDataFrame([(*r, "clash", 9) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, idx int").repartition(3)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = manifest.manifest(docs, changed={"n_chars": tampered}, fanout=fanout)
    got = got.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("p"), "folded_root", "verified").collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == plain_manifest(rows, fanout, seventh)
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_nothing_and_of_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert manifest.manifest(empty).count() == 0
    one = manifest.manifest(empty.union(spark.createDataFrame([(1, "x", "en")], empty.schema))).collect()
    assert [(r.root == r.leaf == r.subroot, r.path, r.verified) for r in one] == [(True, [], True)]
    with pytest.raises(ValueError, match="two nodes"):
        manifest.manifest(empty, fanout=1)


# 12 ------------------------------------------------------------------------------------------------------------------


def test_guesses_look_back_in_their_own_text():
    rnd = np.random.default_rng(4)
    ids = rnd.integers(0, 5, 400)
    doc = np.sort(rnd.integers(0, 9, 400))
    marks = rnd.integers(0, 1 << 32, 5).astype(np.uint32)
    g = scoring.guesses(ids, doc, marks[ids])
    want, state = [], {}
    for i in range(len(ids)):
        guess = order = None
        for reach in (2, 1):
            if i >= reach and doc[i - reach] == doc[i]:
                for j in range(i - 1, reach - 1, -1):
                    if doc[j - reach] == doc[i] and all(ids[j - k] == ids[i - k] for k in range(1, reach + 1)):
                        guess, order = ids[j], reach - 1
                        break
            if guess is not None:
                break
        if guess is not None:
            run, hits, misses = state.get(doc[i], (0, 0, 0))
            hit = guess == ids[i]
            want.append((i, guess, order, hit, min(run, 15), hits, misses))
            state[doc[i]] = (run + 1 if hit else 0, hits + hit, misses + (not hit))
    assert list(zip(g.at, g.guess, g.order, g.hit, g.run, g.hits, g.misses, strict=True)) == want and len(want) > 200
    none = scoring.guesses(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32))
    assert len(none.at) == 0


def test_code_and_contexts():
    counts = np.ones(257)
    counts[[97, 98, 256]] = 1000, 500, 800
    code = scoring.huffman(counts)
    assert math.isclose(sum(2.0 ** -int(n) for n in code[2]), 1) and code[2][97] <= code[2][98] < code[2][0]
    words = [b"ab", b"b", b"abab", b"xb" * 40, b"\n"]
    together = scoring.bits_of(words, code)
    alone = [scoring.bits_of([w], code) for w in words]
    for k, slot in enumerate(together.slots):  # batches make no difference
        assert np.array_equal(slot, np.concatenate([a.slots[k] for a in alone]))
    assert np.array_equal(together.bit, np.concatenate([a.bit for a in alone])) and together.word.max() == 4
    first = int(code[2][97])  # "ab" and "abab" agree until their third letters part, in the whole beginning too
    a, b = together.word == 0, together.word == 2
    same = first + int(code[2][98])
    assert all(np.array_equal(s[a][:same], s[b][:same]) for s in together.slots)
    n = np.array([0, 1, 63, 64, 100, 10**6, 10**12])
    assert all(abs(scoring.COUNT[c] - m) <= 0.1 * m for c, m in zip(scoring.coded(n)[:-1], n, strict=False))


@pytest.mark.parametrize("tokens", [1, 700, 1 << 16])
def test_words_are_numbered_without_a_call_a_word(monkeypatch, tokens):
    monkeypatch.setattr(scoring, "TOKENS", tokens)
    rnd = random.Random(8)
    texts = [None, "", " ", "\n", "A a\ta a \x1c É é\x85x", " x\x0b\x0cY ", "\x00", "\u3000 ß"] + [" ".join(str(rnd.randint(0, 900)) for _ in range(rnd.randint(0, 90))) for _ in range(200)] + [None]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, len(texts[k : k + 90]) + k)), pa.array(texts[k : k + 90], pa.string())], ["row", "text"]) for k in range(0, len(texts), 90)]
    got, calls, groups = {}, Counter(), []
    sys.setprofile(lambda frame, event, arg: calls.update([event]))
    try:
        for rows, words, size in scoring.text_batches(iter(batches), 2):
            groups.append((rows, *scoring.numbered(words, size)))
    finally:
        sys.setprofile(None)
    for rows, found, ids, doc in groups:
        assert len(set(found)) == len(found)
        for k, (row,) in enumerate(rows):
            got[row] = [found[i] for i in ids[doc == k]]
    assert got == {k: [*(t or "").translate(LOWER).encode().split(), scoring.END] for k, t in enumerate(texts)}
    n = [len(ids) for *_, ids, _ in groups]
    assert all(x >= tokens for x in n[:-1]) and calls["call"] < 100 + 100 * len(groups) < (1e9 if tokens == 1 else sum(n))


def test_last_same_of_keys_that_share_their_high_bits():
    rnd = np.random.default_rng(5)
    for key in (rnd.integers(0, 40, 500), (rnd.integers(0, 4, 500) << 60) + rnd.integers(0, 3, 500), rnd.integers(0, 1 << 62, 9), np.empty(0, int)):
        key = key.astype(np.uint64)
        assert scoring.last_same(key).tolist() == [max((j for j in range(i) if key[j] == key[i]), default=-1) for i in range(len(key))]


@pytest.mark.parametrize("less", [False, True])
def test_inputs_are_logs_of_counts(less):
    code = scoring.huffman(np.ones(257))
    b = scoring.bits_of([b"abcabc", b"abd", b"", b"xyzzy" * 3, b"abcabc"], code)
    rnd = np.random.default_rng(6)
    table = rnd.choice([0, 1, 2, 50, 200, 255], 2 * int(scoring.OFFSETS[-1]), p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05]).astype(np.uint8)
    if less:
        for slot in b.slots:
            table[2 * slot + b.bit] |= 1  # each has been counted
    s, gate = scoring.inputs_of(b, table, less)
    for i in range(0, len(b.bit), 3):
        longest = third = None
        for k, (order, _) in enumerate(scoring.ORDERS):
            n = [int(table[2 * b.slots[k][i] + x]) for x in (0, 1)]
            left = [scoring.COUNT[n[x]] - (less and b.bit[i] == x) for x in (0, 1)]
            prior = scoring.PRIOR if order else scoring.LONG_PRIOR
            assert s[i, k] == pytest.approx(math.log(left[1] + prior) - math.log(left[0] + prior), abs=1e-5)
            if sum(n) > less:
                longest = k + 1
        longest, third = longest or 0, int(b.place[i])
        if longest == len(scoring.ORDERS):
            longest += int(scoring.CLASS[max(n)])
            third = 2 * (min(n[x] - (less and int(b.bit[i]) == x) for x in (0, 1)) == 0) + (b.place[i] > 2)
        assert gate[i] == 4 * longest + third and s[i, -1] == 1


@pytest.mark.parametrize("chunks", [1, 1100])
def test_vectors_are_summed_in_tasks_of_few_chunks(spark, chunks):
    size = chunks * scoring.CHUNK - 5
    numbers = lambda i: np.random.default_rng(i).integers(0, 100, size)

    def vectors(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                yield from scoring.vector_rows(numbers(i))

    rows = spark.range(0, 6, 1, 3).mapInArrow(vectors, "chunk int, data binary")
    want = sum(map(numbers, range(6)))
    got = scoring.summed(rows, size)
    assert (scoring.gathered(got, size) == want).all()
    assert (scoring.gathered(scoring.summed(rows, size, scoring.coded), size, "u1") == scoring.coded(want)).all()
    held = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]  # fails where Spark merges small partitions
    assert sum(held) == chunks and max(held) <= max(1, chunks // 2)


def test_no_task_of_a_fit_needs_two_workers(spark, monkeypatch):
    plans, table = [], scoring.Scratch.table
    monkeypatch.setattr(scoring.Scratch, "table", lambda self, df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or table(self, df, name))
    with scoring.Scratch(spark, "fit") as work:
        scoring.fit_spelling(spark.createDataFrame([(b"ab", 3), (b"abc", 1)], "word binary, c long"), work)
    steps = [re.findall(r"MapInArrow|Exchange", p) for p in plans]
    assert len(steps) == 2 and all("MapInArrow" in x for x in steps)
    assert not any(a == b == "MapInArrow" for x in steps for a, b in zip(x, x[1:], strict=False))


def test_decisions_of_a_model_are_a_distribution(spark):
    """Over all words of two letters at most and everything longer, probabilities add up to 1."""
    from platewise.llm.common import Scratch

    words = spark.createDataFrame([(bytearray(w), c) for w, c in ((b"ab", 9), (b"ba", 4), (b"a", 30), (b"\n", 12), (b"abc", 0))], "word binary, c long")
    with Scratch(spark, "test") as work:
        model = scoring.fit_spelling(words, work)
    few = [bytes([x]) for x in range(256)] + [bytes([x, y]) for x in b"ab" for y in range(256)]
    p = 2.0 ** -model.bits([b"", *few])
    assert 0.5 < p.sum() < 1 and p[1 + 97] > 0.2 and p[1 + 97] > p[1 + 98] > p[1 + 99]


def base_of(rows, learned):
    c = Counter(w for (i, t), k in zip(rows, learned, strict=True) if k for w in [*(t or "").translate(LOWER).encode().split(), None])
    n, v = sum(c.values()), len(c)
    for _, t in rows:
        words = [*(t or "").translate(LOWER).encode().split(), None]
        yield len(words), sum(c[w] > 0 for w in words), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)


@pytest.mark.parametrize(("hot", "tokens"), [(1 << 17, 1 << 18), (5, 50)])
def test_scores_base_and_odd_rows(spark, monkeypatch, hot, tokens):
    monkeypatch.setattr(scoring, "HOT_WORDS", hot)
    rnd = random.Random(3)
    vocabulary = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 6))) for _ in range(80)]
    texts = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 60))) for _ in range(120)]
    texts += [None, "", " ", "A a\ta a \x1c É é", "x" * 100_000, "the same words stand here " * 400, "\x00"] + ["twice over"] * 3
    rows = [(None if k % 40 == 0 else k * (1 << 50) + 1, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, bits string").coalesce(2)
    learn = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    got = scoring.score_documents(docs, learn).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    learned = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    want = defaultdict(list)
    for (i, _), b in zip(rows, base_of(rows, learned), strict=True):
        want[i].append(b)
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.n_tokens, r.n_known, r.train_tokens, r.base_score))
        assert r.score < 0 and (r.bits_per_byte is None or r.bits_per_byte > 0)
    for i, some in want.items():
        for a, b in zip(sorted(some), sorted(have[i]), strict=True):
            assert a[:3] == b[:3] and math.isclose(a[3], b[3], rel_tol=1e-9)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    repeated = next(by[i] for i, t in rows if t and t.startswith("the same words"))
    assert repeated.score > 0.2 * repeated.base_score and repeated.bits_per_byte < 0.5


def test_scores_agree_on_reruns_and_without_rows_to_learn_from(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 10 != 0
    one, two = ({r.doc_id: (r.score, r.base_score) for r in scoring.score_documents(docs, learn).collect()} for _ in range(2))
    assert one == two
    none = scoring.score_documents(docs.limit(5), F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in none)
    assert scoring.score_documents(docs.limit(0), learn).count() == 0
    every = {r.doc_id: r for r in scoring.score_documents(docs, learn).collect()}
    held = [r for i, r in every.items() if zlib.crc32(str(i).encode()) % 10 == 0]
    jumbled = docs.withColumn("text", F.reverse("text"))
    worse = {r.doc_id: r for r in scoring.score_documents(docs.withColumn("k", F.lit(0)).unionByName(jumbled.withColumn("k", F.lit(1))).withColumn("doc_id", F.col("doc_id") * 2 + F.col("k")), F.col("k") == 0).collect()}
    assert len(held) > 10 and sum(worse[2 * r.doc_id + 1].score for r in held) < 1.3 * sum(worse[2 * r.doc_id].score for r in held)
