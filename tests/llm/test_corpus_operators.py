"""Each corpus operator against a brute-force version, an exact round trip or held-out accuracy, with odd rows."""

import hashlib
import json
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from platewise.llm import binary_output, chat, fingerprint, jaccard, language, media, mixing, packing, tokens, urls
from platewise.llm.common import Scratch, row_keys

ODD = [
    None, "", " ", "\n", "a", "a  b", " a", "a b ", "x\n\ny", "a \nb", "▁▁ x", "<s> </s> <unk> <|endoftext|> <|startoftext|>x", "日本語 テキスト", "🎉🎉 é é", "\t\ta\r\n", "<0x0A>\x00", "aaaa" * 300, "it's we'll I'VE",
    "  　x", "1234567 ....---", "word. Word, word.\nWord", "[INST] ok [/INST]</s>", "ß Σ ΑΣ Σα", "foo;\r\nbar();\r\n", "a\x1cb \x85c", "|| ~ _ |", "€uro 12.50,",
]


def odd_docs(spark):
    rnd = random.Random(2)
    alphabet = "ab .\n▁é日🎉\t\r;(){}<|s>/0x,"
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(150)] + ["the quick brown fox " * 3000, "the quick"] * 2
    rows = [(i * 7 % 1001, t, "clash", i) for i, t in enumerate(texts)] + [(None, "no id", "x", 1), (None, None, "x", 2), (5000, "twice", "x", 3), (5000, "twice", "x", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_tokens int"), [(r[0], r[1]) for r in rows]


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


def test_row_keys(spark, tmp_path):
    df = spark.range(1000).withColumn("text", F.lit("x")).repartition(7)
    df.write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    for rows in (row_keys(table, "k"), row_keys(df, "k"), row_keys(table.filter("id < 500").union(table.filter("id >= 500")), "k")):
        got = {r.id: r.k for r in rows.collect()}
        assert len(got) == len(set(got.values())) == 1000 and got == {r.id: r.k for r in rows.repartition(3).collect()}
    assert "__file" not in row_keys(table, "k").columns and row_keys(table.limit(0), "k").count() == 0


# 1 -------------------------------------------------------------------------------------------------------------------


def test_mixing_reaches_targets_and_reruns_agree(spark):
    rnd = random.Random(1)
    sizes = [(i, rnd.choice(["a", "b", "c", "d", None] + ["a"] * 4), rnd.randint(0, 60)) for i in range(3000)]
    docs = spark.createDataFrame([(i, s, " ".join(["w"] * n) if n else None) for i, s, n in sizes], "doc_id long, source string, text string").repartition(5)
    got = {r.doc_id: r for r in mixing.mix(docs, mixing.cycle_weights).collect()}
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(2), mixing.cycle_weights).collect()}
    assert {k: r.taken for k, r in got.items()} == again and len(got) == 3000
    total = sum(n for _, _, n in sizes)
    by, target = defaultdict(int), {}
    for i, s, n in sizes:
        assert got[i].size == n and got[i].taken == n * got[i].repeats and got[i].repeats <= 3
        by[s] += got[i].taken
        target[s] = got[i].target
    assert sum(target.values()) == pytest.approx(total)
    assert all(abs(by[s] - target[s]) <= 120 for s in by)
    assert total - 60 <= sum(by.values()) <= total


def test_mixing_against_plain_fair_queueing(spark):
    rnd = random.Random(4)
    rows = [(i if i % 7 else None, rnd.choice(["b", "a", None, "c", "a"]), " ".join(f"w{i}" for _ in range(rnd.randint(0, 40)))) for i in range(600)]
    docs = spark.createDataFrame([(k, *r, "x", 1.0) for k, r in enumerate(rows)], "key long, doc_id long, source string, text string, size string, target double")
    got = {r.row_key: r.repeats for r in mixing.mix(docs, mixing.cycle_weights, key_col="key").collect()}
    hashed = docs.withColumn("size", mixing.word_count(F.col("text"))).withColumn("mark", F.xxhash64("text"))
    order = {r.key: (r.h, r.mark) for r in hashed.select("key", "mark", F.xxhash64(F.lit(17), "doc_id", "size", F.when(F.col("doc_id").isNull(), F.col("mark"))).alias("h")).collect()}
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    queue = {s: sorted((k for k, r in enumerate(rows) if r[1] == s), key=lambda k: (order[k][0], rows[k][0] if rows[k][0] is not None else -1, order[k][1], k)) for s in names}
    words = [len(r[2].split()) for r in rows]
    sizes = [sum(words[k] for k in queue[s]) for s in names]
    targets = mixing.capped_targets(sizes, mixing.cycle_weights(names), sum(sizes), 3)
    finish = []
    for rank, s in enumerate(names):
        done = 0
        for turn in range(3):
            for k in queue[s]:
                if words[k]:
                    done += words[k]
                    finish.append((done / targets[rank], rank, order[k][0], order[k][1], k, turn))
    want, sent = Counter(), 0
    for *_, k, _ in sorted(finish):
        if sent + words[k] <= sum(sizes):
            want[k] += 1
        sent += words[k]
    assert got == {k: want[k] for k in range(len(rows))}


def test_capped_targets():
    assert mixing.capped_targets([10, 100, 100], [5, 2, 1], 210, 3) == [30.0, 120.0, 60.0]
    assert mixing.capped_targets([0, 10], [5, 2], 10, 3) == [0.0, 10.0]


def test_mixing_of_nothing(spark):
    assert mixing.mix(empty_docs(spark), mixing.cycle_weights).count() == 0


# 2 -------------------------------------------------------------------------------------------------------------------


def brute_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group(0)
    path = re.match(r"[^?#]*", rest[len(host) :]).group(0)
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(r), len(r.split("/")[0]), r, v) for r, v in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return (host, path, max(fits)[2], max(fits)[3]) if fits and host else (host, path, None, "allow")


@pytest.mark.parametrize("most_bytes", [urls.MOST_BYTES, 0])
def test_url_rules(spark, most_bytes):
    rnd = random.Random(4)
    hosts = ["example.com", "WWW.Example.com", "a.www.example.com", "x.net", "net", "com", "example.org", "notexample.com", "b.com:80", ""]
    pages = [(i, f"http{rnd.choice(['', 's'])}://{rnd.choice(hosts)}{rnd.choice(['', '/', '/en', '/en/', '/en/x', '/es/1', '/fr/', '?q=/en/', '#/en/'])}{rnd.choice(['', '?a=b', '#c'])}") for i in range(400)]
    pages += [(1000, None), (1001, ""), (1002, "example.com/en/"), (1003, "a://b://c/d"), (1, "http://example.com/en/")]
    df = spark.createDataFrame([(i, u, "h") for i, u in pages], "page_id long, url string, host string")
    rules = urls.RULES + [("example.com/", "block"), ("example.org/en/x", "block")]
    got = urls.judge(df, spark.createDataFrame(rules, "rule string, verdict string"), most_bytes=most_bytes)
    assert Counter(map(tuple, got.collect())) == Counter((i, *brute_verdict(u, rules)) for i, u in pages)


CONTRACT_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def odd_pages(spark, sf_dir):
    """A table of pages with each id once: every rule, hosts that only look like one, and urls without parts."""
    hosts = ["com", "a.com", "EXAMPLE.com", "example.com", "www.example.com", "a.www.example.com", "b.example.com", "net", "x.y.NET", "notexample.com", "examplecom", "com.org", "example.com:80", "u@example.com", "example.com.", ".com", "a..com", "É.com", "日本.net", ""]
    paths = ["", "/", "/en", "/en/", "/en/x", "/EN/", "//en/", "/es/", "/fr/a/b", "?/en/", "#/es/", "/en?/", "/es/ \n/x", "/fr/é🎉?q#f"]
    urls_ = [f"{scheme}://{h}{p}" for h in hosts for p in paths for scheme in ("http", "")] + [None, "", "://", "example.com/en/", ":/com/", "a://b.net://c/es/", "x://net/es/://com/"]
    rows = [(i if i % 3 else (1 << 53) + i + 1, u) for i, u in enumerate(urls_)]
    spark.createDataFrame(rows, "page_id long, url string").repartition(3).write.parquet(f"{sf_dir}/pages.parquet")
    return rows


def test_url_query_on_odd_rows(spark, tmp_path):
    rows = odd_pages(spark, str(tmp_path))
    got = sorted(map(tuple, urls.op2_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "rule").collect()))
    assert got == sorted((i, *brute_verdict(u, CONTRACT_RULES)[:3]) for i, u in rows)
    assert {r[3] for r in got} == {None, *dict(CONTRACT_RULES)}


def test_url_rules_say_what_the_contract_says(spark, tmp_path):
    assert urls.RULES == CONTRACT_RULES
    listed = re.search(r"rules\(.*?\) as \(values (.*?)\)\s*,\s*fit", urls.OP2_SQL, re.S).group(1)
    assert re.findall(r"\('([^']*)', '(allow|block)'", listed) == CONTRACT_RULES
    odd_pages(spark, str(tmp_path))
    said = Counter((r.rule, r.verdict) for r in urls.op2_url_filter(spark, str(tmp_path)).collect())
    assert set(said) == {*CONTRACT_RULES, (None, "allow")}


def test_url_query_equals_its_sql(spark, tmp_path):
    odd_pages(spark, str(tmp_path))
    for sf_dir in ("/root/testdata/sf0.001", str(tmp_path)):
        con = duckdb.connect()
        con.execute(f"create view pages as select * from '{sf_dir}/pages.parquet{'/*.parquet' if sf_dir == str(tmp_path) else ''}'")
        got = urls.op2_url_filter(spark, sf_dir)
        assert Counter(map(tuple, got.select("page_id", "host", "path", "rule", "verdict").collect())) == Counter(con.execute(urls.OP2_SQL).fetchall())


def test_cascade_is_exact(spark):
    rnd = np.random.default_rng(1)
    h = rnd.integers(-(1 << 63), 1 << 63, (20_000, 2))
    on = rnd.random(20_000) < 0.1
    with Scratch(spark, "test") as work:
        levels = urls.cascade(spark.createDataFrame([(int(a), int(b), bool(c)) for (a, b), c in zip(h, on)], "h1 long, h2 long, on boolean"), work)
    assert len(levels) > 1 and (urls.listed(levels, h[:, 0].view(np.uint64), h[:, 1].view(np.uint64)) == on).all()
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(urls.RULES, "rule string, verdict string")).count() == 0


# 3, 5, 6 -------------------------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokens.tokenizer_path("piece_bpe_32k.model"))
    docs, rows = odd_docs(spark)
    got = Counter(map(tuple, tokens.token_counts(docs).collect()))
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in rows]
    assert got == Counter(want)
    assert tokens.token_counts(empty_docs(spark)).count() == 0


def library_ids(name, rows, end):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.tokenizer_path(name))
    return [(i, [*library.encode(t or "", add_special_tokens=False).ids, end]) for i, t in rows]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_packing_equals_the_library_and_has_no_gaps(spark):
    docs, rows = odd_docs(spark)
    got = packing.pack_documents(docs).collect()
    want = Counter((i, k, at, len(ids[at : at + 4096]), crc(ids[at : at + 4096])) for i, ids in library_ids("word_bpe_49k.json", rows, 1) for k, at in enumerate(range(0, len(ids), 4096)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) <= -(-sum(r.length for r in got) // 4096) + 2
    assert packing.pack_documents(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("lengths", [lambda r: r.integers(1300, 4097, 6000), lambda r: r.integers(300, 2000, 9000), lambda r: np.clip(r.exponential(700, 9000).astype(int) + 1, 1, 4096), lambda r: np.concatenate([r.integers(1, 300, 6000), r.integers(1000, 4097, 3000)])])
def test_no_more_sequences_than_best_fit_of_descending_lengths(lengths):
    v = lengths(np.random.default_rng(1))
    sequence, offset, n = packing.pack_lengths(v, 4096)
    plain = packing.best_fit(sorted(v.tolist(), reverse=True), [], 4096, 0)[1]
    assert n <= plain * 1.0005 and len(set(sequence.tolist())) == n
    for s in range(0, n, 97):
        mine = sorted(zip(offset[sequence == s], v[sequence == s], strict=True))
        assert mine[0][0] == 0 and all(a + x == b for (a, x), (b, _) in zip(mine, mine[1:], strict=False)) and sum(mine[-1]) <= 4096


def test_pack_lengths_near_the_bound():
    rnd = np.random.default_rng(0)
    lengths = np.minimum(4096, np.maximum(1, rnd.lognormal(6.2, 1.2, 20_000))).astype(int)
    sequence, offset, n = packing.pack_lengths(lengths, 4096)
    assert n <= 1.01 * -(-lengths.sum() // 4096)
    assert np.bincount(sequence, lengths, n).max() <= 4096
    assert packing.pack_lengths(np.array([4096, 4096, 1]), 4096)[2] == 3


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 24, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 777)
    data = binary_output.pack_bits(ids, width)
    assert len(data) == 98 * width and (binary_output.unpack_bits(data, width, 777) == ids).all()
    assert (binary_output.unpack_bits(data, width, 100, 333) == ids[333:433]).all()
    assert binary_output.bits_for(50_257) == 16 and binary_output.bits_for(2) == 1


def test_written_ids_round_trip(spark, tmp_path):
    docs, rows = odd_docs(spark)
    path = f"file://{tmp_path}/ids"
    binary_output.write_token_ids(docs, path, block_ids=500, parts=4)
    got = sorted(binary_output.digest_documents(spark, path).collect(), key=lambda r: r.start)
    want = library_ids("byte_bpe_50k.json", rows, 2)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(x), crc(x)) for i, x in want)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    names = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert names == sorted(names)
    back = {r.doc_id: r.ids for r in binary_output.read_documents(spark, path).collect()}
    assert zlib.crc32(back[5000]) == crc(dict(want)[5000])
    binary_output.write_token_ids(empty_docs(spark), f"{path}-none")
    assert binary_output.digest_documents(spark, f"{path}-none").count() == 0


# 4 -------------------------------------------------------------------------------------------------------------------


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.learned(docs)
    got = language.identify(docs.select("doc_id", "lang", "text", language.held_out(F.col("doc_id")).alias("held_out")), model, keep=["doc_id", "lang", "held_out"]).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 150 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    odd = spark.createDataFrame([(1, None, 0), (2, "", 1), (3, "123 !!", 2), (4, "The house and the garden of the king", 3)], "doc_id long, text string, score int")
    out = {r.doc_id: r for r in language.identify(odd, model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[1].score == 0.0 and out[4].lang_pred != "und"
    assert zlib.crc32(b"7") % 4 == spark.range(7, 8).select((F.crc32(F.col("id").cast("string")) % 4).alias("m")).first().m
    nothing = language.learned(empty_docs(spark))
    assert [r.lang_pred for r in language.identify(odd, nothing).collect()] == ["und"] * 4


def test_a_language_whose_rows_share_an_id_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE", 20)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null")
    for shared in range(40, 52):  # whatever the hash of the id
        one = docs.withColumn("doc_id", F.when(F.col("lang") == "de", F.lit(shared)).otherwise(F.col("doc_id")))
        if zlib.crc32(str(shared).encode()) % 4 != 2:
            break
    same = one.withColumn("text", F.when(F.col("lang") == "de", F.lit("der Hund und die Katze und das Haus in der Straße")).otherwise(F.col("text")))
    def fit(rows):
        return language.fit_languages(rows, learn=~language.held_out(F.col("doc_id")), order=F.xxhash64("doc_id", "text"), sample=20)

    got = language.identify(docs.filter("lang = 'de'"), fit(one)).collect()
    assert sum(r.lang_pred == "de" for r in got) > 0.9 * len(got)
    got = language.identify(same.filter("lang = 'de'"), fit(same)).collect()  # all rows of the language have one hash
    assert {r.lang_pred for r in got} == {"de"}
    wordless = docs.select("doc_id", "lang", "text").unionByName(spark.createDataFrame([(7, "xx", "123")], "doc_id long, lang string, text string"))
    assert "xx" not in language.fit_languages(wordless, learn=F.lit(True), order=F.xxhash64("doc_id")).languages


def test_decoding_against_a_plain_one(spark):
    model = language.learned(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    long_ = docs.limit(1).select("doc_id", F.array_join(F.array_repeat("text", 40), " ").alias("text"))
    rows = docs.select("doc_id", "text").union(long_).union(docs.select("doc_id", "text").limit(5))
    got = language.identify(rows, model).collect()
    assert len(got) == docs.count() + 6
    grams = language.Grams()
    for r in got[::7]:
        values, _ = grams.of([r.text])
        if not len(values):
            assert r.lang_pred == "und"
            continue
        loss = {}
        for lang, word in zip(model.languages, model.code, strict=True):
            total = 0.0
            for bit in range(model.odds.shape[1]):
                margin = (sum(model.odds[v, bit] for v in values) / len(values) - model.middle[bit]) * model.scale[bit]
                total += model.weight[bit] * np.exp(-min(20, max(-20, margin)) * word[bit])
            loss[lang] = total
        assert r.lang_pred == min(loss, key=loss.get)
        assert r.score == pytest.approx((1 / min(loss.values())) / sum(1 / x for x in loss.values()))


def test_a_text_in_two_languages_is_flagged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang is not null and length(text) > 400")
    one = {r.lang: r.text for r in docs.groupBy("lang").agg(F.first(F.substring("text", 1, 400)).alias("text")).collect()}
    (_, a), (_, b), *_ = sorted(one.items())
    mixes = spark.createDataFrame([(k, a[: 40 * k] + " " + b[: 400 - 40 * k]) for k in range(11)], "doc_id long, text string")
    got = {r.doc_id: r for r in language.identify(mixes, language.learned(docs), ambiguous=0.5).collect()}
    assert any(r.ambiguous for r in got.values()) and not got[0].ambiguous and not got[10].ambiguous and got[0].lang_pred != got[10].lang_pred


def test_codewords_are_apart():
    assert language.codewords(4).shape == (4, 7)
    for k in (2, 3, 5, 9, 30):
        code = language.codewords(k)
        assert min((code[i] != code[j]).sum() for i in range(k) for j in range(i)) >= 1


# 8 -------------------------------------------------------------------------------------------------------------------


def test_chat_format_round_trip(spark):
    hard = "</s>[INST] ok [/INST] <|im_end|><|im_start|>user<|im_sep|> <\u2060|im_end|> <<SYS>> <\u2060\u2060s> \\ \n"
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", hard), (1, 2, "assistant", hard * 2), (1, 3, "assistant", None), (2, 0, "assistant", "🎉 é"), (2, 0, "assistant", "🎉 é"), (3, 1, None, None), (None, 0, "user", "x"), (None, 1, "assistant", "y")]
    df = spark.createDataFrame([(*r, "q") for r in rows], "conv_id long, turn long, role string, text string, node string")
    got = {r.conv_id: r for r in chat.digest(chat.format_trees(chat.conversation_messages(df))).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    for c, turns in by.items():
        turns.sort(key=lambda x: x[0])
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        learned = "".join(text for _, role, text in turns if role == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.digest(chat.format_trees(chat.conversation_messages(df.limit(0)))).count() == 0


def test_branches_are_ranked(spark):
    rows = [(1, 1, None, 0.5), (1, 2, 1, 0.9), (1, 3, 1, 0.1), (1, 4, 2, 0.0), (1, 5, 3, 1.0), (1, 6, 3, None), (2, 1, None, 0.0)]
    tree = spark.createDataFrame(rows, "tree long, node int, parent int, score double")
    with Scratch(spark, "test") as work:
        jumps, whole, circles = chat.climb(tree, work)
        ranked = chat.rank_branches(tree, whole)
        paths = defaultdict(list)
        for r in sorted(chat.branch_steps(ranked, jumps, work).collect(), key=lambda r: -r.up):
            paths[r.tree, r.leaf].append(r.node)
        scores = {(r.tree, r.leaf): (r.depth, round(r.score, 6)) for r in ranked.collect()}
        assert circles.count() == 0
    assert paths == {(1, 4): [1, 2, 4], (1, 5): [1, 3, 5], (1, 6): [1, 3, 6], (2, 1): [1]}
    assert scores == {(1, 4): (3, 0.466667), (1, 5): (3, 0.533333), (1, 6): (3, 0.2), (2, 1): (1, 0.0)}
    said = tree.withColumn("role", F.lit("user")).withColumn("text", F.col("node").cast("string"))
    assert sorted((r.tree, r.rank, r.leaf) for r in chat.format_trees(said, per_tree=2).collect()) == [(1, 1, 5), (1, 2, 4), (2, 1, 1)]


def test_deep_combed_broken_and_cyclic_trees(spark):
    rows = [(1, i, i - 1 if i else None) for i in range(100)]  # a chain
    rows += [(2, 5, 4)] + [(3, 1, 2), (3, 2, None)]  # an ancestor is missing; numbers in another order
    rows += [(4, 1, 2), (4, 2, 3), (4, 3, 1), (4, 4, None), (4, 5, 1)]  # a circle beside a root
    rows += [(5, 2 * i, 2 * i - 2 if i else None) for i in range(60)] + [(5, 2 * i + 1, 2 * i) for i in range(60)]  # a comb
    rows += [(None, 1, None), (None, 2, 1)]
    deep = spark.createDataFrame([(*r, "user", "" if r[1] % 3 else None, float(r[1] % 2)) for r in rows], "tree long, node int, parent int, role string, text string, score double")
    got = {r.tree: r for r in chat.format_trees(deep).collect()}
    assert set(got) == {1, 3, 4, 5, None}
    assert (got[1].leaf, got[1].n_turns, got[3].leaf, got[3].n_turns, got[None].n_turns) == (99, 100, 1, 2, 2)
    assert got[4].reason == "answers go in a circle" and got[4].formatted is None and got[1].reason is None
    best = max(((i + 1 + 1, 1 / (i + 2), 2 * i + 1) for i in range(60)), key=lambda x: (x[1], -x[2]))
    assert (got[5].leaf, got[5].n_turns, round(got[5].score, 9)) == (best[2], best[0], round(best[1], 9))
    assert chat.format_trees(deep.limit(0)).count() == 0


# 9 -------------------------------------------------------------------------------------------------------------------


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text.lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def test_fingerprints_against_true_likeness(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "GROUP_ROWS", 60)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + [(100_001, None), (100_002, ""), (100_003, "one two"), (100_004, "one two"), (100_005, "é🎉日")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, next string").repartition(3)
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    order = sorted(((i, t or "") for i, t in rows), reverse=True)
    errors = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        for near, other in ((got[i].near_edited, edited), (got[i].near_next, after)):
            a, b = shingles(t), shingles(other)
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1.0))
    assert np.sqrt(np.mean(np.square(errors))) < 0.035 and abs(np.mean(errors)) < 0.01 and max(map(abs, errors)) < 0.15
    assert got[100_003].fingerprint == got[100_004].fingerprint != got[100_005].fingerprint
    assert fingerprint.edited_fingerprints(docs.limit(0)).count() == 0
    one = fingerprint.edited_fingerprints(docs.filter("doc_id = 100003")).first()
    assert one.near_next == 1.0
    assert fingerprint.edited_fingerprints(docs.filter("doc_id >= 100003").withColumn("doc_id", F.when(F.col("doc_id") > 100_003, F.col("doc_id")))).count() == 3


# 10 ------------------------------------------------------------------------------------------------------------------


def exhaustive(asked, prints, part):
    """All pairs of which some offset overlaps in enough frames, and that part of the query, with few enough bits apart: the least share of bits."""
    out = {}
    for q, a in asked.items():
        for c, b in prints.items():
            for offset in range(-len(a) + media.LEAST_FRAMES, len(b) - media.LEAST_FRAMES + 1):
                x, y = a[max(0, -offset) :], b[max(0, offset) :]
                n = min(len(x), len(y))
                if n >= max(media.LEAST_FRAMES, part * len(a)):
                    e = int(np.bitwise_count(np.asarray(x[:n], np.int64) ^ np.asarray(y[:n], np.int64)).sum()) / 32 / n
                    if e <= media.MOST_ERROR and e < out.get((q, c), 2):
                        out[q, c] = e
    return out


def test_audio_against_exhaustive_alignment(spark):
    rnd = np.random.default_rng(3)
    vectors = [rnd.normal(0, 1, 64) for _ in range(60)]
    df = spark.createDataFrame([(i * 10, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)
    made = media.fingerprint_media(media.recordings(df), id_col="vec_id", audio={"prints": "audio", "asked": "again"}).collect()
    prints, asked = {r.id: r.prints for r in made}, {r.id: r.asked for r in made if r.asked}
    want = exhaustive(asked, prints, 0)
    got = {r.id: json.loads(r.m) for r in media.search_recordings(media.recordings(df), id_col="vec_id").withColumn("m", F.to_json("matches")).collect()}
    found = {(q, m["class_id"]): m["bit_error"] for q in asked for m in got[q]}
    assert len(asked) == 12 and all((i, i) in found for i in asked)
    assert set(found) <= set(want) and len(found) >= 0.9 * len(want)  # by the operator's own rule, every overlap that it accepts
    assert all(abs(found[i, i] - want[i, i]) < 1e-5 for i in asked)
    assert all(not got[i] for i in prints if i not in asked)


def tone(seconds, hz, seed=None):
    t = np.arange(int(seconds * media.RATE)) / media.RATE
    x = 8000 * np.sin(2 * np.pi * hz * t)
    return (x + (0 if seed is None else np.random.default_rng(seed).normal(0, 40, len(t)))).astype("<i2").tobytes()


def test_odd_recordings(spark):
    rnd = np.random.default_rng(5)
    song, other = (media.melody(rnd.normal(0, 1, 64)) for _ in range(2))
    rows = [
        (1, song, None), (2, song, None), (None, song, None), (7, other, None), (7, song, media.excerpt(song)),  # copies; two recordings of one id
        (10, None, None), (11, b"", None), (12, b"\0\0\0", None), (None, None, None),  # without integers
        (20, tone(3, 440), tone(2, 440)), (21, b"\0" * 12_000, b"\0" * 9_000), (22, song + b"\0", None),  # a steady tone, silence, an odd byte
    ]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, audio binary, again binary, prints string, query int")
    got = media.search_recordings(df, id_col="vec_id").collect()
    by = defaultdict(list)
    for r in got:
        by[r.id].append(r)
    assert len(got) == len(rows)
    assert by[1][0].class_id == by[2][0].class_id == 1 and sorted(r.class_id for r in by[7]) == [1, 7] and by[22][0].class_id == 1
    assert [by[i][0].class_id for i in (10, 11, 12)] == [10, 11, 12] and sorted((r.class_id for r in by[None]), key=str) == [1, None]
    assert [m.class_id for r in by[7] for m in r.matches] == [1]
    assert [m.class_id for m in by[20][0].matches] == [20] and [m.class_id for m in by[21][0].matches] == [21]
    assert media.search_recordings(df.limit(0), id_col="vec_id").count() == 0


def test_keys_of_a_long_recording_take_linear_time(spark):
    runs = spark.range(3).select(F.array_repeat(F.lit(7).cast("long"), 50).alias("p")).select(media._runs(F.col("p")).alias("r")).first().r
    assert [(x.t, x.n) for x in runs] == [(0, 50 - media.KEY_STEP)]
    spent = []
    for n in (20_000, 80_000):
        df = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.pmod(F.xxhash64(x), F.lit(1 << 32))).alias("p")).select(F.size(media._runs(F.col("p"))).alias("n"))
        df.collect()
        start = time.perf_counter()
        assert df.first().n == n - media.KEY_STEP
        spent.append(time.perf_counter() - start)
    assert spent[1] < 9 * spent[0] + 1


def test_fingerprint_of_odd_audio():
    assert len(media.fingerprint(None)) == len(media.fingerprint(b"")) == len(media.fingerprint(b"\0\0\0")) == 0
    assert len(set(media.fingerprint(b"\0" * 40_000))) == 1


# ids beyond 2^53 -------------------------------------------------------------------------------------------------------


def long_ids(spark):
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["red", "green", "blue", "grey", "pink"]) + str(rnd.randint(0, 99)) for _ in range(12)) for _ in range(400)]
    rows = [(rnd.getrandbits(61) | 1 << 61 | 1, t, f"src{k % 3}") for k, t in enumerate(texts)] + [(None, "no id here", "src0"), (-(1 << 62) - 1, "below all", None)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1), rows


def test_next_of_long_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "GROUP_ROWS", 20)
    docs, rows = long_ids(spark)
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    assert len(got) == len(rows)
    for k, (i, t, _) in enumerate(order):
        after, half = order[(k + 1) % len(order)][1], len(t) // 2
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()
        assert got[i].near_next is not None and got[i].edited_fingerprint


@pytest.mark.parametrize("rows", [20, 1000])
def test_next_among_nulls_and_repeated_ids(spark, monkeypatch, rows):
    monkeypatch.setattr(fingerprint, "GROUP_ROWS", rows)
    rnd = random.Random(6)
    data = [((None, 7, -(1 << 62), (1 << 63) - 1, i)[min(rnd.randint(0, 9), 4)], rnd.getrandbits(63), i) for i in range(500)]
    docs = spark.createDataFrame(data, "doc_id long, tie long, n int").repartition(4)
    got = {r.n: r.next.n for r in fingerprint.next_documents(docs, ["n"]).collect()}
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    assert got == {r[2]: order[(k + 1) % len(order)][2] for k, r in enumerate(order)}


def test_long_ids_beside_a_null_stay_exact(spark, tmp_path):
    docs, rows = long_ids(spark)
    want = Counter(r[0] for r in rows)
    binary_output.write_token_ids(docs, str(tmp_path / "ids"), parts=1)
    for out in (tokens.token_counts(docs), packing.pack_documents(docs), binary_output.digest_documents(spark, str(tmp_path / "ids")), jaccard.jaccard_classes(docs), mixing.mix(docs, mixing.cycle_weights)):
        assert Counter(r.doc_id for r in out.collect()) == want
    pages = spark.createDataFrame([(9007199254740993, "https://a.com/"), (9007199254740995, "https://b.net/es/"), (None, None), (-(1 << 62) - 1, "x")], "page_id long, url string").coalesce(1)
    for most in (urls.MOST_BYTES, 0):
        judged = urls.judge(pages, spark.createDataFrame(urls.RULES, "rule string, verdict string"), most_bytes=most)
        assert {r.page_id for r in judged.collect()} == {9007199254740993, 9007199254740995, None, -(1 << 62) - 1}
