"""Operator 2: URL rules by a Bloom filter cascade.

A rule names a host, which stands for its subdomains too, and a beginning of the path. Each url has as many candidate
keys as it has domain levels and rule path lengths. For each list (block, allow) a cascade of Bloom filters is built
over all candidate keys of the corpus: the first level holds the listed keys, the second those other keys of the corpus
that pass the first, the third the listed keys that pass the second, and so on until none passes wrongly. For any key
of that corpus the first level that rejects it tells exactly whether it is listed, so urls are judged in one pass
without a join.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, constant, exact_ids, flagged

#: Bits and hashes for each key of a level.
BITS, HASHES = 10, 4
#: Bytes of filters that are sent to the tasks at most; beyond that, lists are joined.
MOST_BYTES = 64 << 20
MOST_LEVELS = 64
#: Different lengths of the rules' paths at most: each gives a candidate for each domain of a url.
MOST_LENGTHS = 1_000
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys by which a rule could fit, the longest first: domains of the host with beginnings of the path."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.filter(F.transform(constant(lengths, "int"), lambda n: F.when(F.length(path) >= n, F.substring(path, F.lit(1), n))), lambda p: p.isNotNull())
    keys = F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda p: F.struct((-F.length(d) - F.length(p)).alias("a"), (-F.length(d)).alias("b"), F.concat(d, p).alias("key")))))
    return F.when(F.length(host) > 0, F.transform(F.array_sort(keys), lambda x: x["key"])).otherwise(F.array().cast("array<string>"))


def positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Bit numbers of keys in a level: HASHES rows."""
    step = h2 | np.uint64(1)
    base = h1 ^ np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))
    return np.stack([((base + np.uint64(i) * step) >> np.uint64(11)) % np.uint64(bits) for i in range(HASHES)])


def passes(words: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """Whether keys pass a level."""
    p = positions(h1, h2, level, 64 * len(words))
    return ((words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1)).all(0)


def listed(levels: list[np.ndarray], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys of the corpus are listed: decided by the first level that rejects them."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    open_ = np.arange(len(h1))
    for k, words in enumerate(levels):
        ok = passes(words, h1[open_], h2[open_], k)
        out[open_[~ok]] = k % 2 == 1
        open_ = open_[ok]
    return out


def cascade(keys: DataFrame, work: Scratch, most_bytes: int = MOST_BYTES) -> list[np.ndarray] | None:
    """The levels for a table of all keys, ``h1, h2, on`` (whether listed); none if they would be above ``most_bytes``.

    Filters are merged from the tasks' words by a bitwise or; a level's size is checked before it is made.
    """
    keys = work.table(keys.select("h1", "h2", "on"), "cascade-keys")
    ours, others, levels, used = keys.filter("on"), keys.filter("not on"), [], 0
    while (n := ours.count()) > 0:
        size = -(-n * BITS // 64)
        used += 8 * size
        if used > most_bytes:
            return None
        if len(levels) == MOST_LEVELS:
            raise ValueError("two keys of the corpus have equal hashes")
        k = len(levels)

        def words(frames, k=k, size=size):
            for f in frames:
                p = positions(f["h1"].to_numpy().view(np.uint64), f["h2"].to_numpy().view(np.uint64), k, 64 * size).reshape(-1)
                at, place = np.unique(p >> np.uint64(6), return_inverse=True)
                bits = np.zeros(len(at), np.uint64)
                np.bitwise_or.at(bits, place.reshape(-1), np.uint64(1) << (p & np.uint64(63)))
                yield pd.DataFrame({"w": at.view(np.int64), "bits": bits.view(np.int64)})

        level = np.zeros(size, np.uint64)
        for r in ours.mapInPandas(words, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toLocalIterator():
            level[r["w"]] = np.int64(r["bits"]).view(np.uint64)
        levels.append(level)

        def wrong(frames, k=k, level=level):
            for f in frames:
                yield f[passes(level, f["h1"].to_numpy().view(np.uint64), f["h2"].to_numpy().view(np.uint64), k)]

        ours, others = work.table(others.mapInPandas(wrong, others.schema), "cascade-left"), ours
    return levels


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", most_bytes: int = MOST_BYTES) -> DataFrame:
    """``<id>, host, path, rule, verdict`` of every row.

    ``rules`` has ``rule`` (host and beginning of the path, as one string) and ``verdict`` (allow or block); repeated
    rules count once, and block wins where a rule is in both lists. The longest rule that fits wins, of equal ones that
    of the longer host; without one the verdict is ``default``. A null url fits none. Repeated rows are judged each.
    """
    spark = pages.sparkSession
    host, path = host_and_path(column(pages, url_col, "string"))
    rules = rules.filter("rule is not null").groupBy("rule").agg(F.max(F.col("verdict") == "block").alias("block"))
    lengths = sorted(r[0] for r in rules.select((F.length("rule") - F.length(F.regexp_extract("rule", "^[^/]*", 0))).alias("n")).distinct().limit(MOST_LENGTHS + 1).collect())
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"paths of rules have more than {MOST_LENGTHS} lengths")
    rows = pages.select(column(pages, id_col, "long").alias(id_col), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("keys", candidates(F.col("host"), F.col("path"), lengths))
    hashes = [F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2")]
    # Every key of the corpus once, with the lists it is in.
    none = F.lit(None).cast("boolean")
    universe = rows.select(F.explode("keys").alias("key"), none.alias("block")).union(rules.select(F.col("rule").alias("key"), "block")).groupBy("key").agg(F.max("block").alias("block"))
    with Scratch(spark, "urls") as work:
        universe = work.table(universe.select(*hashes, "block"), "keys")
        both = [cascade(universe.select("h1", "h2", F.coalesce(F.col("block") == want, F.lit(False)).alias("on")), work, most_bytes) for want in (True, False)]
    out = f"`{id_col}` long, host string, path string, rule string, verdict string"
    if None in both:  # lists too large to send: the keys meet the rules in a join
        keyed = rows.withColumn("row", F.monotonically_increasing_id()).select("row", id_col, "host", "path", F.posexplode_outer("keys").alias("at", "key"))
        hit = keyed.join(rules, keyed["key"] == rules["rule"], "left")
        best = hit.groupBy("row", id_col, "host", "path").agg(F.min_by(F.struct("rule", "block"), F.when(F.col("rule").isNotNull(), F.col("at"))).alias("best"))
        return best.select(id_col, "host", "path", "best.rule", F.when(F.col("best.block"), "block").when(F.col("best.rule").isNotNull(), "allow").otherwise(default).alias("verdict"))
    spread = spark.sparkContext.broadcast(both)

    def look_up(frames):
        block, allow = spread.value
        for f in frames:
            n = f["keys"].map(len).to_numpy()
            h1, h2 = (np.concatenate([*f[c], np.empty(0, np.int64)]).astype(np.int64).view(np.uint64) for c in ("h1", "h2"))
            bad, good = listed(block, h1, h2), listed(allow, h1, h2)
            rule: list[str | None] = [None] * len(f)
            verdict = [default] * len(f)
            row = np.repeat(np.arange(len(f)), n)
            place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            keys = f["keys"].tolist()
            for at in np.flatnonzero(bad | good)[::-1].tolist():  # the longest of a row comes last
                rule[row[at]], verdict[row[at]] = keys[row[at]][place[at]], "block" if bad[at] else "allow"
            yield pd.DataFrame({id_col: exact_ids(f, id_col), "host": f["host"], "path": f["path"], "rule": rule, "verdict": verdict})

    # Lambdas of one parameter only: Spark would give a second one the element's place.
    hashes = [F.transform("keys", lambda k: F.xxhash64(F.lit(1), k)).alias("h1"), F.transform("keys", lambda k: F.xxhash64(F.lit(2), k)).alias("h2")]
    return rows.select(*flagged(F.col(f"`{id_col}`"), id_col), "host", "path", "keys", *hashes).mapInPandas(look_up, out)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every url of ``pages`` judged by the five rules."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.createDataFrame(RULES, "rule string, verdict string"))


OP2_SQL = """
with p as (select page_id, case when position('://' in url) > 0 then substr(url, position('://' in url) + 3) else '' end as rest from pages),
q as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from p),
rules(rule, verdict, h, b) as (values ('com/', 'allow', 'com', '/'), ('example.com/en/', 'block', 'example.com', '/en/'), ('www.example.com/en/', 'allow', 'www.example.com', '/en/'), ('net/es/', 'block', 'net', '/es/'), ('net/fr/', 'block', 'net', '/fr/')),
fit as (select q.page_id, r.rule, r.verdict, row_number() over (partition by q.page_id order by length(r.rule) desc) as n from q join rules r on (q.host = r.h or ends_with(q.host, '.' || r.h)) and starts_with(q.path, r.b))
select q.page_id, coalesce(q.host, '') as host, coalesce(q.path, '') as path, f.rule, coalesce(f.verdict, 'allow') as verdict from q left join fit f on f.page_id = q.page_id and f.n = 1
"""
