"""Operator 7: n-gram Jaccard join by T-occurrence search with DivideSkip.

A document is its set of distinct word shingles; two link when their sets' Jaccard similarity reaches a threshold.

1. Each task turns runs of documents ("batches" of about half a million shingles) into sets of 64-bit hashes. Shingles that
   a share of all documents hold ("heavy") are found first: batches report those frequent in them, and their sums
   bound how many there can be, whatever the number of documents. Heavy shingles rank last and are never gathered.
2. All other shingles go to buckets, by ranges of the hash, as packed arrays of whole hashes that name the batch and the
   document's place in it. A bucket's task learns in how many documents each occurs and answers each batch with those
   that occur again elsewhere. What no other document holds cannot be part of an overlap.
3. T-occurrence: a partner must share at least T of a document's n shingles, so it shares one of the n - T + 1 rarest.
   If that many are its own alone, it has no partner. Else its rarest others link it, over the shingle, to the least
   document that has the shingle among its rarest: components of this graph hold all links that are possible.
4. In each such component the sets are searched: short inverted lists are merged with a heap, long ones probed by
   binary search for the candidates, and pairs that reach the overlap link. Pairs that are already connected are passed
   over. Components too large for one task are cut into parts that are searched apart, with one common document; what
   is then not connected to that document is grouped anew by its rare shingles and searched against all that share one.
5. Components of the links give each document its class.

Nothing is capped or sampled. A shingle is known by 64 bits of a hash all the way, a whole set by 128; equal sets are one
class from step 3 on.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, exact_ids, flagged, staged
from .graph import components
from .hashing import SpanHasher
from .tokens import of_worker, text_groups

#: Shingles of one batch, and of one bucket, about.
BATCH = 500_000
BUCKET = 1_500_000
#: Shingles that one search task holds, about.
SEARCH = 4_000_000
#: A shingle is heavy from this share of the documents on (half of it by the batches' sums), and this number.
HEAVY_SHARE, HEAVY_LEAST = 1 / 256, 1024


class Shingler:
    """Hashes of word shingles, for many texts at once: differences of a polynomial prefix hash over the words' bytes."""

    def __init__(self, words: int = 5) -> None:
        self.words, self.hasher = words, SpanHasher()

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the sorted distinct hashes of its shingles; all words as one if they are fewer; none without words."""
        empty = np.empty(0, np.uint64)
        clean = [b" ".join(t.encode("utf-8", "surrogatepass").lower().split()) if t else b"" for t in texts]
        full = [c for c in clean if c]
        if not full:
            return [empty] * len(texts)
        data = np.frombuffer(b" ".join(full), np.uint8)
        gaps = np.flatnonzero(data == 32)
        starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(data)]))
        n = np.array([c.count(b" ") + 1 for c in full])
        m = np.maximum(1, n - self.words + 1)
        stops = np.cumsum(m)
        first = np.repeat(np.cumsum(n) - n - (stops - m), m) + np.arange(stops[-1])
        last = first + np.repeat(np.minimum(n, self.words) - 1, m)
        hashes = self.hasher.hashes(data, starts[first], ends[last])
        found = iter([np.unique(x) for x in np.split(hashes, stops[:-1])])
        return [next(found) if c else empty for c in clean]


def _batches(frames: Iterator[pd.DataFrame], words: int, batch: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and sets of runs of documents with about ``batch`` shingles (at least one document, at most 65,535)."""
    shingler: Shingler = of_worker(("shingler", words), lambda: Shingler(words))
    ids: list = []
    sets: list[np.ndarray] = []
    held = 0
    for frame in frames:
        keys = exact_ids(frame, "id")
        for some in text_groups(frame["text"], 500_000):
            for key, s in zip(keys.iloc[some].tolist(), shingler.sets(frame["text"].iloc[some].tolist()), strict=True):
                ids.append(None if key is pd.NA else key)
                sets.append(s)
                held += len(s)
                if held >= batch or len(ids) == 65_535:
                    yield ids, sets
                    ids, sets, held = [], [], 0
    if ids:
        yield ids, sets


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers byte by byte: all highest bytes first. Of sorted numbers these are runs, which compress."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(">u8").ravel().astype(np.uint64)


def _heavy(rows: DataFrame, work: Scratch, words: int, batch: int, share: float, least: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Heavy shingles, sorted, with their counts; the numbers of documents and shingles.

    A shingle in at least ``share`` of all documents is in at least half that share of some batches' documents, and
    those batches hold at least half of its occurrences. So at most ``2 / share`` times the mean size of a set are
    reported here, at any number of documents.
    """

    def report(frames):
        for ids, sets in _batches(frames, words, batch):
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= max(4, len(ids) * share / 2)
            v, c = values[often], counts[often]
            yield pd.DataFrame({"kind": [1] * len(v) + [0], "v": np.append(v.view(np.int64), len(values)), "c": np.append(c, len(ids))})

    table = work.table(rows.mapInPandas(report, "kind int, v long, c long"), "heavy")
    n_docs, n_shingles = table.filter("kind = 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    bar = max(least, n_docs * share / 2)
    rows_ = table.filter("kind = 1").groupBy("v").agg(F.sum("c").alias("c")).filter(F.col("c") >= bar).collect()
    values = np.array([r["v"] for r in rows_], np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], np.array([r["c"] for r in rows_], np.int64)[order], n_docs, n_shingles


def _sets(rows: DataFrame, work: Scratch, words: int, threshold: int, batch: int, bucket: int, share: float, least: int) -> DataFrame:
    """``doc_id, n, key, ids, rare`` of every document: ``ids`` are the shingles that others hold too, ``rare`` those of them
    among its n - T + 1 rarest; both null where no partner is possible. ``key`` is equal for equal sets."""
    heavy, heavy_counts, _, n_shingles = _heavy(rows, work, words, batch, share, least)
    buckets = max(1, -(-n_shingles // bucket))
    spark = rows.sparkSession
    spread = spark.sparkContext.broadcast((heavy, heavy_counts))  # bounded, see _heavy

    def deal(frames):
        heavy, _ = spread.value
        part = TaskContext.get().partitionId()
        for k, (ids, sets) in enumerate(_batches(frames, words, batch)):
            number = part << 32 | k
            n = np.array([len(s) for s in sets])
            key = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
            all_, place = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), n)
            common = np.zeros(len(all_), bool)
            if len(heavy) and len(all_):
                at = np.minimum(np.searchsorted(heavy, all_), len(heavy) - 1)
                common = heavy[at] == all_
            # The batch's own table passes through some bucket's task on its way back.
            yield pd.DataFrame({"bucket": [number % buckets], "batch": [number], "places": [place[common].tobytes()], "ids": [all_[common].tobytes()], "docs": [np.array([i or 0 for i in ids], np.int64).tobytes()], "nameless": [bytes(i is None for i in ids)], "n": [n.tolist()], "key": [key]})
            rest, place = all_[~common], place[~common]
            order = np.argsort(rest, kind="stable")
            rest, place = rest[order], place[order]
            to = (rest >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
            cuts = np.searchsorted(to, np.arange(buckets + 1, dtype=np.uint64))
            some = [b for b in range(buckets) if cuts[b + 1] > cuts[b]]
            span = [slice(cuts[b], cuts[b + 1]) for b in some]
            if some:
                none = [None] * len(some)
                yield pd.DataFrame({"bucket": some, "batch": number, "places": [place[x].tobytes() for x in span], "ids": [_planes(rest[x]) for x in span], "docs": none, "nameless": none, "n": none, "key": none})

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        heavy, heavy_counts = spread.value
        out = []
        own = frame["docs"].isna()
        for r in frame[~own].itertuples():
            ids = np.frombuffer(r.ids, np.uint64)
            counts = heavy_counts[np.searchsorted(heavy, ids)].astype(np.int64) if len(ids) else np.empty(0, np.int64)
            out.append((r.batch, r.places, r.ids, counts.tobytes(), r.docs, r.nameless, r.n, r.key))
        posts = frame[own]
        if len(posts):
            ids = np.concatenate([_from_planes(x) for x in posts["ids"]])
            order = np.argsort(ids, kind="stable")
            run = np.append(True, ids[order][1:] != ids[order][:-1])
            count = np.diff(np.append(np.flatnonzero(run), len(ids)))
            counts = np.empty(len(ids), np.int64)
            counts[order] = np.repeat(count, count)
            at = 0
            for r in posts.itertuples():
                places = np.frombuffer(r.places, np.uint16)
                c, f = counts[at : at + len(places)], ids[at : at + len(places)]
                at += len(places)
                if (again := c > 1).any():
                    out.append((r.batch, places[again].tobytes(), f[again].tobytes(), c[again].tobytes(), None, None, None, None))
        return pd.DataFrame(out, columns=["batch", "places", "ids", "counts", "docs", "nameless", "n", "key"])

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        table = frame[~frame["docs"].isna()].iloc[0]
        n = np.asarray(table["n"], np.int64)
        places = np.frombuffer(b"".join(frame["places"]), np.uint16)
        ids, counts = np.frombuffer(b"".join(frame["ids"]), np.uint64), np.frombuffer(b"".join(frame["counts"]), np.int64)
        order = np.lexsort((ids, counts, places))
        places, ids = places[order], ids[order].view(np.int64)
        cuts = np.searchsorted(places, np.arange(len(n) + 1))
        shared = np.diff(cuts)
        need = -(-threshold * n // 100)  # T: the least overlap with any partner
        rare = (n - need + 1) - (n - shared)  # how many of the n - T + 1 rarest others hold too
        may = (rare > 0) & (n > 0)
        kept = [ids[cuts[i] : cuts[i + 1]] if may[i] else None for i in range(len(n))]
        return pd.DataFrame({
            "doc_id": pd.Series(np.frombuffer(table["docs"], np.int64), dtype="Int64").mask(np.frombuffer(table["nameless"], bool)), "n": n, "key": [table["key"][16 * i : 16 * i + 16] for i in range(len(n))],
            "ids": [None if x is None else np.sort(x).tobytes() for x in kept], "rare": [None if x is None else x[: rare[i]] for i, x in enumerate(kept)],
        })

    sent = "bucket int, batch long, places binary, ids binary, docs binary, nameless binary, n array<long>, key binary"
    got = "batch long, places binary, ids binary, counts binary, docs binary, nameless binary, n array<long>, key binary"
    answers = rows.mapInPandas(deal, sent).groupBy("bucket").applyInPandas(learn, got)
    return work.table(answers.groupBy("batch").applyInPandas(choose, "doc_id long, n long, key binary, ids binary, rare array<long>"), "sets")


class Links:
    """Union-find over places in a list."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((i, j))


def search(sizes: np.ndarray, sets: list[np.ndarray], threshold: int, queries: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (pairs of places) that connect all that is linked, by T-occurrence search.

    ``sets`` hold a document's shingles as far as another has them, ``sizes`` the full number. With ``queries``, these are
    searched against all; without, all are searched: one first, then each that is not connected to it.
    """
    if len(sets) < 2:
        return []
    order = np.argsort(sizes, kind="stable")
    size = [int(sizes[i]) for i in order]
    lengths = np.array([len(sets[i]) for i in order])
    tokens = np.concatenate([sets[i] for i in order])
    owner = np.repeat(np.arange(len(order)), lengths)
    by = np.argsort(tokens, kind="stable")
    run = np.append(True, tokens[by][1:] != tokens[by][:-1]) if len(by) else np.empty(0, bool)
    number = np.empty(len(tokens), np.int64)
    number[by] = np.cumsum(run) - 1
    begin = np.append(np.flatnonzero(run), len(tokens))
    length = np.diff(begin)
    posts = owner[by].tolist()
    begins = begin.tolist()
    cuts = np.append(0, np.cumsum(lengths))
    links = Links(len(order))
    of_100 = 100 + threshold

    def query(r: int) -> None:
        own = number[cuts[r] : cuts[r + 1]]
        own = own[length[own] > 1]
        n = size[r]
        need = -(-threshold * n // 100)
        if len(own) < need:
            return
        own = own[np.argsort(length[own], kind="stable")].tolist()
        n_short = len(own) - (need - 1)  # all but T - 1 lists are short: a partner is in one of them at least
        short, long_ = own[:n_short], own[n_short:]
        low, high = bisect_left(size, -(-threshold * n // 100)), bisect_left(size, 100 * n // threshold + 1)
        lists = [posts[bisect_left(posts, low, begins[k], begins[k + 1]) : bisect_left(posts, high, begins[k], begins[k + 1])] for k in short]
        before, count = -1, 0

        def settle(s: int, count: int) -> None:
            """Probe the long lists for a candidate, as long as it can still reach the overlap."""
            if s == r or links.root(s) == links.root(r):
                return
            least = -(-threshold * (n + size[s]) // of_100)
            open_ = len(long_)
            for k in reversed(long_):
                if count >= least or count + open_ < least:
                    break
                open_ -= 1
                at = bisect_left(posts, s, begins[k], begins[k + 1])
                if at < begins[k + 1] and posts[at] == s:
                    count += 1
            if count >= least:
                links.join(r, s)

        for s in heapq.merge(*lists):
            if s == before:
                count += 1
                continue
            if before >= 0:
                settle(before, count)
            before, count = s, 1
        if before >= 0:
            settle(before, count)

    if queries is not None:
        wanted = set(queries)
        for r in range(len(order)):
            if int(order[r]) in wanted:
                query(r)
    else:
        first = len(order) // 2
        query(first)
        for r in range(len(order)):
            if r != first and links.root(r) != links.root(first):
                query(r)
    return [(int(order[a]), int(order[b])) for a, b in links.edges]


def _search_all(frame: pd.DataFrame, threshold: int) -> pd.DataFrame:
    """Links in each group of a frame of rows ``g, key, n, ids, asks``."""
    a: list[bytes] = []
    b: list[bytes] = []
    for _, group in frame.groupby("g", sort=False):
        keys = group["key"].tolist()
        sets = [np.frombuffer(x, np.int64) for x in group["ids"]]
        asks = group["asks"].to_numpy()
        for i, j in search(group["n"].to_numpy(), sets, threshold, None if asks.all() else np.flatnonzero(asks).tolist()):
            a.append(keys[i])
            b.append(keys[j])
    return pd.DataFrame({"a": a, "b": b})


def _grouped(rows: DataFrame, work: Scratch, threshold: int, room: int) -> DataFrame:
    """Links inside groups ``g`` of rows ``g, key, n, ids, asks``: rows that ask are searched against all of their group.

    Groups of up to ``room`` shingles share tasks. Of a larger one, the rows that ask are dealt over blocks, all rows over
    chunks, and each block meets each chunk. What has one row for a group is staged before the group's rows meet it, so
    that adaptive execution splits the rows of a large group.
    """
    tokens = F.octet_length("ids") / 8
    sizes = rows.groupBy("g").agg(F.sum(tokens).cast("long").alias("tokens"), F.ceil(F.sum(F.when(F.col("asks"), tokens).otherwise(0)) / room).cast("int").alias("blocks"))
    sizes = work.table(sizes.withColumn("chunks", F.ceil(F.col("tokens") / room).cast("int")), "sizes")
    total = sizes.filter("chunks = 1").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    bins = max(1, -(-2 * total // room))
    rows = rows.join(sizes, "g")
    pick = ["task", "g", "key", "n", "ids", "asks"]
    small = rows.filter("chunks = 1").withColumn("task", F.concat(F.lit("s"), F.pmod(F.xxhash64("g"), F.lit(bins)).cast("string"))).select(*pick)
    large = rows.filter("chunks > 1").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")).cast("int")).withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
    asked = large.filter("asks").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    there = large.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(False))
    task = F.concat_ws("-", F.lit("l"), F.hex("g"), "chunk", "block")
    return small.unionByName(asked.unionByName(there).withColumn("task", task).select(*pick)).groupBy("task").applyInPandas(lambda frame: _search_all(frame, threshold), "a binary, b binary")


def _links(classes: DataFrame, work: Scratch, threshold: int, room: int) -> DataFrame:
    """Links (``a``, ``b``: keys) that connect what is linked, from classes ``key, n, ids, rare``.

    Groups of possible partners that are too large for a task are searched twice. First in chunks, each with the group's
    least document: most of a large group of near copies is connected then. What isn't ("open") is grouped anew, by the
    rare shingles that open documents share with each other, and to each new group come the connected documents that
    share such a shingle with one of its open documents: no other pair can link that isn't connected already.
    """
    posts = classes.select("key", F.explode("rare").alias("id"))
    hubs = work.table(posts.groupBy("id").agg(F.min("key").alias("hub"), F.max("key").alias("last")).filter(F.col("hub") != F.col("last")).select("id", "hub"), "hubs")
    near = work.table(components(posts.join(hubs, "id").filter(F.col("key") != F.col("hub")).select(F.col("key").alias("a"), F.col("hub").alias("b")), work), "near")
    rows = work.table(classes.join(near, F.col("key") == F.col("node")).select("key", "n", "ids", F.col("root").alias("g")), "groups")
    sizes = work.table(rows.groupBy("g").agg(F.ceil(F.sum(F.octet_length("ids")) / (8 * room)).cast("int").alias("parts")), "parts")
    rows = rows.join(sizes, "g")
    whole = rows.select("g", "key", "n", "ids", F.lit(True).alias("asks"))
    if sizes.agg(F.max("parts")).first()[0] in (None, 1):
        return _grouped(whole, work, threshold, room)
    # A part's name is the group's and its number; the group's least document, whose key is its name, is in all of them.
    numbers = F.when(F.col("key") == F.col("g"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")))
    parts = rows.withColumn("part", F.explode(numbers)).select(F.encode(F.concat_ws("-", F.hex("g"), "part"), "utf-8").alias("g"), "key", "n", "ids")
    first = work.table(_grouped(parts.withColumn("asks", F.lit(True)), work, threshold, 4 * room), "first")
    label = work.table(components(first, work), "label").select("node", F.col("root").alias("label"))
    # Labels are least keys, so what is connected to the group's least document has its key as label.
    seen = rows.filter("parts > 1").join(label, F.col("key") == F.col("node"), "left")
    seen = work.table(seen.select("key", "n", "ids", (F.coalesce("label", "key") != F.col("g")).alias("asks")), "seen")
    posts = work.table(seen.select("key", "asks").join(posts, "key"), "posts")
    hubs = work.table(posts.filter("asks").groupBy("id").agg(F.min("key").alias("hub")), "hubs")
    near = work.table(components(posts.filter("asks").join(hubs, "id").filter(F.col("key") != F.col("hub")).select(F.col("key").alias("a"), F.col("hub").alias("b")), work), "near")
    named = work.table(hubs.join(near, F.col("hub") == F.col("node"), "left").select("id", F.coalesce("root", "hub").alias("g")), "named")
    members = work.table(posts.join(named, "id").select("g", "key").distinct(), "members")
    return first.union(_grouped(members.join(seen, "key").select("g", "key", "n", "ids", "asks"), work, threshold, room))


#: The bit that turns signed numbers into unsigned ones of the same order.
_SIGN = -(1 << 63)


def _named(key: Column, least: Column) -> Column:
    """A class's key with its least id before it, so that keys are in the order of ids, classes without an id last."""
    number = F.unhex(F.lpad(F.hex(F.coalesce(least, F.lit(0)).bitwiseXOR(F.lit(_SIGN))), 16, "0"))
    return F.concat(F.when(least.isNull(), F.lit(b"\x01")).otherwise(F.lit(b"\x00")), number, key)


def _id_of(name: Column) -> Column:
    number = F.conv(F.hex(F.substring(name, 2, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(_SIGN))
    return F.when(F.hex(F.substring(name, 1, 1)) == "00", number)


def jaccard_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: int = 80, batch: int = BATCH, bucket: int = BUCKET, room: int = SEARCH, heavy: tuple[float, int] = (HEAVY_SHARE, HEAVY_LEAST)) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row, a staged table.

    Words are lower-cased (A-Z) and split at ASCII white space; a set has the distinct runs of ``words`` words, or all
    words as one where they are fewer. Two documents link at ``threshold`` percent; ``component_id`` is the smallest id
    that links reach. Without words, or for null, the set is empty and links with nothing, so that the component is the
    document itself. Repeated rows are in one component; rows of null id count but never name one.
    """
    rows = docs.select(*flagged(column(docs, id_col, "long"), "id"), column(docs, text_col, "string").alias("text"))
    with Scratch(docs.sparkSession, "jaccard") as work:
        sets = _sets(rows, work, words, threshold, batch, bucket, *heavy)
        classes = sets.filter(F.col("rare").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("ids").alias("ids"), F.first("rare").alias("rare"))
        classes = work.table(classes.select(F.col("key").alias("set"), _named(F.col("key"), F.col("least")).alias("key"), "n", "ids", "rare"), "classes")
        links = work.table(_links(classes.drop("set"), work, threshold, room), "found")
        root = work.table(components(links, work), "roots")
        known = classes.select("set", "key").join(root, F.col("key") == F.col("node"), "left").select(F.col("set").alias("key"), F.coalesce("root", "key").alias("root"))
        known = work.table(known, "known")
        out = sets.select("doc_id", F.col("n").alias("n_shingles"), "key").join(known, "key", "left")
        return staged(out.select("doc_id", "n_shingles", F.when(F.col("root").isNotNull(), _id_of(F.col("root"))).otherwise(F.col("doc_id")).alias("component_id")), "jaccard-classes")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` that link at Jaccard 0.8 over shingles of five words."""
    return jaccard_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, unnest(list_distinct(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end)) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(doc_id, root) as (select a, a from e union select e.b, r.root from r join e on r.doc_id = e.a where r.root < e.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(min(r.root), d.doc_id)) as component_id from documents d left join n using (doc_id) left join r on r.doc_id = d.doc_id group by d.doc_id, n.n
"""
