"""Operator 11: phrase collocations from count streams in prefix and suffix order.

Texts become sequences of word numbers once; words too rare to be in any candidate, and the ends of pieces, break them.
Phrases are counted order by order: a phrase of n words is the number of its first n-1 words with its last word, so it
is one 64-bit number, exact and without hashing, and only places whose first and last n-1 words are both frequent are
counted at all. Tasks count what they hold by sorting it; these sorted runs are merged to the stream of an order, and a
phrase's number is its place in that stream. The stream of order n is then merged twice with that of order n-1, both
sorted: in prefix order, which gives the counts of all beginnings and the best extension to the right, and in suffix
order, which gives the counts of all endings and the best extension to the left.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ROWS_PER_TASK, TEXT_ROWS, Scratch, column, running_total, staged

#: Bytes that end a piece; one of them stands for all. Bytes of words beside them are lower-cased, A to Z only.
ENDS = b".,;:!?\n\x0b\x0c\r"
TO_STOP = bytes.maketrans(ENDS, b"." * len(ENDS))
#: Words, and phrases, that are looked up in one pass over the sequences; with more there are more passes.
WORDS_AT_ONCE, PHRASES_AT_ONCE = 1 << 18, 1 << 22
#: Different words, and places of phrases, that a task counts before it sends what it has.
HELD_WORDS, HELD = 1 << 18, 1 << 20
#: Words of one row of sequences, about: a Python worker gets a thousand rows at once.
ROW_WORDS = 1 << 14
#: Phrase numbers must fit 31 bits, to be halves of a 64-bit number.
MOST_PHRASES = 1 << 31


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, and a full stop wherever pieces end."""
    return text.encode().lower().translate(TO_STOP).replace(b".", b" . ").split() if text else []


def count_words(docs: DataFrame) -> DataFrame:
    """``lang, word, c`` of ``lang, text``, several rows for a word: what tasks have counted."""

    def count(batches):
        held: dict[str, Counter] = defaultdict(Counter)

        def send():
            for lang, c in held.items():
                c.pop(b".", None)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["lang", "word", "c"])
            held.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, TEXT_ROWS):
                part = batch.slice(at, TEXT_ROWS)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held[lang].update(tokens(text))
                if sum(map(len, held.values())) > HELD_WORDS:
                    yield from send()
        yield from send()

    return docs.mapInArrow(count, "lang string, word binary, c long")


def _rows(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
    """One row of sequences: arrays of numbers as bytes."""
    names = [f"s{i}" for i in range(len(parts))]
    return pa.RecordBatch.from_arrays([pa.array([np.concatenate(p).astype("<i4").tobytes()], pa.binary()) for p in parts], names)


def number_words(docs: DataFrame, words: DataFrame, n_words: int, work: Scratch) -> DataFrame:
    """Sequences of word numbers of all texts: ``s0``, rows of many texts one after the other, -1 where one breaks."""
    spark = docs.sparkSession
    now = docs.withColumn("ids", F.lit(None).cast("binary"))
    for low in range(0, max(1, n_words), WORDS_AT_ONCE):
        last = low + WORDS_AT_ONCE >= n_words
        chunk: dict[str, dict[bytes, int]] = defaultdict(dict)
        some = words.filter(F.col("id").between(low, low + WORDS_AT_ONCE - 1)).select("lang", "word", "id").toArrow()
        for lang, word, id_ in zip(*(c.to_pylist() for c in some.columns), strict=True):
            chunk[lang][word] = id_
        spread = spark.sparkContext.broadcast(dict(chunk))

        def number(batches, spread=spread, last=last):
            known = spread.value
            held, n = [], 0
            for batch in batches:
                for at in range(0, batch.num_rows, TEXT_ROWS):
                    part = batch.slice(at, TEXT_ROWS)
                    made = []
                    for lang, text, before in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                        found = tokens(text)
                        get = known.get(lang, {}).get
                        ids = np.fromiter((get(w, -1) for w in found), np.int32, len(found))
                        if before is not None:
                            ids = np.maximum(ids, np.frombuffer(before, "<i4"))
                        made.append(ids)
                    if not last:
                        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.astype("<i4").tobytes() for x in made], pa.binary())], ["lang", "text", "ids"])
                        continue
                    for ids in made:
                        held += [ids, np.array([-1], np.int32)]
                        n += len(ids) + 1
                        if n >= ROW_WORDS:
                            yield _rows([held])
                            held, n = [], 0
            if held:
                yield _rows([held])

        now = work.table(now.mapInArrow(number, "s0 binary" if last else "lang string, text string, ids binary"), "sequences")
    return now


def _arrays(batch: pa.RecordBatch) -> list[list[np.ndarray]]:
    return [[np.frombuffer(b, "<i4") for b in c.to_pylist()] for c in batch.columns]


def places(w: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where phrases of n words can stand: both their beginning and their end of n-1 words are frequent; and their numbers."""
    at = np.flatnonzero((g[:-1] >= 0) & (g[1:] >= 0)) if len(g) > 1 else np.empty(0, np.int64)
    return at, g[at].astype(np.int64) << 32 | w[at + n - 1]


def packed(numbers: np.ndarray, kind: str) -> bytes:
    """Whole numbers with their bytes of one weight together, which compress well: those of great weight are mostly 0."""
    return np.ascontiguousarray(numbers.astype(kind).view(np.uint8).reshape(len(numbers), -1).T).tobytes()


def unpacked(data: bytes, kind: str) -> np.ndarray:
    """The numbers that ``packed`` made bytes of."""
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def summed_run(keys: np.ndarray, ends: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sorted run: each key once, with its ending and the sum of its counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], ends[order[first]], np.add.reduceat(times[order], first) if len(keys) else times


def count_phrases(sequences: DataFrame, n: int, shares: int) -> DataFrame:
    """Sorted runs of what tasks have counted of phrases of n words, cut into ``shares``: ``share``, and keys, endings and counts packed.

    A run is a row for each share, and not one for each phrase.
    """

    def count(batches):
        keys, ends, held = [], [], 0

        def send():
            found, last = np.concatenate(keys), np.concatenate(ends)
            keys.clear()
            ends.clear()
            key, end, c = summed_run(found, last, np.ones(len(found), np.int32))
            share = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shares)).astype(np.int32)
            order = np.argsort(share, kind="stable")  # keys still ascend within a share
            cuts = np.searchsorted(share[order], np.arange(shares + 1))
            rows = []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                some = order[cuts[k] : cuts[k + 1]]
                rows.append((k, packed(np.diff(key[some], prepend=0), "<i8"), packed(end[some], "<i4"), packed(c[some], "<i4")))
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["share", "keys", "ends", "counts"])

        for batch in batches:
            parts = _arrays(batch)
            for w, g in zip(parts[0], parts[-1], strict=True):
                at, key = places(w, g, n)
                keys.append(key)
                ends.append(g[at + 1])
                held += len(at)
                if held > HELD:
                    yield send()
                    held = 0
        if held:
            yield send()

    return sequences.mapInArrow(count, "share int, keys binary, ends binary, counts binary")


def merged_runs(runs: DataFrame, least: int, parts: int) -> DataFrame:
    """``key, suffix, f`` of phrases that all runs together have ``least`` times or more: a share's runs are merged in one task as they come."""

    def merge(batches):
        held: dict[int, list[tuple]] = defaultdict(list)

        def merged_share(runs):
            return summed_run(*(np.concatenate(x) for x in zip(*runs, strict=True)))

        for batch in batches:
            for share, keys, ends, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = held[share]
                mine.append((np.cumsum(unpacked(keys, "<i8")), unpacked(ends, "<i4"), unpacked(counts, "<i4").astype(np.int64)))
                # Runs are summed whenever they have grown to twice what they were.
                if len(mine) > 2 and sum(len(r[0]) for r in mine[1:]) > max(HELD, len(mine[0][0])):
                    held[share] = [merged_share(mine)]
        for mine in held.values():
            key, end, f = merged_share(mine)
            often = f >= least
            yield pa.RecordBatch.from_arrays([pa.array(key[often]), pa.array(end[often]), pa.array(f[often])], ["key", "suffix", "f"])

    return runs.repartition(parts, "share").mapInArrow(merge, "key long, suffix int, f long")


def number_phrases(sequences: DataFrame, phrases: DataFrame, n_phrases: int, n: int, work: Scratch) -> DataFrame:
    """Sequences with the numbers of frequent phrases of n words (``s1``) beside the words, less all that no longer phrase needs."""
    spark = sequences.sparkSession
    for low in range(0, n_phrases, PHRASES_AT_ONCE):
        last = low + PHRASES_AT_ONCE >= n_phrases
        some = phrases.filter(F.col("id").between(low, low + PHRASES_AT_ONCE - 1)).select("key").toArrow()["key"].to_numpy()
        spread = spark.sparkContext.broadcast(np.sort(some))

        def number(batches, spread=spread, low=low, last=last):
            known = spread.value
            for batch in batches:
                parts = _arrays(batch)
                olds = parts[2] if len(parts) > 2 else [None] * len(parts[0])
                for w, g, old in zip(parts[0], parts[1] if len(parts) > 1 else parts[0], olds, strict=True):
                    at, key = places(w, g, n)
                    place = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    hit = known[place] == key
                    new = np.full(len(w), -1, np.int32) if old is None else old.copy()
                    new[at[hit]] = low + place[hit]
                    if not last:
                        yield _rows([[w], [g], [new]])
                        continue
                    # Words in a phrase of n + 1 stay, and one break after each run of them.
                    two = np.flatnonzero((new[:-1] >= 0) & (new[1:] >= 0)) if len(new) > 1 else np.empty(0, np.int64)
                    if not len(two):
                        continue
                    edge = np.zeros(len(w) + n + 2, np.int32)
                    np.add.at(edge, two, 1)
                    np.add.at(edge, two + n + 1, -1)
                    keep = np.cumsum(edge)[: len(w)] > 0
                    stay = keep.copy()
                    stay[1:] |= keep[:-1]
                    yield _rows([[np.where(keep, w, -1)[stay]], [np.where(keep, new, -1)[stay]]])

        sequences = work.table(sequences.mapInArrow(number, "s0 binary, s1 binary" + ", s2 binary" * (not last)), "sequences")
    return sequences


def merged(stream: DataFrame, shorter: DataFrame, longer: DataFrame | None) -> DataFrame:
    """One order's stream with what merging it in prefix and in suffix order gives.

    ``shorter`` (``id, phrase, lang, f, pre, suf``) is the order below, merged by its number twice: by the number of the
    beginning and by that of the ending. ``longer`` (``prefix, suffix, f``) is the order above, which comes grouped in
    either order. Both sides of every join are sorted; none is hashed into memory.
    """
    begin = shorter.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("head"), F.array_append("pre", F.col("f")).alias("pre"))
    end = shorter.select(F.col("id").alias("suffix"), F.substring_index("phrase", " ", -1).alias("word"), F.array_append("suf", F.col("f")).alias("suf"))
    out = stream.join(begin.hint("merge"), "prefix").join(end.hint("merge"), "suffix")
    out = out.select("id", F.concat_ws(" ", "head", "word").alias("phrase"), "lang", "f", "pre", "suf")
    if longer is None:
        return out.withColumn("extension", F.lit(0).cast("long"))
    right = longer.groupBy(F.col("prefix").alias("id")).agg(F.max("f").alias("right"))
    left = longer.groupBy(F.col("suffix").cast("long").alias("id")).agg(F.max("f").alias("left"))
    out = out.join(right.hint("merge"), "id", "left").join(left.hint("merge"), "id", "left")
    return out.select("id", "phrase", "lang", "f", "pre", "suf", F.coalesce(F.greatest("right", "left"), F.lit(0)).alias("extension"))


def lowest_cut(a: Column, n: Column, pre: Column, suf: Column) -> Column:
    """``score, k, l, r`` of the cut that scores least, of equal ones the first; whole numbers of up to 38 digits throughout."""
    top = a.cast("decimal(19,0)") * n.cast("decimal(19,0)") * F.lit(1000).cast("decimal(4,0)")

    def cut(left: Column, k: Column) -> Column:
        right = F.get(suf, F.size(suf) - 1 - k)
        return F.struct(F.call_function("div", top, left.cast("decimal(19,0)") * right.cast("decimal(19,0)")).alias("score"), (k + 1).alias("k"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(pre, cut))


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", longest: int = 5, least: int = 100, percent: int = 100, top: int | None = 2000) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score, cut`` of phrases of 2 to ``longest`` words that occur ``least`` times or more: a staged table.

    Everything is counted for each language (null: ``und``) over whole texts; a null text has no words. A phrase goes if
    a longer one that holds it has ``percent`` % of its count or more: the best extension by one word tells, since a phrase
    is as frequent as any that holds it. Repeated rows count each. Without texts, or frequent phrases, no rows. ``top``
    bounds a language's rows (None: all). Python workers hold ``WORDS_AT_ONCE`` words or ``PHRASES_AT_ONCE`` numbers at
    most; where more are frequent, passes over the sequences take them in turn.
    """
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(column(docs, lang_col, "string"), F.lit("und")).alias("lang"), column(docs, text_col, "string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one = F.lit(1).cast("long").alias("one")

    def numbered(stream: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
        stream = work.table(stream, name)
        n = stream.count()
        if n >= MOST_PHRASES:
            raise ValueError(f"{n} frequent phrases of one length: numbers have 31 bits; raise `least`")
        return work.table(running_total(stream.select("*", one), order, "one", "id", work, max(parts, n // ROWS_PER_TASK)).drop("one"), name), n

    with Scratch(spark, "phrases") as work:
        counted = work.table(count_words(docs).groupBy("lang", "word").agg(F.sum("c").alias("f")), "counted")
        totals = work.table(counted.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
        words, n_words = numbered(counted.filter(F.col("f") >= least), ["lang", "word"], "words")
        sequences = number_words(docs, words, n_words, work)
        streams: list[DataFrame] = []
        for n in range(2, longest + 1):
            stream, size = numbered(merged_runs(count_phrases(sequences, n, 4 * parts), least, parts), ["key"], "stream")
            if not size:
                break
            streams.append(stream)
            if n < longest:
                before, sequences = sequences, number_phrases(sequences, stream, size, n, work)
                work.drop(before)
        lower = words.select("id", F.col("word").cast("string").alias("phrase"), "lang", "f", F.array().cast("array<bigint>").alias("pre"), F.array().cast("array<bigint>").alias("suf"))
        streams = [s.select("id", F.shiftright("key", 32).alias("prefix"), F.col("suffix").cast("long").alias("suffix"), "f") for s in streams]
        found = None
        for at, stream in enumerate(streams):
            lower = work.table(merged(stream, lower, streams[at + 1] if at + 1 < len(streams) else None), "merged")
            kept = lower.filter(F.col("extension") * 100 < F.col("f") * percent)
            found = kept if found is None else found.unionByName(kept)
            lower = lower.drop("extension")
        if found is None:
            found = lower.filter("false")
        scored = found.join(totals, "lang").select("lang", "phrase", F.col("f").alias("a"), "n", lowest_cut(F.col("f"), F.col("n"), F.col("pre"), F.col("suf")).alias("c"))
        rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c.score"), F.desc("a"), "phrase")).cast("long")
        out = scored.select("lang", rank.alias("rank"), "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), "n", F.col("c.score").alias("score"), F.col("c.k").alias("cut"))
        return staged(out if top is None else out.filter(F.col("rank") <= top), "collocations")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's 2000 strongest collocations of ``documents``."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("cut")


_GRAMS = " union all ".join(f"select lang, {k} as k, array_to_string(list_slice(ws, i, i + {k - 1}), ' ') as phrase from (select lang, ws, unnest(range(1, len(ws) - {k - 2})) as i from p)" for k in range(1, 6))
OP11_SQL = f"""
with t as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece from documents where text is not null),
p as (select lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') as ws from t),
totals as (select lang, sum(len(ws))::bigint as n from p group by lang),
f as (select lang, k, phrase, count(*) as f from ({_GRAMS}) group by all having count(*) >= 100),
cuts as (select c.lang, c.phrase, c.k, c.f as a, unnest(range(1, c.k)) as cut from f c where c.k > 1),
scored as (select c.lang, c.phrase, c.k, c.a, c.cut, l.f as l, r.f as r, t.n, (1000::hugeint * c.a * t.n) // (l.f::hugeint * r.f) as score from cuts c join totals t using (lang)
  join f l on l.lang = c.lang and l.phrase = array_to_string(list_slice(string_split(c.phrase, ' '), 1, c.cut), ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(list_slice(string_split(c.phrase, ' '), c.cut + 1, c.k), ' ')),
best as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1),
kept as (select * from best b where not exists (select 1 from f x where x.lang = b.lang and x.k > b.k and contains(' ' || x.phrase || ' ', ' ' || b.phrase || ' ') and 100 * x.f >= 100 * b.a))
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score::bigint as score from kept qualify rank <= 2000
"""
