"""Operator 9: document fingerprints by one-permutation MinHash. DataFrame functions only.

Each word shingle is hashed once. The hash's upper bits choose one of 256 bins and the least hash of a bin stands for it.
An empty bin is filled by optimal densification: it tries bins in an order of its own, fixed for all documents, and copies
the first that is not empty. Of each bin the 8 lowest bits are stored, four bins in each word of 32 bits; the share of
equal bins, less what 8 bits agree on by chance, estimates the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

from random import Random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, constant, let, row_keys

BINS, BITS = 256, 8
SHINGLE = 5
#: Bins that an empty bin tries one by one before it looks through all that are filled.
TRIES = 12
#: A group of neighbouring documents has about so many rows, or more where that would make over MOST_GROUPS groups.
GROUP_ROWS = 1_000
MOST_GROUPS = 100_000


def _tried(attempt: int) -> Column:
    """The bins that are tried at an attempt, by empty bin: a pseudo-random order for each bin by a fixed rule."""
    orders = [Random(f"bin {b}").sample(range(BINS), TRIES) for b in range(BINS)]
    return constant([o[attempt] for o in orders], "int")


def shingle_hashes(text: Column) -> Column:
    """Hashes of all runs of five lower-cased words; of all words as one where there are fewer; none without words."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def runs(h: Column) -> Column:
        long_ = F.transform(F.slice(h, F.lit(1), F.size(h) - (SHINGLE - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, SHINGLE)]))
        short = F.array(F.aggregate(h, F.lit(SHINGLE).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(F.size(h) >= SHINGLE, long_).when(F.size(h) > 0, short).otherwise(F.array().cast("array<long>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def least_by_bin(hashes: Column) -> Column:
    """The least hash of each bin that has any, in the order of bins as signed numbers."""

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, 56) != F.shiftright(F.get(s, i - 1), 56)))

    return let(F.sort_array(hashes), firsts)


def packed(hashes: Column) -> Column:
    """All bins' low bits, densified, of the least hash of each bin that has any: an array of 64 words of 32 bits; empty for an empty set.

    A number for each filled bin (bin, low bits) and one for every bin (bin, a bit above those) are sorted together; what
    comes first of a bin says what it holds, or that it is empty.
    """
    empty, mask = 1 << BITS, (1 << BITS) - 1

    def numbers(least: Column) -> Column:
        return F.concat(F.transform(least, lambda x: F.shiftleft(F.shiftrightunsigned(x, 64 - 8), BITS + 1).bitwiseOR(x.bitwiseAND(F.lit(mask)))), constant([b << (BITS + 1) | empty for b in range(BINS)], "bigint"))

    def firsts(s: Column) -> Column:
        return F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, BITS + 1) != F.shiftright(F.get(s, i - 1), BITS + 1)))

    def fill(least: Column, d: Column) -> Column:
        def one(v: Column, b: Column) -> Column:
            tries = [F.get(d, F.get(_tried(t), b)) for t in range(TRIES)]
            # Then the filled bin that comes first by a hash: the rest of the empty bin's order.
            rest = F.array_min(F.transform(least, lambda x: F.struct(F.xxhash64(F.lit(13), b, F.shiftrightunsigned(x, 64 - 8)).alias("h"), x.bitwiseAND(F.lit(mask)).alias("x"))))["x"]
            return F.coalesce(v, *tries, rest)

        return F.transform(d, one)

    def words(full: Column) -> Column:
        per = 32 // BITS

        def word(k: Column) -> Column:
            out = F.get(full, k * per)
            for j in range(1, per):
                out = F.shiftleft(out, BITS).bitwiseOR(F.get(full, k * per + j))
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // per - 1)), word)

    def whole(least: Column) -> Column:
        dense = F.transform(let(F.sort_array(numbers(least)), firsts), lambda x: F.when(x.bitwiseAND(F.lit(empty)) == 0, x.bitwiseAND(F.lit(mask))))
        filled = let(dense, lambda d: F.when(F.size(least) == BINS, d).otherwise(fill(least, d)))
        return F.when(F.size(least) > 0, let(filled, words)).otherwise(F.array().cast("array<long>"))

    return let(hashes, whole)


def fingerprint_text(words: Column) -> Column:
    """A fingerprint as hexadecimal digits, two for each bin; empty for an empty set."""
    return F.array_join(F.transform(words, lambda w: F.lpad(F.lower(F.hex(w)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1: equal bins, corrected for chance.

    Two empty fingerprints are alike (1); an empty and another are not (0).
    """

    def unequal(x: Column) -> Column:  # bytes that aren't 0: or-ed into their lowest bit, and counted
        for shift in (4, 2, 1):
            x = x.bitwiseOR(F.shiftright(x, shift))
        return F.bit_count(x.bitwiseAND(F.lit(0x01010101)))

    differ = F.aggregate(F.zip_with(a, b, lambda x, y: unequal(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-BITS
    share = F.greatest(F.lit(0.0), (1 - differ / BINS - chance) / (1 - chance))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(share)


def fingerprints(df: DataFrame, text: Column, out: str) -> DataFrame:
    """Add the packed fingerprint of a text; a null text is empty. One pass, no shuffle."""
    return df.withColumn(out, packed(least_by_bin(shingle_hashes(F.coalesce(text, F.lit(""))))))


def next_documents(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Add ``next``, a struct of the columns ``carry`` of the next document by descending ``doc_id``; after the last the first.

    Equal ids are in the order of ``tie`` (0 or more, a hash of each row's own), rows of null id come last, in that order
    too. A single document is its own next.

    Ids are cut into groups at quantiles of all ids, so that a group has a bounded number of different ids; an id of very
    many rows, and null, is a group by itself that is cut at steps of ``tie``. So groups are in order, and of bounded
    size. Each group's first row, one row a group, is looked up and copied to the end of the group before it. One
    shuffle moves the rows, and each group is put in order by itself.
    """
    spark = docs.sparkSession
    n = docs.count()
    groups = max(1, min(MOST_GROUPS, n // GROUP_ROWS))
    size = max(GROUP_ROWS, -(-n // groups))
    ids = docs.groupBy("doc_id").count()
    quantiles = F.percentile_approx("doc_id", F.array(*[F.lit(i / groups) for i in range(1, groups + 1)]), F.lit(10 * groups + 100))
    found = docs.agg(quantiles.alias("b")).first()["b"] or []
    hot = {r["doc_id"]: -(-r["count"] // size) for r in ids.filter((F.col("count") > 2 * size) | F.col("doc_id").isNull()).collect()}  # fewer than groups
    named = {h for h in hot if h is not None}
    bounds = sorted({*found, *named, *(h - 1 for h in named if h > -(1 << 63)), (1 << 63) - 1})
    parts = [hot.get(None, 1), *(hot.get(b, 1) for b in bounds)]
    bases = [sum(parts[:k]) for k in range(len(parts))]
    array, last = constant(bounds, "bigint"), len(bounds) - 1

    def halve(s: Column, _: Column) -> Column:  # bisection for the first bound that isn't below the id
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get(array, mid) < F.col("doc_id")
        return F.struct(F.when((s["lo"] < s["hi"]) & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when((s["lo"] < s["hi"]) & ~below, mid).otherwise(s["hi"]).alias("hi"))

    state = F.struct(F.lit(0).alias("lo"), F.lit(last).alias("hi"))
    group = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit((last + 1).bit_length())), state, halve)["lo"] + 1)

    def cut(g: Column) -> Column:
        """The place of a group, or of the step of ``tie`` in it."""
        step = F.shiftright(F.shiftright("tie", 31) * F.get(constant(parts, "bigint"), g), 32)
        return F.get(constant(bases, "int"), g) + step.cast("int")

    placed = docs.withColumn("place", let(group, cut))
    ends = placed.select("place", "doc_id", "tie").groupBy("place").agg(F.max(F.struct("doc_id", "tie")).alias("m")).collect()
    ends = sorted((r["place"], r["m"]["doc_id"], r["m"]["tie"]) for r in ends)
    order_of = [e[0] for e in ends]
    table = [(p, id_, tie, order_of[(k + 1) % len(ends)], 1 if k + 1 < len(ends) else 2) for k, (p, id_, tie) in enumerate(ends)]
    first = F.broadcast(spark.createDataFrame(table, "place int, end_id long, end_tie long, to int, copy int"))  # a row a group
    met = placed.join(first, "place")
    is_end = F.col("doc_id").eqNullSafe(F.col("end_id")) & (F.col("tie") == F.col("end_tie"))
    own = F.struct(F.col("place").alias("place"), F.lit(0).alias("copy"))
    copies = F.when(is_end, F.array(own, F.struct(F.col("to").alias("place"), F.col("copy").alias("copy")))).otherwise(F.array(own))
    dealt = met.withColumn("at", F.explode(copies)).select(*docs.columns, "at.place", "at.copy")
    order = Window.partitionBy("place").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("tie"))
    return dealt.withColumn("next", F.lead(F.struct(*carry)).over(order)).filter("copy = 0").drop("place", "copy")


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text has the last half of the code points (rounded down) replaced by as many of the next document's first.
    A null text is empty; repeated rows are kept. Fingerprints are taken where the texts are read, before they move.
    Rows of one id, or of none, follow each other in an order of their places in the table.
    """
    keyed = row_keys(docs, "__row")
    text = F.coalesce(column(keyed, text_col, "string"), F.lit(""))
    tie = F.shiftrightunsigned(F.xxhash64("__row"), 1)
    rows = fingerprints(keyed.select(column(keyed, id_col, "long").alias("doc_id"), tie.alias("tie"), text.alias("text")), F.col("text"), "words")
    rows = next_documents(rows, ["text", "words"]).withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next.text", F.lit(1), half))
    rows = fingerprints(rows.withColumn("edited", edited), F.col("edited"), "edited_words")
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("words")).alias("fingerprint"), fingerprint_text(F.col("edited_words")).alias("edited_fingerprint"),
        likeness(F.col("words"), F.col("edited_words")).alias("near_edited"), likeness(F.col("words"), F.col("next.words")).alias("near_next"),
    )


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and their edited texts, with likeness to these and to the next document."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
