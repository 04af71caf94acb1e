"""Operator 4: language ID by error-correcting output codes.

Each language has a codeword of bits. A binary classifier for each bit is a vector of log odds of hashed character
n-grams (1 to 3 characters of the lower-cased text, runs of other characters as one break) between the languages whose
bit is set and the others. A text's margins, one for each bit, are held against every codeword: the language of least
weighted exponential loss wins, and where the runner-up is close the result is flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT_ROWS, column
from .tokens import of_worker, text_groups

#: Hash values of n-grams.
BINS = 1 << 15
ORDERS = (1, 2, 3)
#: Labelled documents learned from, at most about so many for each language (chosen by a hash of id and text, among so many values).
SAMPLE = 4_000
SHARES = 1 << 40
#: Languages that can be learned at most.
MOST_LANGUAGES = 256
#: Characters of texts that are handled at once.
GROUP_CHARS = 150_000
UNKNOWN = "und"


def codewords(k: int) -> np.ndarray:
    """Rows of +1 and -1: all distinct splits of up to 5 languages in two; for more, spread random rows, fixed by seed."""
    if k <= 5:
        rows = [(1, *x) for x in product((1, -1), repeat=k - 1) if -1 in x]
        return np.array(rows, np.int8).T.reshape(k, -1)
    n = 8 * int(np.ceil(np.log2(k)))
    best, least = None, -1
    for seed in range(64):
        m = np.where(np.random.default_rng(seed).random((k, n)) < 0.5, 1, -1).astype(np.int8)
        apart = min(int((m[i] != m[j]).sum()) for i in range(k) for j in range(i))
        if apart > least and (np.abs(m.sum(0)) < k).all():
            best, least = m, apart
    return best


class Grams:
    """Hashed n-grams of many texts at once."""

    def __init__(self) -> None:
        self.letter = np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.bool_)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hash values of all n-grams, text after text, and each text's number of them (0: no letter)."""
        lower = [t.lower() if t else "" for t in texts]
        codes = np.frombuffer("".join([f"\0{t}\0" for t in lower]).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = self.letter[np.minimum(codes, 0x10FFFF)]
        owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in lower])
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of each run of other characters after a letter is a break
        keep[:-1] |= letter[1:] & ~letter[:-1] & (owner[1:] == owner[:-1]) & np.append(True, ~letter[:-2])[: len(letter) - 1]
        codes, letter, owner = np.where(letter, codes, 1)[keep].astype(np.uint64), letter[keep], owner[keep]
        values, owners = [], []
        h = np.zeros(len(codes), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            if len(codes) < n:
                break
            h = h[: len(codes) - n + 1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            if n in ORDERS:
                one = owner[: len(h)] == owner[n - 1 :]
                real = letter[: len(h)] if n == 1 else one
                v = ((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BINS.bit_length() + 1)
                values.append(v[real & one].astype(np.int64))
                owners.append(owner[: len(h)][real & one])
        if not values:
            return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
        by = np.argsort(np.concatenate(owners), kind="stable")
        return np.concatenate(values)[by], np.bincount(np.concatenate(owners), minlength=len(texts))


@dataclass
class Model:
    """What is learned: languages, their codewords, the bits' log odds by n-gram, thresholds, scales and weights."""

    languages: list[str]
    code: np.ndarray
    odds: np.ndarray
    middle: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    @classmethod
    def fit(cls, languages: list[str], counts: np.ndarray) -> Model:
        """From the counts of n-grams by language (languages x BINS)."""
        code = codewords(len(languages))
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)  # every language counts alike
        odds = np.stack([np.log(share[code[:, b] > 0].mean(0)) - np.log(share[code[:, b] < 0].mean(0)) for b in range(code.shape[1])], 1) if code.size else np.zeros((BINS, 0))
        seen = share @ odds  # mean margin of each language's own text, by bit
        low = np.array([seen[code[:, b] > 0, b].min() for b in range(code.shape[1])])
        high = np.array([seen[code[:, b] < 0, b].max() for b in range(code.shape[1])])
        gap = np.maximum(low - high, 1e-6)
        return cls(languages, code.astype(float), odds, (low + high) / 2, 4 / gap, gap / max(gap.sum(), 1e-12))

    def predict(self, values: np.ndarray, lengths: np.ndarray, ambiguous: float) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and ambiguity of texts from their n-grams."""
        n = len(lengths)
        if not self.languages:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
        sums = np.zeros((n, self.odds.shape[1]))
        full = np.flatnonzero(lengths)
        if len(full) and self.odds.shape[1]:
            starts = np.cumsum(lengths[full]) - lengths[full]
            sums[full] = np.add.reduceat(self.odds[values], starts, axis=0)
        margin = np.clip((sums / np.maximum(lengths, 1)[:, None] - self.middle) * self.scale, -20, 20)
        loss = np.stack([(self.weight * np.exp(-margin * word)).sum(1) for word in self.code], 1)
        chance = 1 / np.maximum(loss, 1e-12)
        chance /= chance.sum(1, keepdims=True)
        best = chance.argmax(1)
        score = chance[np.arange(n), best]
        second = np.sort(chance, 1)[:, -2] if len(self.languages) > 1 else np.zeros(n)
        known = lengths > 0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, score, 0.0), known & (score - second < ambiguous)


def held_out(id_: Column) -> Column:
    """Whether a document is set aside: crc32 of its id as text, mod 4, is 2; not for null."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def fit_languages(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", learn: Column, order: Column, sample: int = SAMPLE) -> Model:
    """Learn from the rows for which ``learn`` holds, with text and language, at most about ``sample`` a language.

    Rows are chosen by ``order`` (a hash, long) below a share that is counted for each language; the rows of a language's
    least hash are always among them, so none goes unlearned. A language without a letter in what was chosen is left out.
    Only the languages' n-gram counts, ``BINS`` numbers each, come to the driver; over ``MOST_LANGUAGES`` it refuses.
    """
    rows = docs.select(column(docs, text_col, "string").alias("text"), column(docs, lang_col, "string").alias("lang"), learn.alias("learn"), F.pmod(order, F.lit(SHARES)).alias("h")).filter("learn and lang is not null and text is not null")
    sizes = {r["lang"]: (r["n"], r["least"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], *[np.zeros((0, 0))] * 2, *[np.zeros(0)] * 3)
    bars = docs.sparkSession.createDataFrame([(x, min(SHARES, max(least + 1, sample * SHARES // n))) for x, (n, least) in sorted(sizes.items())], "lang string, bar long")
    chosen = rows.join(F.broadcast(bars), "lang").filter(F.col("h") < F.col("bar")).select("lang", "text")

    def count(frames):
        grams: Grams = of_worker(("grams",), Grams)
        total: dict[str, np.ndarray] = {}
        for frame in frames:
            for some in text_groups(frame["text"], GROUP_CHARS):
                values, lengths = grams.of(frame["text"].iloc[some].tolist())
                langs = np.repeat(frame["lang"].iloc[some].to_numpy(), lengths)
                for x in set(langs):
                    total[x] = total.get(x, 0) + np.bincount(values[langs == x], minlength=BINS)
        for x, c in total.items():
            at = np.flatnonzero(c)
            yield pd.DataFrame({"lang": x, "bin": at, "c": c[at]})

    counts = np.zeros((len(languages), BINS))
    place = {x: i for i, x in enumerate(languages)}
    for r in chosen.mapInPandas(count, "lang string, bin int, c long").groupBy("lang", "bin").agg(F.sum("c").alias("c")).toLocalIterator():
        counts[place[r["lang"]], r["bin"]] = r["c"]
    some = counts.sum(1) > 0
    return Model.fit([x for x, k in zip(languages, some, strict=True) if k], counts[some])


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", ambiguous: float = 0.1, keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred``, ``score`` (0 to 1) and ``ambiguous`` to the columns ``keep`` (default: all) of every row.

    A null text, or one without a letter, is ``und`` with score 0. Nothing but the text is used. Whole texts, one pass,
    no shuffle; columns of these three names are replaced.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score", "ambiguous")]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], column(docs, text_col, "string").alias("__text"))

    def judge(batches):
        import pyarrow as pa

        grams: Grams = of_worker(("grams",), Grams)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXT_ROWS):
                batch = whole.slice(at, TEXT_ROWS)
                texts = pd.Series(batch.column(batch.num_columns - 1).to_pylist(), dtype=object)
                langs: list[str] = []
                scores, flags = [np.empty(0)], [np.empty(0, bool)]
                for some in text_groups(texts, GROUP_CHARS):
                    a, b, c = spread.value.predict(*grams.of(texts.iloc[some].tolist()), ambiguous)
                    langs += a
                    scores.append(b)
                    flags.append(c)
                out = [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(flags))]
                yield pa.RecordBatch.from_arrays(out, [*batch.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    from pyspark.sql import types as T

    fields = [*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return rows.mapInArrow(judge, T.StructType(fields))


def learned(docs: DataFrame) -> Model:
    """The model of the documents that are not held out."""
    id_ = column(docs, "doc_id", "long")
    return fit_languages(docs, learn=id_.isNotNull() & ~held_out(id_), order=F.xxhash64(id_, column(docs, "text", "string")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), learned(docs), keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
