"""Operator 10: media columns, by chroma audio fingerprints.

A recording (a binary column of 16-bit samples) becomes frames of the power of the twelve pitch classes. Rectangular
filters are laid over these frames with an integral image; each filter's answer is rounded to two bits, and sixteen
filters make one packed integer for each frame. To align recordings, integers that both hold (two at a fixed distance,
to be rare) vote for an offset; at each offset with enough votes the bits that differ are counted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, flagged, let, staged

RATE = 2000
FRAME, HOP = 512, 64
#: Frames that the widest filter covers.
WIDEST = 12
#: Sixteen filters by rule: kind, first pitch class, height, width in frames.
FILTERS = [(i % 6, (i * 7) % (12 - h + 1), h, (4, 8, WIDEST)[i % 3]) for i in range(16) for h in [2 + (i * 5) % 9]]
#: Distance of the two integers of a key, and the votes that an offset needs.
KEY_STEP, VOTES = 3, 2
#: Frames that an overlap must have, and the share of bits that may differ. Overlaps of up to some 22 frames of different
#: recordings come below that share by chance.
LEAST_FRAMES, MOST_ERROR = 32, 0.25


def chroma(samples: np.ndarray, rate: int = RATE) -> np.ndarray:
    """Frames of the twelve pitch classes' power, smoothed and scaled to length 1; silent frames are 0."""
    n = (len(samples) - FRAME) // HOP + 1
    if n < 1:
        return np.zeros((0, 12))
    hz = np.fft.rfftfreq(FRAME, 1 / rate)
    use = np.flatnonzero((hz > 100) & (hz < 0.45 * rate))
    to = np.zeros((len(use), 12))
    to[np.arange(len(use)), np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12] = 1
    window, out = np.hanning(FRAME), np.empty((n, 12))
    view = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    for at in range(0, n, 2048):  # a long recording in parts
        power = np.abs(np.fft.rfft(view[at : at + 2048] * window, axis=1)[:, use]) ** 2
        out[at : at + 2048] = power @ to
    padded = np.pad(out, ((2, 2), (0, 0)), "edge")
    smooth = sum(w * padded[k : k + n] for k, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    norm = np.sqrt((smooth**2).sum(1, keepdims=True))
    return np.where(norm > 1e-3, smooth / np.maximum(norm, 1e-12), 0.0)


def packed_integers(frames: np.ndarray) -> np.ndarray:
    """One unsigned 32-bit integer for each frame but the last WIDEST - 1."""
    n = len(frames) - WIDEST + 1
    if n < 1:
        return np.empty(0, np.uint32)
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0: int, y0: int, t1: int, y1: int) -> np.ndarray:
        return image[t + t1, y1] - image[t + t0, y1] - image[t + t1, y0] + image[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for i, (kind, y, h, w) in enumerate(FILTERS):
        whole, y2, y3, w2, w3 = area(0, y, w, y + h), y + h // 2, max(1, h // 3), w // 2, max(1, w // 3)
        if kind == 0:  # the band against all pitch classes
            a = whole * (12 - h) / h
            b = area(0, 0, w, 12) - whole
        elif kind == 1:  # lower against upper half
            a = area(0, y, w, y2)
            b = whole - a
        elif kind == 2:  # first against second half
            a = area(0, y, w2, y + h)
            b = whole - a
        elif kind == 3:  # opposite quarters
            a = area(0, y, w2, y2) + area(w2, y2, w, y + h)
            b = whole - a
        elif kind == 4:  # middle pitches against the others
            a = area(0, y + y3, w, y + h - y3) if h > 2 * y3 else area(0, y, w, y + 1)
            b = whole - a
        else:  # middle frames against the others
            a = area(w3, y, w - w3, y + h)
            b = whole - a
        answer = np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0))
        level = (answer > -0.25).astype(np.uint32) + (answer > 0) + (answer > 0.25)
        out |= (level ^ level >> 1).astype(np.uint32) << np.uint32(2 * i)  # Gray code: neighbours differ in one bit
    return out


def fingerprint(audio: bytes | None, rate: int = RATE) -> np.ndarray:
    """Packed integers of a recording of little-endian 16-bit samples; none for null or one that is too short."""
    if not audio:
        return np.empty(0, np.uint32)
    return packed_integers(chroma(np.frombuffer(audio, "<i2", len(audio) // 2).astype(float), rate))


def fingerprint_media(media: DataFrame, *, id_col: str, audio: dict[str, str] | None = None, rate: int = RATE) -> DataFrame:
    """``id`` and integers (array<long>) of every row, in one pass; other columns are left out, repeated rows kept.

    ``audio`` names the media columns and what their integers are called (default: ``prints`` of ``audio``). A recording
    that is null, empty or too short has none; the odd byte of one of odd length is left out.
    """
    audio = audio or {"prints": "audio"}

    def run(frames):
        for f in frames:
            made = {p: [fingerprint(a, rate).astype(np.int64) for a in f[p]] for p in audio}
            yield pd.DataFrame({"id": f["id"].astype("Int64").mask(f["nameless"]), **made})

    rows = media.select(*flagged(column(media, id_col, "long"), "id"), *[F.col(f"`{c}`").alias(p) for p, c in audio.items()])
    return rows.mapInPandas(run, "id long, " + ", ".join(f"{p} array<long>" for p in audio))


def content_key(prints: Column) -> Column:
    """Equal for equal integers: 128 bits of hash as text; null for none, so that recordings without integers equal nothing."""
    return F.when(F.size(prints) > 0, F.concat(F.hex(F.xxhash64(prints)), F.hex(F.xxhash64(F.lit(1), prints))))


def _runs(prints: Column) -> Column:
    """Runs of one key: ``k`` (two integers at KEY_STEP frames' distance), ``t`` the first frame, ``n`` how many frames."""
    keys = F.transform(F.slice(prints, F.lit(1), F.greatest(F.size(prints) - KEY_STEP, F.lit(0))), lambda x, i: F.struct(F.shiftleft(x, 32).bitwiseOR(F.get(prints, i + KEY_STEP)).alias("k"), i.alias("t")))

    def lengths(all_: Column, first: Column) -> Column:
        return F.transform(first, lambda s, i: F.struct(s["k"].alias("k"), s["t"].alias("t"), (F.coalesce(F.get(first, i + 1)["t"], F.size(all_)) - s["t"]).alias("n")))

    return let(keys, lambda p: let(F.filter(p, lambda x, i: (i == 0) | (x["k"] != F.get(p, i - 1)["k"])), lambda first: lengths(p, first)))


def align(queries: DataFrame, corpus: DataFrame, *, votes: int = VOTES, least_frames: int = LEAST_FRAMES, most_error: float = MOST_ERROR) -> DataFrame:
    """``query, recording, offset, votes, frames, bit_error`` of recordings that align with a query.

    ``queries`` has ``query, prints``, ``corpus`` has ``recording, prints``, each with unique keys. Runs of a key that both
    hold vote for the offsets at which they begin or end together, with as many votes as the shorter has frames; so steady
    tones and silence align too. Each offset with ``votes`` or more is tried: the share of differing bits is taken over all
    frames that overlap there. A pair's best offset is that of least error, then of most votes, then the least. Keys that
    many recordings hold are split by adaptive execution, both sides of that join coming as they are.
    """
    q = queries.select("query", F.explode(_runs(F.col("prints"))).alias("x")).select("query", F.col("x.k").alias("k"), F.col("x.t").alias("tq"), F.col("x.n").alias("nq"))
    c = corpus.select("recording", F.explode(_runs(F.col("prints"))).alias("x")).select("recording", F.col("x.k").alias("k"), F.col("x.t").alias("tc"), F.col("x.n").alias("nc"))
    begin = F.col("tc") - F.col("tq")
    offsets = F.explode(F.array_distinct(F.array(begin, begin + F.col("nc") - F.col("nq"))))
    voted = c.join(q, "k").select("query", "recording", offsets.alias("offset"), F.least("nq", "nc").alias("n")).groupBy("query", "recording", "offset").agg(F.sum("n").alias("votes")).filter(F.col("votes") >= votes)
    tried = voted.groupBy("query", "recording").agg(F.collect_list(F.struct("offset", "votes")).alias("tries"))  # as many as the two have frames, at most
    pairs = tried.join(queries.withColumnRenamed("prints", "a"), "query").join(corpus.withColumnRenamed("prints", "b"), "recording")

    def judged(t: Column) -> Column:
        a = F.slice(F.col("a"), F.greatest(F.lit(0), -t["offset"]) + 1, F.size("a"))
        b = F.slice(F.col("b"), F.greatest(F.lit(0), t["offset"]) + 1, F.size("b"))
        frames = F.least(F.size(a), F.size(b))
        wrong = F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(F.bit_count(x.bitwiseXOR(y)), F.lit(0))), F.lit(0), lambda s, x: s + x)
        error = F.when(frames >= least_frames, wrong / (32.0 * frames))
        return F.struct(error.alias("bit_error"), (-t["votes"]).alias("less"), t["offset"].alias("offset"), t["votes"].alias("votes"), frames.alias("frames"))

    best = F.array_min(F.filter(F.transform("tries", judged), lambda t: t["bit_error"] <= most_error))
    return pairs.select("query", "recording", best.alias("t")).filter("t is not null").select("query", "recording", "t.offset", "t.votes", "t.frames", "t.bit_error")


def melody(vector: np.ndarray, rate: int = RATE) -> bytes:
    """A recording made from numbers: one note of 50 ms for each, by its size, with an overtone."""
    step = int(0.05 * rate)
    v = np.nan_to_num(np.asarray(vector, float), nan=0.0, posinf=0.0, neginf=0.0)
    pitch = 220 * 2 ** (np.floor(np.clip(v / (np.sqrt((v**2).mean()) or 1.0), -3, 3) * 4 + 12) / 12)
    phase = 2 * np.pi * np.cumsum(np.repeat(pitch, step)) / rate
    return (8000 * np.sin(phase) + 3000 * np.sin(2 * phase)).astype("<i2").tobytes()


def excerpt(audio: bytes) -> bytes:
    """The recording again: from a third on, softer, with a hiss by a fixed rule, not cut at a frame's start."""
    x = np.frombuffer(audio, "<i2").astype(float)
    x = x[len(x) // 3 + 37 :]
    hiss = np.random.default_rng(len(x)).normal(0, 120, len(x))
    return (0.7 * x + hiss).astype("<i2").tobytes()


def recordings(vectors: DataFrame) -> DataFrame:
    """``vec_id, audio, again``: a media column that stands for each vector, and for ids that 50 divides an excerpt of it, recorded again."""

    def run(frames):
        for f in frames:
            made = [None if v is None else melody(v) for v in f["embedding"]]
            asked = (f["vec_id"].mod(50) == 0) & ~f["nameless"]
            yield pd.DataFrame({"vec_id": f["vec_id"].astype("Int64").mask(f["nameless"]), "audio": made, "again": [excerpt(a) if a and q else None for a, q in zip(made, asked, strict=True)]})

    return vectors.select(*flagged(column(vectors, "vec_id", "long"), "vec_id"), "embedding").mapInPandas(run, "vec_id long, audio binary, again binary")


MATCHES = "array<struct<class_id:bigint,offset:int,bit_error:double>>"


def search_recordings(media: DataFrame, *, id_col: str, audio_col: str = "audio", query_col: str = "again") -> DataFrame:
    """``id, class_id, prints, matches`` of every row, a staged table: recordings with their class, and what their query column aligns with.

    Equal recordings are one class, named by its least id (null if none has one); a recording without integers is a
    class by itself. Rows are never merged by id: rows that share an id, or have none, are recordings each. ``matches`` are
    classes by id, offset (frames) and share of differing bits; empty where the row is no query.
    """
    with Scratch(media.sparkSession, "media") as work:
        rows = fingerprint_media(media, id_col=id_col, audio={"prints": audio_col, "asked": query_col})
        rows = work.table(rows.withColumn("recording", content_key(F.col("prints"))).withColumn("query", content_key(F.col("asked"))), "rows")
        corpus = work.table(rows.filter("recording is not null").groupBy("recording").agg(F.min("id").alias("class_id"), F.first("prints").alias("prints")), "classes")
        queries = work.table(rows.filter("query is not null").groupBy("query").agg(F.first("asked").alias("prints")), "queries")
        found = align(queries, corpus.select("recording", "prints"))
        named = found.join(corpus.select("recording", "class_id"), "recording")
        match = F.struct("class_id", F.col("offset").cast("int").alias("offset"), F.round("bit_error", 6).alias("bit_error"))
        listed = work.table(named.groupBy("query").agg(F.array_sort(F.collect_list(match)).alias("matches")), "matches")
        out = rows.join(corpus.select("recording", "class_id"), "recording", "left").join(listed, "query", "left")
        return staged(out.select("id", F.when(F.col("recording").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), "prints", F.coalesce("matches", F.array().cast(MATCHES)).alias("matches")), "media")


def op10_audio_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of a recording for each row of ``embeddings``; excerpts of those whose id 50 divides are searched in all."""
    found = search_recordings(recordings(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), id_col="vec_id")
    return found.select(F.col("id").alias("vec_id"), "class_id", F.size("prints").alias("n_frames"), F.crc32(F.to_json("prints").cast("binary")).alias("prints_crc32"), F.to_json("matches").alias("matches"))
