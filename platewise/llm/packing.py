"""Operator 5: best-fit packing by a linear grouping scheme.

Lengths are integers up to the sequence length. Within a bin of pieces: large lengths are sorted and cut into groups of
equal cardinality, each rounded up to its group's largest length; sequences for the few rounded sizes are chosen as
configurations (how many of each size), the fullest possible one time after time as long as its sizes last; actual
pieces then take the places of their group. Sequences that rounding has left half empty are taken apart and their pieces
best-fit by real length, and small pieces, longest first, go into the fullest sequence that still holds them. Pieces are dealt at random over bins of bounded size, each a task's work, so that no task grows with the
input; a bin leaves at most a few sequences partly filled.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, exact_ids, flagged, staged
from .tokens import ChunkEncoder, of_worker, text_groups, tokenizer_path

#: Pieces of one bin on average.
BIN_PIECES = 40_000
#: Groups that large lengths are rounded to.
GROUPS = 96
#: Lengths above this share of a sequence are large.
LARGE = 0.12
#: Sequences of large pieces that are less full than such a share are taken apart and packed by their real lengths.
WELL_FILLED = (0.97, 0.99, 0.998)


def best_configuration(sizes: list[int], left: list[int], room: int) -> list[int]:
    """Counts of the rounded sizes that fill ``room`` best, none above what is left: a bounded knapsack over sums.

    The largest size left is always taken, so that every call uses it up step by step.
    """
    first = next(i for i, n in enumerate(left) if n)
    counts = [0] * len(sizes)
    counts[first] = 1
    rest = room - sizes[first]
    reach = 1  # bit s: sum s can be reached
    steps = []
    whole = (1 << (rest + 1)) - 1
    for i in range(first, len(sizes)):
        n = min(left[i] - counts[i], rest // sizes[i] if sizes[i] else 0)
        for _ in range(n):
            new = (reach | reach << sizes[i]) & whole
            if new == reach:
                break
            steps.append((i, reach))
            reach = new
    total = reach.bit_length() - 1
    for i, before in reversed(steps):
        if not before >> total & 1:
            counts[i] += 1
            total -= sizes[i]
    return counts


def best_fit(sizes: list[int], rooms: list[tuple[int, int]], capacity: int, first_new: int) -> tuple[list[int], int]:
    """The sequence of each size (in descending order) by best fit into sorted ``rooms`` (room, sequence), and how many new ones were opened.

    ``rooms`` is updated; new sequences are numbered from ``first_new`` on.
    """
    out, opened = [], 0
    for size in sizes:
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, s = rooms.pop(at)
        else:
            room, s = capacity, first_new + opened
            opened += 1
        out.append(s)
        if room > size:
            insort(rooms, (room - size, s))
    return out, opened


def pack_lengths(lengths: np.ndarray, capacity: int, groups: int = GROUPS, large: float = LARGE) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of every length (1 to capacity), and the number of sequences."""
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    n_large = int(np.searchsorted(-lengths[order], -large * capacity, "left"))

    # Large: equal-cardinality groups of the sorted lengths, rounded up to the first of each.
    chunk = max(1, -(-n_large // groups))
    members = [order[a : min(a + chunk, n_large)].tolist()[::-1] for a in range(0, n_large, chunk)]
    sizes = [int(lengths[m[-1]]) for m in members]
    left = [len(m) for m in members]
    packed: list[list[int]] = []
    while any(left):
        counts = best_configuration(sizes, left, capacity)
        times = min(left[i] // c for i, c in enumerate(counts) if c)
        for _ in range(times):
            packed.append([members[i].pop() for i, c in enumerate(counts) for _ in range(c)])
        left = [a - times * c for a, c in zip(left, counts, strict=True)]

    # What rounding up has left: sequences that aren't well filled are packed anew by real lengths, then small pieces go into
    # the fullest room that holds them. How well filled is worth keeping depends on the lengths; the fewest sequences win.
    fill = [int(sum(lengths[k] for k in s)) for s in packed]
    small = order[n_large:].tolist()
    best: tuple[list[int], list[int], int] | None = None
    for share in WELL_FILLED:
        kept = [s for s, f in zip(packed, fill, strict=True) if f >= share * capacity]
        rooms = sorted((capacity - f, i) for i, f in enumerate(f for f in fill if f >= share * capacity))
        again = sorted((k for s, f in zip(packed, fill, strict=True) if f < share * capacity for k in s), key=lambda k: -lengths[k])
        rest = again + small
        to, opened = best_fit([int(lengths[k]) for k in rest], [r for r in rooms if r[0]], capacity, len(kept))
        if best is None or len(kept) + opened < best[2]:
            best = [k for s in kept for k in s] + rest, [i for i, s in enumerate(kept) for _ in s] + to, len(kept) + opened
    placed, to, total = best
    used = [0] * total
    for k, s in zip(placed, to, strict=True):
        sequence[k], offset[k] = s, used[s]
        used[s] += int(lengths[k])
    return sequence, offset, total


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, capacity: int = 4096, keep_ids: bool = False) -> DataFrame:
    """``doc_id, row_key, piece, start, length, ids_crc32`` (and ``ids``): every document's ids and end id, cut into pieces only where longer than a sequence.

    A null text is empty. ``row_key`` tells rows apart that share an id. Without an end id an empty text has no piece.
    """

    def cut(batches):
        coder: ChunkEncoder = of_worker(("chunks", tokenizer), lambda: ChunkEncoder(tokenizer_path(tokenizer), keep_spaces=False))
        tail = b"" if end_id is None else np.asarray([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            keys = exact_ids(batch, "doc_id")
            for some in text_groups(batch["text"]):
                out = []
                for key, row, ids in zip(keys.iloc[some], batch["row_key"].iloc[some], coder.encode_many(batch["text"].iloc[some].tolist()), strict=True):
                    ids += tail
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        out.append((key, row, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if keep_ids else [])))
                frame = pd.DataFrame(out, columns=["doc_id", "row_key", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])])
                frame["doc_id"] = frame["doc_id"].astype("Int64")
                yield frame

    rows = docs.select(*flagged(column(docs, id_col, "long"), "doc_id"), F.monotonically_increasing_id().alias("row_key"), column(docs, text_col, "string").alias("text"))
    return rows.mapInPandas(cut, "doc_id long, row_key long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack(pieces_: DataFrame, capacity: int = 4096, bin_pieces: int = BIN_PIECES) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of ``length`` 1 to ``capacity``; sequences are gapless from 0.

    The pieces must be a table that reads alike each time (staged); they are dealt over bins by a hash of the row's place,
    so rows that repeat spread out as well. Two tables with no pieces give no rows.
    """
    n = pieces_.count()
    bins = max(1, round(n / bin_pieces))
    # Ids pass through pandas as strings: with a null among them they would come as doubles.
    dealt = pieces_.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("bin", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(bins)).cast("int"))
    fields = dealt.drop("bin").schema.simpleString()[7:-1].replace(":", " ")

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        sequence, offset, _ = pack_lengths(frame["length"].to_numpy(), capacity)
        out = frame.drop(columns="bin")
        out["sequence_id"] = frame["bin"].astype("int64") * (1 << 32) + sequence
        out["offset"] = offset
        return out

    return dealt.groupBy("bin").applyInPandas(place, ", ".join(fields.split(",")) + ", sequence_id long, offset long").withColumn("doc_id", F.col("doc_id").cast("long"))


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", *, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, capacity: int = 4096) -> DataFrame:
    """All documents, tokenized once into a staged table of pieces, and packed: a staged table."""
    with Scratch(docs.sparkSession, "packing") as work:
        table = work.table(pieces(docs, tokenizer, id_col=id_col, text_col=text_col, end_id=end_id, capacity=capacity), "pieces")
        return staged(pack(table, capacity).drop("row_key"), "packed")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 4096 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
