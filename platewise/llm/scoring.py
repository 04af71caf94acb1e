"""Operator 12: language-model scores by online logistic context mixing.

A text is its words (A to Z lower-cased) and an end. Two models share the work, and both mix binary predictions in the
logistic domain by weights that a gate selects, learned online: predict, then correct.

- *Spelling* gives the bits of a word's letters under a Huffman code. Predictors are tables of counts by hashed contexts:
  the last 1, 2, 3, 4 and 6 letters and the whole beginning of the word, each with the node of the code. The gates are
  how often the whole beginning is known and whether it always went on alike (else the longest other context that is
  known, with the place in the word); and the node. While weights are learned, a word's own
  occurrence is taken out of the counts. An adaptive map refines the mixed probability. A word is spelled once, however
  often it occurs, and its bits are joined to the texts.
- *Repeats* looks back in the text itself: what followed the last time that the same one or two words stood here? One
  bit says whether the guess holds; if so, nothing is spelled. Its predictors are tables by the guess's run of success,
  the guessed word and the word before (hashed), and how guesses have fared so far in this text.

Both are proper models of the sequence of words, so the bits of a text add up, and bits a byte follow.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import defaultdict
from dataclasses import dataclass
from itertools import compress, count, islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, column, staged

#: The token at the end of a text: no word holds this byte.
END = b"\n"
#: Letters that each context covers (0: the whole beginning of the word), and the bits of its table's slots.
ORDERS = ((1, 16), (2, 19), (3, 20), (4, 21), (6, 21), (0, 21))
STOP, BEFORE = 256, 257  # end of a word, and what stands before its first letter
PRIOR, LONG_PRIOR = 0.4, 0.05  # of both bits in every context, and in the whole beginning, which nearly always goes on alike
LETTERS, STEP_LETTERS = 1 << 14, 1 << 12  # that are worked on at once, and between two corrections of the weights
FAMILIAR = 12  # classes of how often a word's whole beginning is known, by doublings
KNOWN_GATES, NODES, INPUTS, LEVELS = 4 * (len(ORDERS) + FAMILIAR), 256, len(ORDERS) + 1, 33
RATE = 0.01
#: Words sent to all tasks at most, and bytes of one: the most frequent ones. All others meet their counts in a join.
HOT_WORDS, HOT_BYTES = 1 << 17, 64
HASHED = 1 << 16  # slots for guessed words and words before
REPEAT_GATES, REPEAT_INPUTS = 8, 5
REPEAT_BLOCK = 1 << 14
TOKENS = 1 << 16  # of texts that are worked on at once
SPLIT_ROWS = 64  # texts that are split into words at once
CHUNK = 1 << 12  # numbers in a row of a vector
CHUNKS_AT_ONCE = 64  # rows of vectors that are sent together
DEALT = 1 << 10  # groups of rows, at most, that the chunks of a short vector are shared out to
HELD = 1 << 16  # different words that a task counts before it sends them


# ---- vectors of numbers, summed over tasks


def vector_rows(vector: np.ndarray):
    """``chunk, data`` of the parts of a vector that are not all 0."""
    parts = ((k // CHUNK, vector[k : k + CHUNK]) for k in range(0, len(vector), CHUNK))
    yield from chunk_rows(((k, part.astype("<f4").tobytes()) for k, part in parts if part.any()))


def chunk_rows(rows):
    """Record batches of pairs of a chunk's number and bytes, a few at once."""
    for some in iter(lambda rows=iter(rows): list(islice(rows, CHUNKS_AT_ONCE)), []):
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int32()), pa.array([data for _, data in some], pa.binary())], ["chunk", "data"])


def summed(rows: DataFrame, size: int, finish=None) -> DataFrame:
    """Sums of vectors (``<f4``) of a known size by chunk, in doubles, or what ``finish`` makes of a sum.

    Chunks are dealt to as many tasks as shuffles have, so that a task holds few sums, and each task is one Python worker. The
    few chunks of a short vector are first summed within shares of the rows.
    """
    parts, chunks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // CHUNK)

    def add(kind, finish=None):
        def run(batches):
            held: dict[int, np.ndarray] = {}
            for b in batches:
                for k, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    v = np.frombuffer(data.as_buffer(), kind)
                    if k in held:
                        held[k] += v
                    else:
                        held[k] = v.astype("<f8")
            yield from chunk_rows((k, (finish(v) if finish else v).tobytes()) for k, v in held.items())

        return run

    kind, shares = "<f4", min(32, DEALT // chunks)
    if shares > 1:
        share = F.pmod(F.spark_partition_id(), F.lit(shares))
        rows, kind = rows.repartition(parts, "chunk", share).mapInArrow(add(kind), "chunk int, data binary"), "<f8"
    return rows.repartition(parts, "chunk").mapInArrow(add(kind, finish), "chunk int, data binary")


def gathered(rows: DataFrame, size: int, kind: str = "<f8") -> np.ndarray:
    """A vector of known size on the driver."""
    out = np.zeros(-(-size // CHUNK) * CHUNK, np.dtype(kind))
    for k, data in zip(*(c.to_pylist() for c in rows.select("chunk", "data").toArrow().columns), strict=True):
        part = np.frombuffer(data, kind)
        out[k * CHUNK : k * CHUNK + len(part)] = part
    return out[:size]


# ---- spelling


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each symbol its path: nodes, bits (rows padded with 0) and length."""
    heap = [(int(c), i, (i,)) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    path: list[list[tuple[int, int]]] = [[] for _ in counts]
    for node in range(len(counts) - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for bit, some in ((0, a[2]), (1, b[2])):
            for s in some:
                path[s].append((node, bit))
        heapq.heappush(heap, (a[0] + b[0], len(counts) + node, a[2] + b[2]))
    n = max(map(len, path))
    nodes, bits = np.zeros((2, len(counts), n), np.int64)
    for s, p in enumerate(path):
        for k, (node, bit) in enumerate(reversed(p)):
            nodes[s, k], bits[s, k] = node, bit
    return nodes, bits, np.array(list(map(len, path)))


def coded(n: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact up to 63, then eight steps for each doubling."""
    high = 64 + np.floor(8 * np.log2(np.maximum(n, 64) / 64))
    return np.where(n < 64, n, np.minimum(high, 255)).astype(np.uint8)


COUNT = np.where(np.arange(256) < 64, np.arange(256), 64 * 2.0 ** ((np.arange(256) - 64) / 8))
CLASS = np.minimum(np.log2(np.maximum(COUNT, 1)), FAMILIAR - 1).astype(np.int64)


def spoken(prior: float, less: bool) -> np.ndarray:
    """What a context says (logistic) by its coded counts of 0, of 1 in the next byte, and the outcome in the bit above; ``less``: without that outcome's own occurrence."""
    log, log_less = (np.log(c + prior).astype(np.float32) for c in (COUNT, np.maximum(COUNT - 1, 0)))
    if not less:
        log_less = log
    return np.concatenate([(log[:, None] - log_less).ravel(), (log_less[:, None] - log).ravel()])


def last_gates(says: np.ndarray, less: bool) -> np.ndarray:
    """The gate of a known whole beginning, by what ``spoken`` goes by; -1 where it isn't known."""
    bit, n1, n0 = np.indices((2, 256, 256)).reshape(3, -1)
    one_sided = np.where(says > 0, n0 - (less & (bit == 0)), n1 - (less & (bit == 1))) == 0
    return np.where(n0 + n1 > less, 4 * (len(ORDERS) + CLASS[np.maximum(n0, n1)]) + 2 * one_sided, -1).astype(np.int16)


#: By ``less``: what contexts say by their prior, and the last context's gates.
SAYS = [{prior: spoken(prior, less) for prior in (PRIOR, LONG_PRIOR)} for less in (False, True)]
LAST_GATES = [last_gates(SAYS[less][LONG_PRIOR], bool(less)) for less in (0, 1)]
OFFSETS = np.cumsum([0, *(1 << b for _, b in ORDERS)])


@dataclass
class Bits:
    """All binary decisions of a batch of words: word, outcome, node, place in the word, and the slot of each context."""

    word: np.ndarray
    bit: np.ndarray
    node: np.ndarray
    place: np.ndarray
    slots: list[np.ndarray]


def bits_of(words: list[bytes], code: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Bits:
    """The decisions of words, with hashed contexts."""
    nodes, outcomes, lengths = code
    size = np.array([len(w) + 1 for w in words], np.int64)
    start = np.cumsum(size) - size
    sym = np.full(int(size.sum()), STOP, np.int64)
    letters = np.ones(len(sym), bool)
    letters[start + size - 1] = False
    sym[letters] = np.frombuffer(b"".join(words), np.uint8)
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(sym)) - start[word]
    rep = np.repeat(np.arange(len(sym)), lengths[sym])
    depth = np.arange(len(rep)) - (np.cumsum(lengths[sym]) - lengths[sym])[rep]
    node, bit = nodes[sym[rep], depth], outcomes[sym[rep], depth]
    step = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    # The whole beginning: a sum of letters times powers by place.
    power = np.cumprod(np.full(int(size.max()), 0x9E3779B97F4A7C15, np.uint64))
    terms = (sym + 1).astype(np.uint64) * power[place]
    sums = np.cumsum(terms) - terms
    whole = sums - sums[start][word]
    slots, near, reach = [], np.zeros(len(sym), np.uint64), 0
    for (order, width), offset in zip(ORDERS, OFFSETS, strict=False):
        while reach < order:
            reach += 1
            back = np.concatenate((np.full(min(reach, len(sym)), BEFORE), sym[:-reach]))
            near = near * np.uint64(0x9E3779B97F4A7C15) + np.where(place >= reach, back, BEFORE).astype(np.uint64) + np.uint64(1)
        context = (near if order else whole ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(0xBF58476D1CE4E5B9)
        context ^= context >> np.uint64(29)
        slots.append((((context[rep] ^ step) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - width)).astype(np.int64) + offset)
    return Bits(word[rep], bit, node, np.minimum(place[rep], 3), slots)


def word_groups(words: list[bytes], letters: int = LETTERS):
    """Slices of words with about so many letters together."""
    at, n = 0, 0
    for k, w in enumerate(words):
        n += len(w) + 1
        if n >= letters:
            yield slice(at, k + 1)
            at, n = k + 1, 0
    if at < len(words):
        yield slice(at, len(words))


def inputs_of(b: Bits, table: np.ndarray, less: bool) -> tuple[np.ndarray, np.ndarray]:
    """What each context says (logistic), with a constant; and the gate of the longest known context. ``less``: without the word's own occurrence."""
    s = np.ones((len(b.bit), INPUTS), np.float32)
    longest = np.zeros(len(b.bit), np.int64)
    pairs, outcome = table.view("<u2"), b.bit << 16
    for k, (slot, (order, _)) in enumerate(zip(b.slots, ORDERS, strict=True)):
        pair = pairs.take(slot)
        at = pair | outcome
        s[:, k] = SAYS[less][PRIOR if order else LONG_PRIOR].take(at)
        if order:
            np.copyto(longest, k + 1, where=(pair > 1) & (pair != 256) if less else pair > 0)
    last = LAST_GATES[less].take(at).astype(np.int64)  # of the last context, the whole beginning
    return s, np.where(last >= 0, last + (b.place > 2), 4 * longest + b.place)


def squash(t: np.ndarray) -> np.ndarray:
    """Probability of 1."""
    return 1 / (1 + np.exp(-np.clip(t, -20, 20)))


def level(t: np.ndarray) -> np.ndarray:
    """Which of the map's levels a logistic value is in."""
    return np.rint(np.clip(t, -8, 8) * 2).astype(np.int64) + LEVELS // 2


class Online:
    """Weights by gate that are corrected step by step, each by its mean error times input over the root of the sum of its squares so far."""

    def __init__(self, weights: np.ndarray, rate: float) -> None:
        self.weights, self.rate = weights.copy(), rate
        self.seen, self.squares = np.zeros(len(weights)), np.full(weights.shape, 1e-3)

    def correct(self, gate: np.ndarray, inputs: np.ndarray, wrong: np.ndarray, times: np.ndarray) -> None:
        """One step; ``seen`` adds up how much each gate has seen."""
        n = np.bincount(gate, times, len(self.seen))
        pull = wrong * times
        for k in range(inputs.shape[1]):
            g = np.bincount(gate, pull * inputs[:, k], len(n)) / (n + 20)
            self.squares[:, k] += g * g
            self.weights[:, k] += self.rate * g / np.sqrt(self.squares[:, k])
        self.seen += n


#: Weights before anything is learned: by the whole beginning where it is known, the more the better, else by the others.
START = np.full((len(ORDERS) + FAMILIAR, 4, INPUTS), 0.3)
_MORE = (np.arange(FAMILIAR) / (FAMILIAR - 1)) ** 0.5
START[len(ORDERS) :, :, :-1] = np.concatenate([np.repeat(0.2 * (1 - _MORE)[:, None], len(ORDERS) - 1, 1), (0.4 + 0.6 * _MORE)[:, None]], 1)[:, None]
START[len(ORDERS) :, :, -1] = 0
START = START.reshape(KNOWN_GATES, INPUTS)
SPELLING = (KNOWN_GATES + NODES) * (INPUTS + 1) + 2 * NODES * LEVELS


@dataclass
class Spelling:
    """A fitted model of words: code, coded counts by slot, weights by gate, and the adaptive map."""

    code: tuple[np.ndarray, np.ndarray, np.ndarray]
    table: np.ndarray
    known: np.ndarray
    by_node: np.ndarray
    refined: np.ndarray

    def bits(self, words: list[bytes]) -> np.ndarray:
        """Bits of each word."""
        out = [np.empty(0)]
        weights = (self.known[:, None] + self.by_node).reshape(-1, INPUTS)
        for some in word_groups(words):
            b = bits_of(words[some], self.code)
            s, gate = inputs_of(b, self.table, less=False)
            t = np.einsum("ij,ij->i", s, weights.take(gate * NODES + b.node, 0))
            p = 0.5 * squash(t) + 0.5 * self.refined[b.node, level(t)]
            out.append(np.bincount(b.word, -np.log2(np.where(b.bit == 1, p, 1 - p)), len(words[some])))
        return np.concatenate(out)


def fit_spelling(words: DataFrame, work: Scratch) -> Spelling:
    """Learn from ``word, c`` with c > 0: one pass for letters, one for the contexts' counts, one for weights and map.

    The tables have a fixed number of slots, whatever the corpus; all its words are counted in them.
    """
    words = words.filter("c > 0").select("word", "c")
    spark = words.sparkSession

    def letters(batches):
        total = np.zeros(STOP + 1)
        for b in batches:
            found, c = b.column(0).to_pylist(), b.column(1).to_numpy()
            total[:STOP] += np.bincount(np.frombuffer(b"".join(found), np.uint8), np.repeat(c, [len(w) for w in found]), STOP)
            total[STOP] += c.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(STOP + 1)), pa.array(total.astype(np.int64))], ["s", "c"])

    counts = np.ones(STOP + 1)
    for r in words.mapInArrow(letters, "s long, c long").groupBy("s").agg(F.sum("c").alias("c")).collect():  # one row a letter
        counts[r["s"]] += r["c"]
    code = huffman(counts)

    def contexts(batches):
        total = np.zeros(2 * OFFSETS[-1], np.float32)
        for batch in batches:
            found, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for some in word_groups(found):
                b = bits_of(found[some], code)
                times = c[some][b.word].astype(np.float32)
                for slot in b.slots:
                    np.add.at(total, 2 * slot + b.bit, times)
        yield from vector_rows(total)

    size = 2 * int(OFFSETS[-1])
    table = gathered(work.table(summed(words.mapInArrow(contexts, "chunk int, data binary"), size, coded), "tables"), size, "u1")
    spread = spark.sparkContext.broadcast((code, table))

    def learn(batches):
        code, table = spread.value
        known, by_node = Online(START, RATE), Online(np.zeros((NODES, INPUTS)), RATE / 2)
        refined = np.zeros((2, NODES * LEVELS))
        for batch in batches:
            found, c = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for some in word_groups(found, STEP_LETTERS):
                b = bits_of(found[some], code)
                s, gate = inputs_of(b, table, less=True)
                t = np.einsum("ij,ij->i", s, known.weights.take(gate, 0) + by_node.weights.take(b.node, 0))
                times = c[some][b.word].astype(float)
                at = b.node * LEVELS + level(t)
                refined[0] += np.bincount(at, times, NODES * LEVELS)
                refined[1] += np.bincount(at, times * b.bit, NODES * LEVELS)
                wrong = b.bit - squash(t)
                known.correct(gate, s, wrong, times)
                by_node.correct(b.node, s, wrong, times)
        yield from vector_rows(np.concatenate([x for m in (known, by_node) for x in ((m.weights * m.seen[:, None]).ravel(), m.seen)] + [refined.ravel()]))

    v = gathered(work.table(summed(words.mapInArrow(learn, "chunk int, data binary"), SPELLING), "weights"), SPELLING)
    spread.destroy()
    at = np.cumsum([0, KNOWN_GATES * INPUTS, KNOWN_GATES, NODES * INPUTS, NODES, NODES * LEVELS, NODES * LEVELS])
    known, seen_known, by_node, seen_node, n, ones = (v[a:b] for a, b in zip(at, at[1:], strict=False))
    middle = np.tile(squash((np.arange(LEVELS) - LEVELS // 2) / 2), NODES)
    return Spelling(
        code, table,
        np.where(seen_known[:, None] > 0, known.reshape(-1, INPUTS) / np.maximum(seen_known, 1)[:, None], START),
        by_node.reshape(-1, INPUTS) / np.maximum(seen_node, 1)[:, None],
        ((ones + 2 * middle) / (n + 2)).reshape(NODES, LEVELS),
    )


# ---- repeats


@dataclass
class Guesses:
    """Where a text's own past makes a guess: the place, the word guessed, order (0: one word, 1: two), hit, run of hits before, hits and misses so far."""

    at: np.ndarray
    guess: np.ndarray
    order: np.ndarray
    hit: np.ndarray
    run: np.ndarray
    hits: np.ndarray
    misses: np.ndarray


def last_same(key: np.ndarray) -> np.ndarray:
    """The last earlier place of an equal key, or -1."""
    # Numbers sort much faster than places by them: the place takes the lowest bits, and keys that differ in these alone are sorted as they are.
    low = np.uint64(len(key).bit_length())
    packed = np.sort(key >> low << low | np.arange(len(key), dtype=np.uint64))
    order = (packed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    same = key[order[1:]] == key[order[:-1]]
    if (packed[1:] >> low == packed[:-1] >> low)[~same].any():
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
    out = np.full(len(key), -1, np.int64)
    out[order[1:][same]] = order[:-1][same]
    return out


def guesses(ids: np.ndarray, doc: np.ndarray, marks: np.ndarray) -> Guesses:
    """Guesses for words ``ids`` (with hashes ``marks``) of texts one after the other; ``doc`` ascends."""
    n = len(ids)
    spread = np.uint64(0x9E3779B97F4A7C15)
    own = (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (marks.astype(np.uint64) + np.uint64(1)) * spread
    guess, order = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    for reach in (1, 2):
        at = np.flatnonzero(doc[reach:] == doc[:-reach]) + reach
        key = own[at] ^ h[at - 1]
        if reach == 2:
            key = (key ^ key >> np.uint64(31)) * spread ^ h[at - 2]
        before = last_same(key)
        found = before >= 0
        guess[at[found]] = ids[at[before[found]]]
        order[at[found]] = reach - 1
    at = np.flatnonzero(guess >= 0)
    hit, k = guess[at] == ids[at], np.arange(len(at))
    first = np.searchsorted(doc[at], doc[at], "left")
    sums = np.cumsum(hit) - hit
    missed = np.concatenate(([-1], np.maximum.accumulate(np.where(hit, -1, k))[:-1])) if len(at) else k
    hits = sums - sums[first] if len(at) else k
    return Guesses(at, guess[at], order[at], hit, np.minimum(k - 1 - np.maximum(missed, first - 1), 15), hits, k - first - hits)


class Repeats:
    """The mixed prediction that a guess holds: counts by context and weights by gate."""

    SIZE = 2 * (32 + 2 * HASHED) + REPEAT_GATES * (REPEAT_INPUTS + 1)

    def __init__(self, vector: np.ndarray | None = None) -> None:
        n = 32 + 2 * HASHED
        v = np.zeros(self.SIZE) if vector is None else vector
        self.misses, self.hits = v[:n].copy(), v[n : 2 * n].copy()
        seen = v[2 * n : 2 * n + REPEAT_GATES]
        weights = v[2 * n + REPEAT_GATES :].reshape(REPEAT_GATES, REPEAT_INPUTS)
        self.online = Online(np.where(seen[:, None] > 0, weights / np.maximum(seen, 1)[:, None], 0.3), RATE)

    def vector(self) -> np.ndarray:
        """Sums that add up over tasks."""
        return np.concatenate([self.misses, self.hits, self.online.seen, (self.online.weights * self.online.seen[:, None]).ravel()])

    def inputs(self, g: Guesses, guessed: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Inputs, slots and gates; ``guessed`` and ``before`` are hashes of the word guessed and of the word before."""
        slots = [16 * g.order + g.run, 32 + (guessed.astype(np.int64) * 2 + g.order) % HASHED, 32 + HASHED + (before.astype(np.int64) * 2 + g.order) % HASHED]
        s = np.ones((len(g.at), REPEAT_INPUTS))
        for k, slot in enumerate(slots):
            s[:, k] = np.log((self.hits[slot] + PRIOR) / (self.misses[slot] + PRIOR))
        s[:, 3] = np.log((g.hits + PRIOR) / (g.misses + 2))
        return s, slots, 4 * g.order + np.minimum(g.run, 3)

    def learn(self, g: Guesses, guessed: np.ndarray, before: np.ndarray) -> None:
        """Predict and correct, a block at a time."""
        for a in range(0, len(g.at), REPEAT_BLOCK):
            part = Guesses(*(x[a : a + REPEAT_BLOCK] for x in (g.at, g.guess, g.order, g.hit, g.run, g.hits, g.misses)))
            s, slots, gate = self.inputs(part, guessed[a : a + REPEAT_BLOCK], before[a : a + REPEAT_BLOCK])
            wrong = part.hit - squash((s * self.online.weights[gate]).sum(1))
            self.online.correct(gate, s, wrong, np.ones(len(wrong)))
            used, hit = np.concatenate(slots), np.tile(part.hit, len(slots))
            self.hits += np.bincount(used[hit], minlength=len(self.hits))
            self.misses += np.bincount(used[~hit], minlength=len(self.misses))

    def bits(self, g: Guesses, guessed: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Bits that each guess costs."""
        s, _, gate = self.inputs(g, guessed, before)
        p = np.clip(squash((s * self.online.weights[gate]).sum(1)), 1e-6, 1 - 1e-6)
        return -np.log2(np.where(g.hit, p, 1 - p))


def numbering() -> defaultdict[bytes, int]:
    """Numbers of words in the order of their first appearance."""
    return defaultdict(count().__next__)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of texts, one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, text = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    some = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty word
    return words.filter(some).cast(pa.binary()), np.bincount(text[some.to_numpy(zero_copy_only=False)], minlength=len(texts))


def text_batches(batches, columns: int):
    """Rows of texts with their words, TOKENS or a few more at once: lists of the other columns' values, the words, and how many each text has."""
    rows, words, sizes, n = [], [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, SPLIT_ROWS):
            part = batch.slice(at, SPLIT_ROWS)
            others = list(zip(*(part.column(k).to_pylist() for k in range(columns - 1)), strict=True))
            found, size = words_of(part.column(columns - 1))
            ends, total = np.cumsum(size), np.cumsum(size + 1)  # words, tokens
            a = 0
            while a < len(size):
                done = total[a - 1] if a else 0
                b = min(int(np.searchsorted(total, done + TOKENS - n)) + 1, len(size))
                start = ends[a - 1] if a else 0
                rows += others[a:b]
                words.append(found.slice(start, ends[b - 1] - start))
                sizes.append(size[a:b])
                n += int(total[b - 1] - done)
                a = b
                if n >= TOKENS:
                    yield rows, pa.concat_arrays(words), np.concatenate(sizes)
                    rows, words, sizes, n = [], [], [], 0
    if rows:
        yield rows, pa.concat_arrays(words), np.concatenate(sizes)


def numbered(words: pa.Array, size: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The different tokens of some texts, the number therein of each token, and which text each is of."""
    coded = words.dictionary_encode()
    found = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # much faster than to_pylist
    ids = np.full(len(words) + len(size), len(found))
    inside = np.ones(len(ids), bool)
    inside[np.cumsum(size + 1) - 1] = False
    ids[inside] = coded.indices.to_numpy()
    return [*found, END], ids, np.repeat(np.arange(len(size)), size + 1)


def survey(docs: DataFrame, learn: Column) -> DataFrame:
    """``word, c, chunk, data``: what tasks have counted of words (0 for those that only other texts have), and their vectors of repeats."""

    def run(batches):
        numbers, marks, counts, model = numbering(), np.empty(0, np.uint32), np.zeros(0, np.int64), Repeats()

        def send():
            n = len(numbers)
            return pa.RecordBatch.from_arrays([pa.array(list(numbers), pa.binary()), pa.array(counts), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["word", "c", "chunk", "data"])

        for rows, words, size in text_batches(batches, 2):
            found, at, doc = numbered(words, size)
            ids = np.fromiter(map(numbers.__getitem__, found), np.int64, len(found))[at]
            if len(numbers) > len(marks):
                marks = np.concatenate([marks, np.fromiter(map(zlib.crc32, islice(numbers, len(marks), None)), np.uint32)])
            mine = np.array([r[0] for r in rows], bool)[doc]
            counts = np.pad(counts, (0, len(numbers) - len(counts)))
            counts += np.bincount(ids[mine], minlength=len(numbers))
            ids, doc = ids[mine], doc[mine]
            g = guesses(ids, doc, marks[ids])
            model.learn(g, marks[g.guess], marks[ids[g.at - 1]])
            if len(numbers) > HELD:
                yield send()
                numbers, marks, counts = numbering(), np.empty(0, np.uint32), np.zeros(0, np.int64)
        if numbers:
            yield send()
        del numbers, marks, counts
        pa.default_memory_pool().release_unused()  # the worker goes on to other work
        for b in vector_rows(model.vector()):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.binary()), pa.nulls(len(b), pa.int64()), *b.columns], ["word", "c", "chunk", "data"])

    return docs.select(learn.alias("learn"), "text").mapInArrow(run, "word binary, c long, chunk int, data binary")


def hot_bar(words: DataFrame) -> float:
    """The least count from which on words are at most HOT_WORDS."""
    step = F.floor(F.log2("c") * 8)
    left = HOT_WORDS
    bar = math.inf
    for r in words.filter("c > 0").groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("c")).orderBy(F.desc("step")).collect():  # eight rows a doubling
        left -= r["n"]
        if left < 0:
            break
        bar = r["c"]
    return bar


def score_documents(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id>, learned, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of every row, a staged table.

    Scores are log10 probabilities of the whole text as a sequence of words and an end; the base is that of single tokens
    with 0.1 added to each count. ``learn`` (boolean) says which rows are learned from; null counts as false. A null text
    is an end only. ``bits_per_byte`` is the score in bits for each byte of the text (null without bytes). Repeated rows
    are scored each. All rows' words are counted, in one exchange; only tables of fixed size, weights and at most
    ``HOT_WORDS`` words go through the driver. Without rows to learn from all counts are 0 and every bit is even.
    """
    spark = docs.sparkSession
    rows = docs.select(column(docs, id_col, "long").alias("id"), F.coalesce(learn, F.lit(False)).alias("learned"), column(docs, text_col, "string").alias("text"))
    with Scratch(spark, "scoring") as work:
        seen = work.table(survey(rows, F.col("learned")), "survey")
        words = work.table(seen.filter("word is not null").groupBy("word").agg(F.sum("c").alias("c")).sortWithinPartitions(F.xxhash64("word"), "word"), "words")
        repeats = Repeats(gathered(work.table(summed(seen.filter("chunk is not null").select("chunk", "data"), Repeats.SIZE), "repeats"), Repeats.SIZE))
        n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
        spelling = spark.sparkContext.broadcast(fit_spelling(words, work))

        def spell(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(spelling.value.bits(b.column(0).to_pylist()))], ["word", "c", "bits"])

        spelled = work.table(words.mapInArrow(spell, "word binary, c long, bits double"), "spelled")
        top = spelled.filter((F.col("c") >= hot_bar(words)) & (F.octet_length("word") <= HOT_BYTES)).toArrow()
        hot = spark.sparkContext.broadcast(({w: i for i, w in enumerate(top["word"].to_pylist())}, top["c"].to_numpy(), top["bits"].to_numpy(), repeats))

        def score(batches):
            place, c, bits, model = hot.value
            base_of, mark_of = np.log10(c + 0.1), np.fromiter(map(zlib.crc32, place), np.uint32, len(place))
            for some, words, size in text_batches(batches, 4):
                found, at, doc = numbered(words, size)
                number = np.fromiter(map(place.get, found, repeat(-1)), np.int64, len(found))
                others = number < 0
                rare = list(compress(found, others.tolist()))
                number[others] = len(place) + np.arange(len(rare))
                ids = number[at]
                marks = np.concatenate([mark_of, np.fromiter(map(zlib.crc32, rare), np.uint32, len(rare))])
                g = guesses(ids, doc, marks[ids])
                spelled_here = np.ones(len(ids), bool)
                spelled_here[g.at[g.hit]] = False
                known = ids < len(place)
                m = len(some)
                cost = np.zeros(m) + np.bincount(doc[g.at], model.bits(g, marks[g.guess], marks[ids[g.at - 1]]), m)  # of nothing, bincount makes integers
                a = ids[known]
                base = np.zeros(m) + np.bincount(doc[known], base_of[a], m)
                cost += np.bincount(doc[known], bits[a] * spelled_here[known], m)
                # Each text's rare words once, with how often they are there, and how often they are spelled.
                pair, at, times = np.unique(doc[~known] << 32 | ids[~known] - len(place), return_inverse=True, return_counts=True)
                spelt = np.bincount(at, spelled_here[~known], len(pair)).astype(np.int64)
                ends = np.concatenate(([0], np.searchsorted(pair >> 32, np.arange(m), "right"))).astype(np.int32)
                names = pa.array(rare, pa.binary()).take(pa.array(pair & 0xFFFFFFFF)) if len(rare) else pa.array([], pa.binary())
                lists = [pa.ListArray.from_arrays(pa.array(ends), x) for x in (names, pa.array(times), pa.array(spelt))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.bool_()), pa.array([r[2] for r in some], pa.int64()), pa.array(np.bincount(doc, minlength=m)), pa.array(np.bincount(doc[known], c[a] > 0, m).astype(np.int64)), pa.array(base), pa.array(cost), *lists],
                    ["id", "learned", "n_bytes", "n_tokens", "n_known", "base", "bits", "rare", "times", "spelt"],
                )

        fields = "id long, learned boolean, n_bytes long, n_tokens long, n_known long, base double, bits double, rare array<binary>, times array<long>, spelt array<long>"
        scored = rows.select("id", "learned", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text").mapInArrow(score, fields)
        scored = work.table(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
        rare = scored.select("row", F.explode(F.arrays_zip("rare", "times", "spelt")).alias("x")).select("row", F.col("x.rare").alias("word"), "x.times", "x.spelt")
        more = rare.join(spelled, "word").groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("c") + 0.1)).alias("more_base"), F.sum(F.col("spelt") * F.col("bits")).alias("more_bits"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"))
        out = scored.drop("rare", "times", "spelt").join(more, "row", "left")
        total = F.col("bits") + F.coalesce("more_bits", F.lit(0.0))
        base = F.col("base") + F.coalesce("more_base", F.lit(0.0)) - F.col("n_tokens") * math.log10(n + 0.1 * (v + 1))
        scores = staged(out.select(F.col("id").alias(id_col), "learned", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (total * -math.log10(2)).alias("score"), F.try_divide(total, "n_bytes").alias("bits_per_byte")), "scores")
        spelling.destroy()
        hot.destroy()
        return scores


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` scored, learned from those whose crc32 of the id 10 does not divide."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))
    out = score_documents(docs, ~kept_out)
    return out.select("doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
