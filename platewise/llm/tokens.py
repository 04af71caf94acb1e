"""Operator 3: token counts by heap-and-linked-list byte-pair merging; and encoding with cached chunks for operators 5 and 6.

A text is cut where no piece of the vocabulary can span, so that each part merges on its own; a part's count is its
initial symbols less its merges, and no ids are made. Parts are kept by hash in a bounded table of each worker process.
"""

from __future__ import annotations

import heapq
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, exact_ids, flagged
from .hashing import SpanHasher, SpanTable

#: Parts that a worker's table holds at most; a full table is emptied.
TABLE_ROWS = 1_000_000
#: Characters of texts that are handled at once.
GROUP_CHARS = 700_000
SPACE = "▁"


class ChunkTable:
    """Rows of numbers for the chunks of texts: texts are cut before each space or line feed, equal chunks meet by hash.

    ``make`` gives the rows of chunks that the table lacks. Each text begins with a line feed of its own here, so a chunk
    is always a space or line feed and what follows it.
    """

    def __init__(self, make: Callable[[list[str]], list[np.ndarray]]) -> None:
        self.make, self.table, self.hasher = make, SpanTable(TABLE_ROWS), SpanHasher()

    def rows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All rows one after the other, the length of each chunk's row, and the number of chunks of each text."""
        parts = [f"\n{t}".encode("utf-8", "surrogatepass") for t in texts]
        data = np.frombuffer(b"".join(parts), np.uint8)
        starts = np.flatnonzero((data == 32) | (data == 10))
        ends = np.append(starts[1:], len(data))
        chunks = np.diff(np.searchsorted(starts, np.cumsum([0, *map(len, parts)])))
        hashes, checks = self.hasher.hashes(data, starts, ends), self.hasher.checks(data, starts, ends)
        unique, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        if not (checks == checks[first][back]).all():
            raise ValueError("two chunks have one hash")
        places = self.table.find(unique)
        new = places < 0
        if new.any() and len(self.table.hash) + int(new.sum()) > self.table.most:
            self.table.clear()
            new[:] = True
        if (~new).any() and not (self.table.check[places[~new]] == checks[first][~new]).all():
            raise ValueError("two chunks have one hash")
        if new.any():
            raw = data.tobytes()
            words = [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            self.table.add(unique[new], checks[first[new]], self.make(words))
            places = self.table.find(unique)
        out, length = self.table.gather(places[back])
        return out, length, chunks


class PieceCounter:
    """Counts the tokens of a SentencePiece BPE model with identity normalisation.

    ``pieces``: the mergeable pieces with their scores; ``fallback``: whether an unknown character counts as one
    token for each of its UTF-8 bytes (else runs of unknown symbols count as one).
    """

    def __init__(self, pieces: dict[str, float], *, fallback: bool, dummy_prefix: bool) -> None:
        self.pieces, self.fallback, self.dummy_prefix = pieces, fallback, dummy_prefix
        order = sorted({s for s in pieces.values()}, reverse=True)
        place = {s: i for i, s in enumerate(order)}
        self.rank = {p: place[s] for p, s in pieces.items()}
        #: Pairs of characters that stand next to each other in some piece; between others no merge is possible.
        self.pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            raise ValueError("a piece holds a space after another character; words don't merge on their own")
        self.newline_alone = not any("\n" in p for p in pieces if len(p) > 1)
        self.newline = self._symbol("\n")
        self.chunks = ChunkTable(self._rows)

    @classmethod
    def from_model(cls, path: str) -> PieceCounter:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        if train.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or any(p.type in (4, 5) for p in model.pieces):
            raise ValueError("only BPE models with identity normalisation and plain pieces are counted")
        return cls({p.piece: p.score for p in model.pieces if p.type == 1}, fallback=train.byte_fallback, dummy_prefix=norm.add_dummy_prefix)

    def _symbol(self, symbol: str) -> int:
        """Tokens of one final symbol."""
        return 1 if symbol in self.rank or not self.fallback else len(symbol.encode("utf-8", "surrogatepass"))

    def merged(self, part: str) -> int:
        """Tokens of a part, by merging: a heap of adjacent pairs by rank and place, a linked list of symbols."""
        n = len(part)
        rank = self.rank.get
        if n == 1:
            return self._symbol(part)
        if rank(part) is not None and n == 2:
            return 1
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(part[i : i + 2])) is not None]
        if not heap:
            return n if all(c in self.rank for c in part) else sum(map(self._symbol, part))
        heapq.heapify(heap)
        size = [1] * n  # characters of the symbol that starts here; 0: merged into an earlier one
        before = list(range(-1, n - 1))
        merges, pop, push = 0, heapq.heappop, heapq.heappush
        while heap:
            _, i, width = pop(heap)
            a = size[i]
            j = i + a
            if not a or j >= n or a + size[j] != width:
                continue  # one of the two was merged meanwhile
            size[i], size[j] = width, 0
            merges += 1
            end = i + width
            if end < n:
                before[end] = i
                if (r := rank(part[i : end + size[end]])) is not None:
                    push(heap, (r, i, width + size[end]))
            if (p := before[i]) >= 0 and (r := rank(part[p:end])) is not None:
                push(heap, (r, p, end - p))
        count = n - merges
        for i in range(n):
            if size[i] == 1 and part[i] not in self.rank:
                count += self._symbol(part[i]) - 1
        return count

    def segment(self, text: str) -> int:
        """Tokens of a text whose spaces are already escaped, cut wherever no piece can span."""
        pairs, start, total = self.pairs, 0, 0
        for i, pair in enumerate(map("".join, zip(text, text[1:])), 1):
            if pair not in pairs:
                total += self.merged(text[start:i])
                start = i
        return total + self.merged(text[start:]) if text else total

    def count(self, text: str | None) -> int:
        """Tokens of a text; 0 for null or empty."""
        return self.count_many([text])[0]

    def count_many(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; 0 for null or empty."""
        out = [0] * len(texts)
        easy = []
        for i, t in enumerate(texts):
            if t and (SPACE in t or "  " in t or not self.newline_alone or not self.dummy_prefix or t[0] in " \n" or t[-1] == " " or "\n " in t):
                whole = (SPACE if self.dummy_prefix else "") + t.replace(" ", SPACE)
                out[i] = sum(self.segment(x) for x in re.findall(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", whole))
            elif t:
                easy.append(i)
        if easy:
            # A text begins with a space of its own instead of the table's line feed.
            counts, _, chunks = self.chunks.rows([f" {texts[i]}" for i in easy])
            ends = np.cumsum(chunks)
            sums = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
            for i, n in zip(easy, (sums[ends] - sums[ends - chunks] - self.newline).tolist(), strict=True):
                out[i] = n
        return out

    def _rows(self, chunks: list[str]) -> list[np.ndarray]:
        """Counts of chunks. What ends in a character that no piece holds after the one before it counts apart."""
        known: dict[str, int] = {}

        def of(word: str) -> int:
            n = known.get(word)
            if n is None:
                if len(word) > 2 and word[-2:] not in self.pairs:
                    n = of(word[:-1]) + self._symbol(word[-1]) if len(word) < 200 else self.segment(word)
                else:
                    n = self.segment(word)
                known[word] = n
            return n

        out = []
        for c in chunks:
            word = SPACE + c[1:] if c[0] == " " else c[1:]
            out.append((self.newline if c[0] == "\n" else 0) + (of(word) if word else 0))
        return [np.array([n], np.uint32) for n in out]


class ChunkEncoder:
    """Ids of whole texts as a ``tokenizers`` file gives them, from a table of the ids of chunks.

    ``keep_spaces`` is for byte-level vocabularies, where a chunk takes the one space or line feed before it along; without,
    white space is dropped by the tokenizer and chunks are what stands between spaces or line feeds. Texts in which such
    cuts might fall inside one unit of the tokenizer are encoded whole.
    """

    OTHER_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

    def __init__(self, path: str, *, keep_spaces: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's own threads would only contend
        from tokenizers import Tokenizer

        self.tok, self.keep_spaces = Tokenizer.from_file(path), keep_spaces
        self.tok.no_truncation()
        self.tok.no_padding()
        self.vocab_size = self.tok.get_vocab_size(with_added_tokens=True)
        if any(not t.content.startswith("<|") for t in self.tok.get_added_tokens_decoder().values()):
            raise ValueError("an added token doesn't begin with <|")
        self.stops = {c: self._whole(c) for c in ".,"}
        self.newline = self._whole("\n")
        self.chunks = ChunkTable(self._rows)
        # A character that is one token by itself tells chunks apart in a call for many of them.
        self.mark = "\n" if keep_spaces else next(c for c in "|~^_{@#" if len(self._ids(c)) == 1)
        self.mark_id = self._ids(self.mark)[0]

    def _ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def _whole(self, text: str) -> bytes:
        return np.asarray(self._ids(text), "<u4").tobytes()

    def _fill(self, words: set[str], cache: dict[str, bytes], lead: str) -> None:
        """Encode chunks that the table lacks, many in one string with a mark between them.

        A full stop or comma after a Latin letter is a unit of its own for these tokenizers, so it is added apart.
        """
        ended = [w for w in words if len(w) > 1 and w[-1] in ".," and w[-2] < "\u0250" and w[-2].isalpha()]
        chunks = words.difference(ended)
        chunks.update(c for w in ended if (c := w[:-1]) not in cache)
        plain = list(chunks)
        groups, joined = [], []
        glue = self.mark if self.keep_spaces else f" {self.mark} "
        for at in range(0, len(plain), 200):
            g = plain[at : at + 200]
            text = glue.join([lead + c for c in g])
            if text.count(self.mark) == len(g) - 1 and "<|" not in text and all(g):  # no mark inside, nor what may begin a special string
                groups.append(g)
                joined.append(text)
            else:
                for c in g:
                    cache[c] = self._whole(lead + c)
        for some, got in zip(groups, self.tok.encode_batch_fast(joined, add_special_tokens=False), strict=True):
            ids = np.asarray(got.ids, "<u4")
            ends = (4 * np.append(np.flatnonzero(ids == self.mark_id), len(ids))).tolist()
            data, begin = ids.tobytes(), 0
            for c, end in zip(some, ends, strict=True):
                cache[c] = data[begin:end]
                begin = end + 4
        for w in ended:
            cache[w] = cache[w[:-1]] + self.stops[w[-1]]

    def _rows(self, chunks: list[str]) -> list[np.ndarray]:
        """Ids of chunks."""
        made: dict[str, bytes] = {}
        if self.keep_spaces:
            spaced, first = {c[1:] for c in chunks if c[0] == " "}, {c[1:] for c in chunks if c[0] != " "}
            heads: dict[str, bytes] = {}
            self._fill(spaced, made, " ")
            self._fill(first, heads, "")
            return [np.frombuffer(made[c[1:]] if c[0] == " " else self.newline + heads[c[1:]], "<u4") for c in chunks]
        self._fill({c[1:] for c in chunks}, made, "")
        return [np.frombuffer(made[c[1:]], "<u4") for c in chunks]

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids, as little-endian unsigned 32-bit integers; nothing for null or empty."""
        easy, whole = [], set()
        for i, t in enumerate(texts):
            if not t:
                continue
            if self.keep_spaces and ("  " in t or "\n\n" in t or " \n" in t or "\n " in t or t[0] in " \n" or t[-1] in " \n" or any(c in t for c in self.OTHER_SPACES)):
                whole.add(i)
            else:
                easy.append(i)
        data, at, of = b"", 0, {}
        if easy:
            ids, length, chunks = self.chunks.rows([texts[i] for i in easy])
            sums = np.concatenate(([0], np.cumsum(length)))
            ends = np.cumsum(chunks)
            skip = len(self.newline) if self.keep_spaces else 0
            data = ids.astype("<u4", copy=False).tobytes()
            of = dict(zip(easy, zip((4 * sums[ends - chunks] + skip).tolist(), (4 * sums[ends]).tolist(), strict=True), strict=True))
        for i, t in enumerate(texts):
            if i in whole:
                yield self._whole(t)
            else:
                at, end = of.get(i, (0, 0))
                yield data[at:end]


_MADE: dict[tuple, object] = {}


def of_worker(key: tuple, make: Callable[[], object]) -> object:
    """An object of the worker process, made at first use and kept for later tasks until another operator needs its own."""
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def text_groups(texts: pd.Series, chars: int = GROUP_CHARS) -> Iterator[slice]:
    """Slices of a batch with about so many characters each, so that a batch of long texts is handled in parts."""
    start, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) if t else 0
        if total >= chars:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def token_counts(docs: DataFrame, model: str = "piece_bpe_32k.model", *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """``<id>, n_bytes, n_tokens, over_limit`` of every row, in a single pass without a shuffle.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows are counted each; other columns don't matter.
    ``model`` is the name of a SentencePiece BPE model among the public tokenizers.
    """

    def count(batches):
        counter = of_worker(("count", model), lambda: PieceCounter.from_model(tokenizer_path(model)))
        for batch in batches:
            counts = [n for some in text_groups(batch["text"]) for n in counter.count_many(batch["text"].iloc[some].tolist())]
            yield pd.DataFrame({id_col: exact_ids(batch, "id"), "n_bytes": batch["n_bytes"], "n_tokens": counts})

    text = column(docs, text_col, "string")
    rows = docs.select(*flagged(column(docs, id_col, "long"), "id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInPandas(count, f"`{id_col}` long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every whole text of ``documents``."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
