"""Streams with state by key: the best record of each barcode so far, and day totals that late and repeated changes can't spoil.

State lives in RocksDB on the executors and in the query's checkpoint, so memory doesn't grow with the keys. A micro-batch
touches only the keys that it holds rows of, and says only what has changed of them; whoever reads the stream as a table
keeps the last row of each key (:func:`platewise.streaming.live.keep_current` with ``live_upsert``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.foods import gtin_ok, reject_reason, upstream_error
from ..operators.staging import setting
from .live import keep_current, live_upsert

#: The only store of state that keyed processors work with.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
#: Figures are added up as whole numbers of millionths, so that taking one away leaves exactly what was there before it.
MILLIONTHS = 1_000_000


class BestRecord(StatefulProcessor):
    """State: a key's best record, as its rank and its text, and how many rows of the key there have been."""

    def __init__(self, ranks: int, ttl_ms: int | None) -> None:
        self.ranks, self.ttl_ms = ranks, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        """Open the state."""
        fields = ", ".join([*(f"b{i} double" for i in range(self.ranks)), "o long", "record string", "seen long"])
        self.best = handle.getValueState("best", fields, self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Hold a batch's rows, frame by frame, against the best so far; speak up for every key with rows."""
        now, seen = None, 0
        if self.best.exists():
            *rank, record, seen = self.best.get()
            now = (tuple(rank), record)
        names = [*(f"b{i}" for i in range(self.ranks)), "o"]
        for frame in rows:
            seen += len(frame)
            first = frame.sort_values([*names, "record"], ascending=[False] * self.ranks + [True, True]).iloc[0]
            found = ((*(float(first[n]) for n in names[:-1]), int(first["o"])), first["record"])
            if now is None or self.order(found) < self.order(now):
                now = found
        self.best.update((*now[0], now[1], seen))
        yield pd.DataFrame({"record": [now[1]], "seen": [seen]})

    @staticmethod
    def order(found: tuple) -> tuple:
        """Less is better: high ranks, then the earliest; records as text decide what is left, so that reruns agree."""
        rank, record = found
        return (*(-x for x in rank[:-1]), rank[-1], record)

    def close(self) -> None:
        """Nothing is held open."""


def best_records(stream: DataFrame, key: list[str], best: list[str], order: str, *, ttl_days: int | None = None) -> DataFrame:
    """The best row of each key so far: the columns of ``stream`` and ``seen`` (rows of the key so far), in update mode.

    Best are the greatest values of ``best`` (numbers, null last) and of equals the least ``order`` (a whole number: the row's
    ordinal, null last), so rows may come in any order, late or twice. There is no watermark: a row is never too late.
    With ``ttl_days`` a key is forgotten so long after its last row, and a later one starts anew; such a query looks at the
    clock again and again, so it needs a trigger by time: with ``availableNow`` it would not end.
    """
    ranks = [F.coalesce(F.col(c).cast("double"), F.lit(-math.inf)).alias(f"b{i}") for i, c in enumerate(best)]
    at = F.coalesce(F.col(order).cast("long"), F.lit((1 << 63) - 1)).alias("o")
    group = F.to_json(F.struct(*key)).alias("group")
    rows = stream.select(group, *ranks, at, F.to_json(F.struct(*[F.col(f"`{c}`") for c in stream.columns]), TIMES).alias("record"))
    ttl_ms = None if ttl_days is None else ttl_days * 86_400_000
    out = rows.groupBy("group").transformWithStateInPandas(BestRecord(len(best), ttl_ms), "record string, seen long", "Update", "None" if ttl_ms is None else "ProcessingTime")
    return out.select(F.from_json("record", stream.schema, TIMES).alias("r"), "seen").select("r.*", "seen")


def accepted_products(products: DataFrame) -> DataFrame:
    """Products that pass the gate: a sound barcode, plausible figures, no error upstream."""
    figures = [F.col(c) for c in ("kcal", "protein", "fat", "carbs")]
    return products.filter(gtin_ok(F.col("barcode")) & reject_reason(*figures).isNull() & ~upstream_error(F.col("errors")))


class EntryTotals(StatefulProcessor):
    """State of a user: each entry as its newest change left it, and each day's number of entries and sums."""

    def __init__(self, sums: int, ttl_ms: int | None) -> None:
        self.sums, self.ttl_ms = sums, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        """Open the state."""
        figures = ", ".join(f"v{i} long" for i in range(self.sums))
        self.entries = handle.getMapState("entries", "id string", f"at long, there boolean, day string, {figures}", self.ttl_ms)
        self.days = handle.getMapState("days", "day string", f"entries long, {figures}", None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Take each entry's old figures off its old day and add the new ones to the new day; say what the days touched come to."""
        newest: dict[str, tuple] = {}
        for frame in rows:
            for r in frame.itertuples(index=False):
                row = (int(r.at), bool(r.there), r.day, *(int(x) for x in r[-self.sums :]))
                if r.id not in newest or newest[r.id] < row:
                    newest[r.id] = row
        touched: dict[str, list[int]] = {}

        def add(day: str, sign: int, figures: tuple) -> None:
            if day not in touched:
                touched[day] = list(self.days.getValue((day,))) if self.days.containsKey((day,)) else [0] * (1 + self.sums)
            for i, x in enumerate((1, *figures)):
                touched[day][i] += sign * x

        for id_, row in newest.items():
            old = tuple(self.entries.getValue((id_,))) if self.entries.containsKey((id_,)) else None
            if old is not None and old >= row:
                continue  # late, or the same again
            if old is not None and old[1]:
                add(old[2], -1, old[3:])
            if row[1]:
                add(row[2], 1, row[3:])
            self.entries.updateValue((id_,), row)
        for day, total in touched.items():
            self.days.updateValue((day,), tuple(total))
        if touched:
            yield pd.DataFrame([(day, *total) for day, total in touched.items()], columns=["day", "entries", *(f"v{i}" for i in range(self.sums))]).assign(user=key[0])

    def close(self) -> None:
        """Nothing is held open."""


def entry_totals(changes: DataFrame, sums: list[str], *, user: str = "user_id", ttl_days: int | None = None) -> DataFrame:
    """``<user>, log_date, entries, <sums>``: what days come to, of each day that a micro-batch changes, in update mode.

    ``changes``: the user, ``id``, ``at`` (timestamp or whole number) and ``new`` (a struct with ``log_date`` and the sums;
    null where the entry is deleted). An entry counts as its newest change by ``at`` left it, whatever order changes come
    in: late ones and those that come twice change nothing, an entry may move between days. (Changes of one time are
    ordered by what they say.) A null figure counts as 0. Deleted entries stay known, or an old change would bring them
    back; with ``ttl_days`` an entry is forgotten so long after its last change, its day's totals stay (and the
    trigger must be one by time).
    """
    at = F.unix_micros("at") if dict(changes.dtypes)["at"] == "timestamp" else F.col("at").cast("long")
    figures = [F.round(F.coalesce(F.col(f"new.{c}"), F.lit(0)) * MILLIONTHS).cast("long") for c in sums]
    rows = changes.select(
        F.col(user).cast("string").alias("user"), F.to_json(F.struct("id")).alias("id"), at.alias("at"), F.col("new").isNotNull().alias("there"), F.coalesce(F.col("new.log_date").cast("string"), F.lit("")).alias("day"),
        *[F.coalesce(x, F.lit(0)).alias(f"v{i}") for i, x in enumerate(figures)],
    )
    ttl_ms = None if ttl_days is None else ttl_days * 86_400_000
    schema = ", ".join(["day string", "entries long", *(f"v{i} long" for i in range(len(sums))), "user string"])
    out = rows.groupBy("user").transformWithStateInPandas(EntryTotals(len(sums), ttl_ms), schema, "Update", "None" if ttl_ms is None else "ProcessingTime")
    kind = dict(changes.dtypes)[user]
    return out.select(F.col("user").cast(kind).alias(user), F.to_date("day").alias("log_date"), "entries", *[(F.col(f"v{i}") / MILLIONTHS).alias(c) for i, c in enumerate(sums)])


def with_state(stream: DataFrame, start) -> StreamingQuery:
    """``start()`` with the session set up for keyed state: a query takes its settings when it starts."""
    with setting(stream.sparkSession, spark__sql__streaming__stateStore__providerClass=ROCKS):
        return start()


def keep_best_products(products: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A table kept current of the best accepted record of each barcode: quality, then popularity, then the earliest ``ord``."""
    best = best_records(accepted_products(products), ["barcode"], ["quality", "popularity"], "ord")
    return with_state(products, lambda: keep_current(best, path, checkpoint, live_upsert(["barcode"], "seen"), ["barcode"]))


def keep_day_totals(changes: DataFrame, path: str, checkpoint: str, sums: list[str]) -> StreamingQuery:
    """A table kept current of the totals of each user's days."""
    totals = entry_totals(changes, sums)

    def replace(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        kept = None if before is None else before.select(*batch.columns).join(batch.select("user_id", "log_date"), ["user_id", "log_date"], "left_anti")
        now = batch.filter("entries > 0")
        return now if kept is None else kept.unionByName(now)

    return with_state(changes, lambda: keep_current(totals, path, checkpoint, replace, ["user_id"]))

