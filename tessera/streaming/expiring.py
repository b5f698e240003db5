"""Keyed state that expires: folds over events in time order, with one set of rules for tables and for streams.

A ``Fold`` holds one value and a bounded list of items for each key, and takes one row at a time. ``fold_table`` streams
a sorted table past it. ``fold_stream`` runs it in ``transformWithState``: rows wait in list state until the watermark has passed them and are then
taken in order, so late and shuffled micro-batches give the same as the table; an event-time timer removes a key's whole
state once its last row is older than the time to live. As a row that comes after that time starts afresh in either form, removal
never changes a result, and idle keys cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Microseconds of a second; times are longs in microseconds.
SECOND = 1_000_000
DAY = 86_400 * SECOND


@dataclass(frozen=True)
class Fold:
    """Rules over rows ``(at, id, *row)``: ``row``, ``value``, ``item`` and ``out`` are schemas of what they read, keep and give."""

    ttl: int
    row: str = ""
    value: str = "n long"
    item: str = ""
    out: str = ""

    def start(self) -> tuple:
        return (0,)

    def step(self, value: tuple, items: list[tuple], row: tuple) -> tuple[tuple, list[tuple], list[tuple]]:
        """The new value and items, and what the row gives."""
        raise NotImplementedError


@dataclass(frozen=True)
class TopicBuffer(Fold):
    """A channel's rolling buffer: the last ``cap`` messages that the buffer doesn't hold yet, and a summary every ``every`` messages.

    Each message counts. One without content, or whose speaker, content and time the buffer holds, isn't put into it.
    A summary reads the whole buffer and leaves the last ``overlap`` messages for the next one.
    """

    ttl: int = 7 * DAY
    row: str = "speaker string, content string"
    item: str = "id long, speaker string, content string, at long"
    out: str = "id long, n long, size long, first_id long, last_id long"
    cap: int = 60
    overlap: int = 10
    every: int = 30

    def step(self, value, items, row):
        at, key, speaker, content = row
        n, content = value[0] + 1, (content or "").strip(" ")
        if content and (speaker, content, at) not in {x[1:] for x in items}:
            items = [*items, (key, speaker, content, at)][-self.cap :]
        if n % self.every or not items:
            return (n,), items, []
        return (n,), items[-self.overlap :], [(key, n, len(items), items[0][0], items[-1][0])]


@dataclass(frozen=True)
class TtlCache(Fold):
    """Whether a key was written less than ``ttl`` before; each row writes it."""

    ttl: int = DAY
    value: str = "written long"
    out: str = "id long, hit boolean"

    def start(self):
        return (None,)

    def step(self, value, items, row):
        at, key = row
        return (at,), items, [(key, value[0] is not None)]


@dataclass(frozen=True)
class History(Fold):
    """The last ``cap`` rows of a key. Each row gives how many are kept with it and the oldest of them."""

    ttl: int = 7 * DAY
    item: str = "id long"
    out: str = "id long, kept long, oldest_id long"
    cap: int = 100

    def step(self, value, items, row):
        items = [*items, (row[1],)][-self.cap :]
        return (value[0] + 1,), items, [(row[1], len(items), items[0][0])]


def names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(",") if c.strip()]


def taken(fold: Fold, value: tuple, items: list[tuple], last: int | None, rows: Iterator[tuple]) -> tuple[tuple, list[tuple], int | None, list[tuple]]:
    """State and results after rows in order; what is as old as the time to live is forgotten first."""
    out = []
    for row in rows:
        if last is not None and row[0] >= last + fold.ttl:
            value, items = fold.start(), []
        value, items, found = fold.step(value, items, row)
        out += found
        last = row[0]
    return value, items, last, out


def _plain(pdf: pd.DataFrame) -> Iterator[tuple]:
    """Rows as tuples of plain values, missing ones as None."""
    columns = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in pdf.columns]
    return zip(*columns)


def _input(rows: DataFrame, fold: Fold, key: str, at: str, id_col: str) -> DataFrame:
    kept = [F.col(c) for c in names(fold.row)]
    return rows.where(f"`{key}` is not null").select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(id_col).cast("long").alias("id"), *kept)


def fold_table(rows: DataFrame, fold: Fold, key: str, at: str, id_col: str) -> DataFrame:
    """``key`` (a string) and what the fold gives, over rows in order of time and id; a task holds one batch and one key's state.

    Rows without key are left out; ``rows`` has the fold's own columns besides.
    """
    out = ["key", *names(fold.out)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, (fold.start(), [], None)
        for pdf in batches:
            found = []
            for key_, part in pdf.groupby("key", sort=False):
                if key_ != now:
                    now, state = key_, (fold.start(), [], None)
                *state, given = taken(fold, *state, _plain(part.drop(columns="key")))
                found += [(key_, *g) for g in given]
            yield pd.DataFrame(found, columns=out)

    ordered = _input(rows, fold, key, at, id_col).repartition("key").sortWithinPartitions("key", "at", "id")
    return ordered.mapInPandas(run, f"key string, {fold.out}")


class Expiring(StatefulProcessor):
    """A fold as a stateful processor: rows wait for the watermark, idle keys are removed."""

    def __init__(self, fold: Fold) -> None:
        self.fold = fold

    def init(self, handle) -> None:
        self.handle = handle
        own = f", {self.fold.row}" if self.fold.row else ""
        self.waiting = handle.getListState("waiting", f"at long, id long{own}")
        self.value = handle.getValueState("value", f"last long, {self.fold.value}")
        self.items = handle.getListState("items", self.fold.item) if self.fold.item else None

    def handleInputRows(self, key, rows, timerValues):
        found = [row for pdf in rows for row in _plain(pdf[["at", "id", *names(self.fold.row)]])]
        self.waiting.appendList(found)
        for at in {max(r[0] for r in found), min(r[0] for r in found)}:
            self.handle.registerTimer(at // 1000 + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2])
        due = [r for r in waiting if r[0] < passed]
        last, *value = self.value.get() if self.value.exists() else (None, *self.fold.start())
        items = [tuple(r) for r in self.items.get()] if self.items is not None else []
        value, items, last, out = taken(self.fold, tuple(value), items, last, iter(due))
        rest = waiting[len(due) :]
        if due:
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(rest[0][0] // 1000 + 1)
            else:
                self.waiting.clear()
        if last is not None and last + self.fold.ttl <= passed:
            self.value.clear()
            if self.items is not None:
                self.items.clear()
        elif due:
            self.value.update((last, *value))
            if self.items is not None:
                self.items.put(items) if items else self.items.clear()
            self.handle.registerTimer((last + self.fold.ttl) // 1000 + 1)
        columns = ["key", *names(self.fold.out)]
        yield pd.DataFrame([(key[0], *g) for g in out], columns=columns)

    def close(self) -> None:
        pass


def fold_stream(rows: DataFrame, fold: Fold, key: str, at: str, id_col: str, late: str = "1 hour") -> DataFrame:
    """The same over a stream, in append mode: a row counts once the watermark, ``late`` behind the latest, has passed it.

    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``). Rows later than the watermark are lost.
    """
    held = _input(rows, fold, key, at, id_col).withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", late)
    return held.groupBy("key").transformWithStateInPandas(
        statefulProcessor=Expiring(fold), outputStructType=f"key string, {fold.out}", outputMode="Append", timeMode="EventTime"
    )
