"""The text of one field of a JSON object that arrives in fragments, as an automaton whose state is a few values.

Fragments may end anywhere: inside a key, an escape or between the halves of a surrogate pair. Only a key of the outermost object counts, not
the same word in a string or in an inner object. Text is given as soon as it is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

# The single-letter escapes of JSON.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
STATE = "role string, depth int, key string, word string, escape string, high int, reading boolean, done boolean"
#: Outside strings; a string is a key, the wanted value or any other.
OUT, KEY, VALUE, OTHER = "out", "key", "value", "other"


class FieldReader:
    """Feed fragments in order; each call gives what they add to the field's text. ``state`` is a tuple after ``STATE``."""

    def __init__(self, field: str, state: tuple | None = None) -> None:
        self.field = field
        # the escape begun (backslash and what follows), a high surrogate that waits for its other half, whether a value comes next
        self.role, self.depth, self.key, self.word, self.escape, self.high, self.reading, self.done = state or (OUT, 0, "", "", "", 0, False, False)

    @property
    def state(self) -> tuple:
        return self.role, self.depth, self.key, self.word, self.escape, self.high, self.reading, self.done

    def feed(self, text: str) -> str:
        out: list[str] = []
        at, n = 0, len(text)
        while at < n and not self.done:
            if self.escape:
                at = self._escaped(text, at, out)
            elif self.role == OUT:
                self._structure(text[at])
                at += 1
            elif text[at] == "\\":
                self.escape = "\\"
                at += 1
            elif text[at] == '"':
                self._settle(out)
                if self.role == VALUE:
                    self.done = True
                elif self.role == KEY:
                    self.key = self.word
                self.role, self.word = OUT, ""
                at += 1
            else:
                ends = [e for e in (text.find('"', at), text.find("\\", at)) if e >= 0]
                end = min(ends, default=n)
                self._take(text[at:end], out)
                at = end
        return "".join(out)

    def _structure(self, c: str) -> None:
        if c in "{[":
            self.depth += 1
            if self.depth == 1:
                self.reading = c == "["
        elif c in "}]":
            self.depth -= 1
        elif c == '"':
            wanted = self.depth == 1 and self.reading and self.key == self.field
            self.role = VALUE if wanted else KEY if self.depth == 1 and not self.reading else OTHER
        elif self.depth == 1 and c in ":,":
            self.reading = c == ":"

    def _escaped(self, text: str, at: int, out: list[str]) -> int:
        self.escape += text[at]
        if self.escape[1] != "u":
            self._take(ESCAPES.get(self.escape[1], self.escape[1]), out)
            self.escape = ""
        elif len(self.escape) == 6:
            try:
                code = int(self.escape[2:], 16)
            except ValueError:
                code = 0xFFFD
            self.escape = ""
            if self.high and 0xDC00 <= code < 0xE000:
                code, self.high = 0x10000 + ((self.high - 0xD800) << 10) + code - 0xDC00, 0
            if 0xD800 <= code < 0xDC00:
                self._settle(out)
                self.high = code
            else:
                self._take(chr(code) if not 0xDC00 <= code < 0xE000 else "�", out)
        return at + 1

    def _settle(self, out: list[str]) -> None:
        """A high surrogate without its other half."""
        if self.high:
            self.high = 0
            self._take("�", out)

    def _take(self, piece: str, out: list[str]) -> None:
        self._settle(out)
        if self.role == VALUE:
            out.append(piece)
        elif self.role == KEY:
            self.word += piece


def field_table(fragments: DataFrame, field: str, keys: list[str], seq: str, text: str) -> DataFrame:
    """``keys, seq, piece``: what each fragment adds to the field's text, from a table of fragments; rows stream past in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, reader = None, None
        for pdf in batches:
            pieces = []
            for key, part in zip(zip(*(pdf[k] for k in keys)), pdf["fragment"]):
                if key != now:
                    now, reader = key, FieldReader(field)
                pieces.append(reader.feed(part or ""))
            yield pdf[[*keys, "seq"]].assign(piece=pieces)

    rows = fragments.select(*keys, F.col(seq).cast("long").alias("seq"), F.col(text).alias("fragment")).dropna(subset=keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInPandas(run, f"{schema}, seq long, piece string")


class Fragments(StatefulProcessor):
    """The automaton of each key; fragments that come early wait for those before them. All of a key's state ends ``ttl`` after its last write."""

    def __init__(self, field: str, ttl_ms: int) -> None:
        self.field, self.ttl_ms = field, ttl_ms

    def init(self, handle) -> None:
        self.reader = handle.getValueState("reader", f"next long, {STATE}", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "seq long", "fragment string", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        following, *state = self.reader.get() if self.reader.exists() else (0,)
        reader, out = FieldReader(self.field, tuple(state) or None), []
        here = {int(s): f or "" for pdf in rows for s, f in zip(pdf["seq"], pdf["fragment"])}
        early = dict(sorted(here.items()))
        while not reader.done:
            if following in early:
                fragment = early.pop(following)
            elif self.waiting.containsKey((following,)):
                fragment = self.waiting.getValue((following,))[0]
                self.waiting.removeKey((following,))
            else:
                break
            out.append((following, reader.feed(fragment)))
            following += 1
        for seq, fragment in early.items():
            if seq >= following and not reader.done:
                self.waiting.updateValue((seq,), (fragment,))
        if reader.done:
            self.waiting.clear()
        self.reader.update((following, *reader.state))
        yield pd.DataFrame([(key[0], s, p) for s, p in out], columns=["key", "seq", "piece"])

    def close(self) -> None:
        pass


def field_stream(fragments: DataFrame, field: str, key: str, seq: str, text: str, ttl: str = "1 hour") -> DataFrame:
    """``key, seq, piece`` as fragments, numbered from 0 in each key, arrive in any order; nothing is given again."""
    rows = fragments.where(f"`{key}` is not null").select(F.col(key).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(text).alias("fragment"))
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    return rows.groupBy("key").transformWithStateInPandas(statefulProcessor=Fragments(field, ttl_ms), outputStructType="key string, seq long, piece string", outputMode="Append", timeMode="ProcessingTime")


def cut(rows: DataFrame, text: str, keys: list[str], longest: int = 7) -> DataFrame:
    """``keys, seq, fragment``: texts cut into fragments of 1 to ``longest`` characters, one length a row."""
    step = (F.pmod(F.xxhash64(*keys), F.lit(longest)) + 1).cast("int")
    n = F.ceil(F.length(text) / step).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.substring(F.col(text), k * step + 1, step))
    return rows.select(*keys, F.posexplode(parts).alias("seq", "fragment"))
