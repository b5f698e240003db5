"""Phrases of several words found in texts: longest first, leftmost first, never overlapping, whole words only, in any case.

A phrase is matched token by token, a token being a run of word characters or any other single character. While the phrases fit
``MAX_PHRASES`` and ``MAX_BYTES``, which is counted first, they are sent to every task as one trie and a text is read once. More of them are
joined by the phrase itself; the choice among overlapping finds is then made over each text's finds in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|\W")
#: Most phrases, and bytes of them, that are sent to every task.
MAX_PHRASES, MAX_BYTES = 200_000, 8 << 20
#: Rows that the join emits between two batches.
BATCH = 20_000
_TRIES: dict[object, PhraseTrie] = {}


def worded(token: str) -> bool:
    return token[0].isalnum() or token[0] == "_"


class PhraseTrie:
    """Phrases as nested dictionaries of lower-cased tokens; of equal phrases the one with the least payload counts."""

    def __init__(self, phrases: Iterable[tuple[str, object]]) -> None:
        self.root: dict = {}
        for phrase, payload in phrases:
            node = self.root
            tokens = TOKEN.findall(phrase.lower())
            for token in tokens:
                node = node.setdefault(token, {})
            if tokens:  # None is no token
                node[None] = min(node.get(None, payload), payload)

    def spans(self, text: str) -> Iterator[tuple[int, int, object]]:
        """Start, end and payload of each find, in characters of the text."""
        tokens = TOKEN.findall(text)
        low, n = [t.lower() for t in tokens], len(tokens)
        i = start = 0
        while i < n:
            node, best = self.root.get(low[i]), None
            if node is not None and (worded(tokens[i]) or not i or not worded(tokens[i - 1])):
                j = i + 1
                while node is not None:
                    if None in node and (j == n or not (worded(tokens[j]) and not worded(tokens[j - 1]))):
                        best = j, node[None]
                    node = node.get(low[j]) if j < n else None
                    j += 1
            end = best[0] if best else i + 1
            stop = start + sum(map(len, tokens[i:end]))
            if best:
                yield start, stop, best[1]
            i, start = end, stop


def sent(phrases: DataFrame, columns: list[str]):
    """The distinct rows of ``phrases`` as a broadcast variable, or None if they are too many to send. One row of counts and at most ``MAX_PHRASES`` rows reach the driver."""
    rows = phrases.select(*columns).where(f"{columns[0]} <> ''").distinct()
    size = rows.agg(F.count("*").alias("n"), F.sum(sum((F.octet_length(F.col(c).cast("string")) for c in columns), F.lit(0))).alias("b")).first()
    if size["n"] > MAX_PHRASES or (size["b"] or 0) > MAX_BYTES:
        return None
    return phrases.sparkSession.sparkContext.broadcast([tuple(r) for r in rows.collect()])


def trie_of(variable) -> PhraseTrie:
    """The trie of broadcast rows (phrase, payload ...), built once in each worker."""
    rows = variable.value
    if id(rows) not in _TRIES:
        _TRIES.clear()
        _TRIES[id(rows)] = PhraseTrie((r[0], r[1] if len(r) == 2 else r[1:]) for r in rows)
    return _TRIES[id(rows)]


def mentions(docs: DataFrame, aliases: DataFrame, id_col: str = "doc_id", text_col: str = "text", alias_col: str = "alias", name_col: str = "canonical") -> DataFrame:
    """``id, start, stop, canonical``: what ``aliases`` names in each text, in characters.

    Null and empty aliases and null texts find nothing; an alias of several names stands for the least. Rows with equal ids are
    read each for itself. Names are strings.
    """
    pairs = aliases.select(F.col(alias_col).alias("alias"), F.col(name_col).cast("string").alias("canonical")).dropna()
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where("text is not null")
    variable = sent(pairs, ["alias", "canonical"])
    found = _by_trie(rows, variable) if variable is not None else _by_join(rows, pairs)
    return found.withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def _by_trie(rows: DataFrame, variable) -> DataFrame:
    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = trie_of(variable)
        for pdf in batches:
            found = [(i, *span) for i, text in zip(pdf["id"], pdf["text"]) for span in trie.spans(text)]
            yield pd.DataFrame(found, columns=["id", "start", "stop", "canonical"])

    return rows.mapInPandas(find, "id string, start int, stop int, canonical string")


def _by_join(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Runs of as many tokens as some phrase has, joined to the phrases; only the distinct lengths of phrases reach the driver."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: TOKEN.findall(t.lower()))

    phrases = pairs.withColumn("tokens", split("alias")).where("size(tokens) > 0")
    lengths = sorted(r[0] for r in phrases.select(F.size("tokens")).distinct().collect())
    phrases = phrases.groupBy(F.array_join("tokens", "").alias("phrase"), F.size("tokens").alias("size")).agg(F.min("canonical").alias("canonical"))

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["row", "id", "start", "stop", "phrase", "size"]
        held: list[tuple] = []
        for pdf in batches:
            for row, i, text in zip(pdf["row"], pdf["id"], pdf["text"]):
                tokens = TOKEN.findall(text)
                low, at = [t.lower() for t in tokens], [0]
                for t in tokens:
                    at.append(at[-1] + len(t))
                for k in range(len(tokens)):
                    if k and worded(tokens[k - 1]) and not worded(tokens[k]):
                        continue
                    for size in lengths:
                        end = k + size
                        if end > len(tokens):
                            break
                        if end == len(tokens) or not worded(tokens[end]) or worded(tokens[end - 1]):
                            held.append((row, i, at[k], at[end], "".join(low[k:end]), size))
                    if len(held) >= BATCH:
                        yield pd.DataFrame(held, columns=columns)
                        held = []
        yield pd.DataFrame(held, columns=columns)

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free = None, 0
        for pdf in batches:
            keep = []
            for row, start, stop in zip(pdf["row"], pdf["start"], pdf["stop"]):
                if row != now:
                    now, free = row, 0
                keep.append(start >= free)
                free = stop if start >= free else free
            yield pdf.loc[keep, ["id", "start", "stop", "canonical"]]

    schema = "row long, id string, start int, stop int, phrase string, size int"
    found = rows.withColumn("row", F.monotonically_increasing_id()).mapInPandas(runs, schema).join(phrases, ["phrase", "size"])
    ordered = found.repartition("row").sortWithinPartitions("row", "start", F.desc("stop"))
    return ordered.select("row", "id", "start", "stop", "canonical").mapInPandas(choose, "id string, start int, stop int, canonical string")
