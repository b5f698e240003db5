"""Rules over texts, kept as a table and compiled into one trie: a text is read once, however many rules there are.

A rule has a phrase, an action, a value and a priority (the least goes first). Of phrases that overlap the leftmost and
then the longest applies, of rules with one phrase the one with the least priority and then id. ``strip`` takes the phrase out, ``replace`` writes the
value for it, ``label`` gives the text the value, ``reject`` refuses it; a text gets the label of the label rule with the least priority and names
the reject rule with the least one.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .phrases import sent, trie_of

SCHEMA = "rule_id long, phrase string, action string, value string, priority int"
OUT = "text string, label string, rejected_by long, n_rules int"
ACTIONS = ("strip", "replace", "label", "reject")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from JSON lines, one file or a folder; an unknown action or a broken line is an error."""
    rules = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path)
    known = F.col("action").isin(*ACTIONS)
    return rules.withColumn("action", F.when(known, F.col("action")).otherwise(F.raise_error(F.concat(F.lit("unknown action of rule "), F.col("rule_id").cast("string")))))


def applied(trie, text: str) -> tuple[str, str | None, int | None, int]:
    """The text after all rules, its label, the rule that rejects it and how many finds there were."""
    out, labels, rejects, at, n = [], [], [], 0, 0
    for start, stop, (priority, rule, action, value) in trie.spans(text):
        n += 1
        if action == "label":
            labels.append((priority, rule, value))
        elif action == "reject":
            rejects.append((priority, rule))
        else:
            out += [text[at:start], value if action == "replace" else ""]
            at = stop
    return "".join([*out, text[at:]]), min(labels)[2] if labels else None, min(rejects)[1] if rejects else None, n


def apply_rules(docs: DataFrame, rules: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the text as the rules leave it, ``label``, ``rejected_by`` and ``n_rules``.

    A null text stays null and meets no rule; input columns named like an added one are replaced. Rules without phrase do nothing; a
    null priority goes last, a null value writes nothing. Raises ``ValueError`` where the rules are too many to be sent to every task.
    """
    last = F.coalesce(F.col("priority"), F.lit(2**31 - 1)).alias("priority")
    rows = rules.where("phrase is not null and action is not null").select("phrase", last, F.coalesce("rule_id", F.lit(-1)).alias("rule_id"), "action", F.coalesce("value", F.lit("")).alias("value"))
    variable = sent(rows, rows.columns)
    if variable is None:
        raise ValueError("more rules than are sent to every task; split them into several passes")

    @F.pandas_udf(OUT)
    def run(texts: pd.Series) -> pd.DataFrame:
        trie = trie_of(variable)
        rows = [(None, None, None, 0) if t is None else applied(trie, t) for t in texts]
        frame = pd.DataFrame(rows, columns=["text", "label", "rejected_by", "n_rules"])
        return frame.astype({"rejected_by": "Int64", "n_rules": "int32"})

    kept = [c for c in docs.columns if c.lower() not in (text_col.lower(), "label", "rejected_by", "n_rules")]
    done = docs.select(*[F.col(f"`{c}`") for c in kept], run(F.col(text_col)).alias("ruled_"))
    return done.select(*[F.col(f"`{c}`") for c in kept], F.col("ruled_.text").alias(text_col), "ruled_.label", "ruled_.rejected_by", "ruled_.n_rules")


def apply_to_stream(docs: DataFrame, path: str, write: Callable[[DataFrame, int], None], text_col: str = "text"):
    """A stream writer that applies the rules as they are when each micro-batch starts, so that they can be changed while it runs."""

    def batch(rows: DataFrame, batch_id: int) -> None:
        write(apply_rules(rows, read_rules(rows.sparkSession, path), text_col), batch_id)

    return docs.writeStream.foreachBatch(batch)
