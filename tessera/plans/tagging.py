"""Phrases and rules over whole documents: entity mentions by the longest alias, and rule tables applied in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import phrases, rules
from ..sources.tables import table
from ._catalog import Register

query = Register()

_RUNS = """said AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark WHERE text IS NOT NULL),
runs AS (SELECT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, unnest([2, 3, 4]) AS n FROM said)) WHERE i > 0),
plain AS (SELECT * FROM runs WHERE regexp_full_match(phrase, '[\\p{L}\\p{N}_]+( [\\p{L}\\p{N}_]+)*'))"""
#: Every run of tokens of each document, as long as some phrase, that may be one of ``phrases(phrase, payload)``; then the leftmost and longest.
_FINDS = """tok AS (
  SELECT doc_id, i, t, lower(t) AS l, regexp_full_match(t, '[\\p{L}\\p{N}_]+') AS word, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) AS stop
  FROM (SELECT doc_id, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '(?s)[\\p{L}\\p{N}_]+|.') AS ts FROM documents WHERE text IS NOT NULL))),
win AS (
  SELECT doc_id, stop - length(t) AS start, l || lead(l, 1) OVER w || lead(l, 2) OVER w AS p3, lead(stop, 2) OVER w AS e3, word,
    l || lead(l, 1) OVER w || lead(l, 2) OVER w || lead(l, 3) OVER w || lead(l, 4) OVER w AS p5, lead(stop, 4) OVER w AS e5,
    l || lead(l, 1) OVER w || lead(l, 2) OVER w || lead(l, 3) OVER w || lead(l, 4) OVER w || lead(l, 5) OVER w || lead(l, 6) OVER w AS p7, lead(stop, 6) OVER w AS e7
  FROM tok WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
cand AS (
  SELECT doc_id, start, max_by((stop, payload), stop) AS best FROM (
    SELECT doc_id, start, e3 AS stop, p3 AS phrase FROM win WHERE word UNION ALL SELECT doc_id, start, e5, p5 FROM win WHERE word UNION ALL SELECT doc_id, start, e7, p7 FROM win WHERE word)
  JOIN phrases USING (phrase) GROUP BY doc_id, start),
folded AS (
  SELECT doc_id, list_reduce(list_prepend({'s': 0::BIGINT, 'e': 0::BIGINT, 'p': []::BIGINT[]}, list({'s': start::BIGINT, 'e': best[1]::BIGINT, 'p': []::BIGINT[]} ORDER BY start)),
    lambda a, x: CASE WHEN x.s >= a.e THEN {'s': x.s, 'e': x.e, 'p': list_append(a.p, x.s)} ELSE a END).p AS starts
  FROM cand GROUP BY doc_id),
finds AS (SELECT c.doc_id, c.start, c.best[1] AS stop, c.best[2] AS payload FROM (SELECT doc_id, unnest(starts) AS start FROM folded) f JOIN cand c USING (doc_id, start))"""


def _runs(spark, sf) -> DataFrame:
    """``item_id, n, phrase``: runs of 2 to 4 neighbouring words of the benchmark texts without anything but a blank between them."""
    w = F.split("text", " ")
    said = table(spark, sf, "benchmark").where("text is not null").select("item_id", w.alias("w"), F.explode(F.array(*map(F.lit, (2, 3, 4)))).alias("n"))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " "))
    rows = said.where("size(w) >= n").select("item_id", "n", F.explode(runs).alias("phrase"))
    return rows.where(F.regexp_like("phrase", F.lit("^[\\p{L}\\p{N}_]+( [\\p{L}\\p{N}_]+)*$")))


@query(f"""WITH {_RUNS},
phrases AS (
  SELECT lower(phrase) AS phrase, min(payload) AS payload FROM (
    SELECT phrase, 'item:' || item_id AS payload FROM plain UNION ALL SELECT p_name, 'part:' || p_name FROM part) GROUP BY 1),
{_FINDS}
SELECT doc_id AS id, start::INT AS start, stop::INT AS stop, payload AS canonical FROM finds""")
def entity_mentions(spark, sf):
    """Names of parts and runs of words of the benchmark, found in all documents: the longest alias, leftmost first."""
    aliases = _runs(spark, sf).select(F.col("phrase").alias("alias"), F.concat(F.lit("item:"), "item_id").alias("canonical"))
    aliases = aliases.union(table(spark, sf, "part").select("p_name", F.concat(F.lit("part:"), "p_name")))
    return phrases.mentions(table(spark, sf, "documents"), aliases)


@query(f"""WITH {_RUNS},
ruled AS (
  SELECT phrase, (n, item_id, CASE n WHEN 2 THEN 'strip' WHEN 3 THEN 'replace' WHEN 4 THEN CASE WHEN item_id % 2 = 0 THEN 'label' ELSE 'reject' END END, CASE WHEN n < 4 THEN '[' || item_id || ']' ELSE 'topic ' || item_id END) AS payload FROM plain),
phrases AS (SELECT lower(phrase) AS phrase, min(payload) AS payload FROM ruled GROUP BY 1),
{_FINDS},
sums AS (
  SELECT doc_id, count(*) AS n, sum(CASE payload[3] WHEN 'strip' THEN start - stop WHEN 'replace' THEN start - stop + length(payload[4]) ELSE 0 END) AS change,
    min(payload[2]) FILTER (payload[3] = 'label') AS label, min(payload[2]) FILTER (payload[3] = 'reject') AS rejected_by FROM finds GROUP BY doc_id)
SELECT doc_id, (length(text) + coalesce(change, 0))::INT AS n_chars, 'topic ' || label AS label, rejected_by, coalesce(n, 0)::INT AS n_rules FROM documents LEFT JOIN sums USING (doc_id)""")
def rule_table(spark, sf):
    """Thousands of rules over all documents in one pass: pairs of words go, triples are replaced, runs of four label or reject."""
    n, of = F.col("n"), F.col("item_id").cast("string")
    action = F.when(n == 2, "strip").when(n == 3, "replace").otherwise(F.when(F.col("item_id") % 2 == 0, "label").otherwise("reject"))
    value = F.when(n < 4, F.concat(F.lit("["), of, F.lit("]"))).otherwise(F.concat(F.lit("topic "), of))
    table_ = _runs(spark, sf).select(F.col("item_id").cast("long").alias("rule_id"), "phrase", action.alias("action"), value.alias("value"), n.cast("int").alias("priority"))
    ruled = rules.apply_rules(table(spark, sf, "documents").select("doc_id", "text"), table_)
    return ruled.select("doc_id", F.length("text").alias("n_chars"), "label", "rejected_by", "n_rules")
