"""Audit of how the sources of a language differ in their words, exact in whole numbers.

For each language the terms found in at least ``MIN_DOCS`` of its documents are kept; a source's share of a term is smoothed and scaled
to a whole number, and two sources differ by the sum of ``(p - q)^2 / (p + q)``, rounded down, over all kept terms. Most terms are
absent from most sources, so no dense table of sources and terms is made; a pair's sum over V terms is put together by
inclusion and exclusion over the terms that either source holds:

- a term held by one source is priced against the other's share of an absent term. That depends on the count alone, so each source is
  reduced to a histogram of counts, which is priced once for each other source as if they had no term in common;
- where both hold a term, a join of the postings by language and term takes both one-sided prices back and adds the true one;
- what is left of V holds neither, and each such term costs the same constant.

Postings are summed inside tasks before any shuffle; a hot source is spread by term, and a hot term has a row for each source at most.
The pairs themselves, which the result lists in full, are dealt by language and block of sources, so that no task gets a language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, staged

#: Bytes of a term: ASCII letters and everything beyond ASCII.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
MIN_DOCS, SCALE, TOP = 10, 1_000_000_000, 10
#: Distinct (group, term) entries that a task holds before it hands them on.
HELD = 1 << 20
#: Sources of a block of the pairs.
BLOCK = 64
OUTPUT = ("lang", "source", "part", "item", "value", "rank")


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, docs`` of a task's documents; the empty term counts a group's documents."""
    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def handed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in seen.items():
            terms = list(docs)
            columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array([t.decode() for t in terms], pa.string())]
            yield pa.record_batch([*columns, pa.array([n[t] for t in terms], pa.int64()), pa.array([docs[t] for t in terms], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        seen.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            terms = TERM.findall(text.encode().lower())  # bytes know ASCII letters only
            n.update(terms)
            docs.update({b"", *terms})
        if sum(len(docs) for _, docs in seen.values()) > HELD:
            yield from handed()
    yield from handed()


def div(a: Column, b: Column) -> Column:
    """Whole-number division, rounded down."""
    return F.call_function("div", a, b)


def share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """The smoothed share of a term with ``n`` of ``total`` occurrences, scaled and rounded down, plus 1; null where no term is kept.

    In decimals, as a billion times a count may not fit a long.
    """
    n, total, terms = (F.col(c) if isinstance(c, str) else c for c in (n, total, terms))
    below = (total + 2 * terms).cast("decimal(19,0)")
    return 1 + div(F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)"), F.nullif(below, F.lit(0).cast("decimal(19,0)")))


def gap(p: Column | str, q: Column | str) -> Column:
    """What a term with these shares adds. Shares end at 10^9 + 1, so the square fits a long."""
    p, q = (F.col(c) if isinstance(c, str) else c for c in (p, q))
    return div((p - q) * (p - q), p + q)


def pairs_of(groups: DataFrame) -> DataFrame:
    """Every two sources of a language once: ``lang, a, b, zero_a, zero_b, held_a, held_b, terms`` with ``a < b``.

    Sources are dealt into blocks of about ``BLOCK``; each side goes to the blocks of the other, so a task joins two blocks.
    """
    n_blocks = F.greatest(F.lit(1), F.ceil(F.col("n_sources") / BLOCK).cast("int"))
    every = groups.withColumn("blocks", n_blocks).withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = every.select("lang", "terms", F.col("source").alias("a"), F.col("zero").alias("zero_a"), F.col("held").alias("held_a"), F.col("block").alias("x"), others.alias("y"))
    right = every.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"), F.col("held").alias("held_b"), others.alias("x"), F.col("block").alias("y"))
    return left.join(right, ["lang", "x", "y"]).where("a < b").drop("x", "y")


def source_divergence(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP
) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair`` ranks for each source all others of its language by their distance, part ``term`` the ``top`` terms that a source
    holds beyond its language's share. Null texts, languages and sources are empty strings; repeated rows are documents
    of their own. Ties are ranked by the item's UTF-8 bytes. A source without terms is still compared; a
    language without kept terms has distances of 0. Other columns are left out whatever their names; an empty table gives no rows.
    """
    read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (lang_col, source_col, text_col)])
    parts = read.mapInArrow(counted, "lang string, source string, term string, n long, docs long")
    sums = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    sums = sums.withColumns({"total": F.sum("n").over(term), "found": F.sum("docs").over(term), "least": F.min("source").over(term)})
    # the empty term stands for the group itself
    kept = staged(sums.where((F.col("found") >= min_docs) | (F.col("term") == "")).drop("docs", "found"), "postings")

    real = F.col("term") != ""
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"), F.count_if(real).alias("held"))
    langs = kept.groupBy("lang").agg(F.count_if(real & (F.col("source") == F.col("least"))).alias("terms"), F.sum("n").alias("all"), F.count_if(~real).alias("n_sources"))
    groups = staged(groups.join(langs, "lang").withColumn("zero", share(F.lit(0), "own", "terms")), "groups")
    priced = kept.where(real).join(groups, ["lang", "source"]).withColumn("p", share("n", "own", "terms"))
    priced = staged(priced.withColumn("q", share("total", "all", "terms")).select("lang", "source", "term", "n", "zero", "p", "q"), "shares")
    discard(kept)

    # each pair as if its sources had no term in common ...
    pairs = staged(pairs_of(groups), "pairs")
    histogram = staged(priced.groupBy("lang", "source", "p").agg(F.count("*").alias("m")), "histograms")

    def one_sided(mine: str, other: str) -> DataFrame:
        """Terms of source ``mine`` priced against the other's absent term, by pair."""
        of = pairs.join(histogram.withColumnRenamed("source", mine), ["lang", mine])
        return of.groupBy("lang", "a", "b").agg(F.sum(F.col("m") * gap("p", f"zero_{other}")).alias("part"), F.lit(0).cast("long").alias("both"))

    # ... and what the terms in common change
    x = priced.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    y = priced.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    change = gap("pa", "pb") - gap("pa", "zb") - gap("za", "pb")
    common = x.join(y, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(change).alias("part"), F.count("*").alias("both"))
    parts = one_sided("a", "b").union(one_sided("b", "a")).union(common).groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("both").alias("both"))
    both, part = F.coalesce("both", F.lit(0)), F.coalesce("part", F.lit(0))
    neither = (F.col("terms") - F.col("held_a") - F.col("held_b") + both) * F.coalesce(gap("zero_a", "zero_b"), F.lit(0))
    distances = staged(pairs.join(parts, ["lang", "a", "b"], "left").select("lang", "a", "b", (part + neither).alias("value")), "distances")

    each = distances.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    each = each.union(distances.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = each.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    above = priced.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap("p", "q").alias("value"))
    return pair.union(above.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = {
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
occ AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
vocab AS (SELECT lang, term, count(*) AS total FROM occ GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM vocab GROUP BY lang),
have AS (SELECT lang, source, term, count(*) AS c FROM occ GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM d),
grid AS (
  SELECT g.lang, g.source, w.term, w.total, coalesce(h.c, 0) AS c, sum(coalesce(h.c, 0)) OVER (PARTITION BY g.lang, g.source) AS own
  FROM grp g JOIN vocab w USING (lang) LEFT JOIN have h ON h.lang = g.lang AND h.source = g.source AND h.term = w.term),
shares AS (
  SELECT g.lang, g.source, g.term, g.c, (1 + (1000000000::HUGEINT * (g.c + 2)) // (g.own + 2 * l.v))::BIGINT AS p,
    (1 + (1000000000::HUGEINT * (g.total + 2)) // (l.n + 2 * l.v))::BIGINT AS q
  FROM grid g JOIN langs l USING (lang)),
dist AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(d.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN dist d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
}
