"""Plug-in points, routers and projections: what is left to a deployment is a parameter, the rest is relational."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts
from ..operators import core
from ..sources.tables import table
from . import asks, corpus, moods, retrieval
from ._catalog import Literal, Register, case_sql, quoted

query = Register()

#: The strategy for each type of content; what isn't named goes to the last one.
STRATEGIES = [("empty", "none"), ("dialogue", "turns"), ("table", "rows"), ("list", "whole")]


@query(f"SELECT content_type, {case_sql([(f'content_type = {quoted(t)}', quoted(s)) for t, s in STRATEGIES], quoted('paragraphs'))} AS strategy, count(*) AS sections FROM ({corpus.query.sql['content_types']}) GROUP BY ALL")
def chunk_router(spark, sf):
    """How each document would be chunked, by the type of its content."""
    kind = F.col("content_type")
    strategy = F.lit("paragraphs")
    for name, how in reversed(STRATEGIES):
        strategy = F.when(kind == name, how).otherwise(strategy)
    return corpus.content_types(spark, sf).groupBy("content_type", strategy.alias("strategy")).agg(F.count("*").alias("sections"))


#: Stages of the ingestion by mode.
MODES = Literal("modes", "mode string, stages array<string>", [("full", ["scan", "crawl", "clean", "chunk", "embed", "sync", "benchmark"]), ("scan", ["scan"]), ("crawl", ["scan", "crawl"]), ("clean", ["clean"]), ("reingest", ["clean", "chunk", "embed", "sync"]), ("benchmark", ["benchmark"]), ("reviewed", ["crawl", "clean", "chunk"])])


@query(f"WITH {MODES.sql} SELECT mode, k AS step, stages[k] AS stage, k = len(stages) AS last FROM (SELECT *, unnest(range(1, len(stages) + 1)) AS k FROM modes)")
def pipeline_modes(spark, sf):
    rows = MODES.frame(spark, sf).select("mode", F.size("stages").alias("n"), F.posexplode("stages").alias("k", "stage"))
    return rows.select("mode", (F.col("k") + 1).cast("long").alias("step"), "stage", (F.col("k") + 1 == F.col("n")).alias("last"))


_SNIPPETS = asks.query.sql["snippet_filter"]


@query(f"""WITH {retrieval._GOLD}, lore AS (SELECT item_id, doc_id, rank, 1 AS source FROM cand WHERE rank <= {retrieval.RESULTS}), web AS (SELECT item_id, doc_id, rank, 2 AS source FROM ({_SNIPPETS})),
u AS (SELECT item_id, doc_id, min(source) AS source, min(source * 100 + rank) AS place FROM (SELECT * FROM lore UNION ALL SELECT * FROM web) GROUP BY item_id, doc_id)
SELECT item_id, doc_id, CASE source WHEN 1 THEN 'lore' ELSE 'web' END AS source, row_number() OVER (PARTITION BY item_id ORDER BY place, doc_id) AS rank FROM u""")
def multi_source_context(spark, sf):
    """Results of the store and of the web for every question in one list: the store first, each document once."""
    gold = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("gold"))
    lore = retrieval.gold_candidates(gold, table(spark, sf, "documents")).select("item_id", "doc_id", "rank", F.lit(1).alias("source"))
    web = asks.snippet_filter(spark, sf).select("item_id", "doc_id", "rank", F.lit(2).alias("source"))
    both = lore.unionByName(web).groupBy("item_id", "doc_id").agg(F.min("source").alias("source"), F.min(F.col("source") * 100 + F.col("rank")).alias("place"))
    return core.ranked(both, ["item_id"], ["place", "doc_id"]).select("item_id", "doc_id", F.when(F.col("source") == 1, "lore").otherwise("web").alias("source"), "rank")


@query(f"WITH {moods._STATE} SELECT user_id, {' || '.join(f'{quoted(c + ": ")} || floor({c} * 100)::BIGINT || {quoted("%; ")}' for c in moods.CHANNELS)} AS report FROM s")
def emotion_report(spark, sf):
    """The eight channels as one line of percentages."""
    parts = [x for c in moods.CHANNELS for x in (F.lit(f"{c}: "), F.floor(F.col(c) * 100).cast("string"), F.lit("%; "))]
    return moods._states(spark, sf).select("user_id", F.concat(*parts).alias("report"))


ENTITIES = Literal("seed", "name string, kind string, aliases array<string>, region string", [("Mira Vale", "CHARACTER", ["Mira", "The Archer"], "Coast"), ("Salt Harbor", "REGION", ["the port"], None), ("Coastal Union", "FACTION", [], "Coast")], given=("nation", ["n_name", "'PLACE'", "[n_name]", "cast(n_regionkey as varchar(9))"]))


@query(f"""WITH {ENTITIES.sql} SELECT name, kind, len(aliases) AS n_aliases, coalesce(region, '') AS region, CASE kind WHEN 'CHARACTER' THEN 'personality' WHEN 'REGION' THEN 'profile' ELSE 'both' END AS snippet FROM seed""")
def seed_entities(spark, sf):
    """The entities that a registry starts with, and which part of a persona speaks of each kind."""
    snippet = F.when(F.col("kind") == "CHARACTER", "personality").when(F.col("kind") == "REGION", "profile").otherwise("both")
    return ENTITIES.frame(spark, sf).select("name", "kind", F.size("aliases").cast("long").alias("n_aliases"), F.coalesce("region", F.lit("")).alias("region"), snippet.alias("snippet"))


@query("SELECT doc_id, lang, source, n_chars, CASE WHEN length(text) >= 50 THEN lang || ';EnrichedLore' ELSE lang END AS categories, md5(text) AS text_hash FROM documents")
def payload_projection(spark, sf):
    """The columns that a vector's payload may hold; texts long enough count as enriched. Spark reads no other column."""
    return table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars", F.when(F.length("text") >= 50, F.concat("lang", F.lit(";EnrichedLore"))).otherwise(F.col("lang")).alias("categories"), F.md5("text").alias("text_hash"))


@query("""WITH c AS (SELECT conv_id, max(CASE WHEN role = 'system' THEN trim(text) END) AS summary, count(*) FILTER (role = 'user') AS n_user, bool_or(contains(lower(text), 'image')) AS img, bool_or(contains(text, '?')) AS found FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(summary <> '', false) AS has_summary, n_user > 0 AS has_history, CASE WHEN img AND found THEN 'images+retrieved' WHEN img THEN 'images' WHEN found THEN 'retrieved' ELSE 'plain' END AS schema FROM c""")
def section_presence(spark, sf):
    """Which sections of a prompt have content, and the schema that the reply is asked in."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.max(F.when(F.col("role") == "system", F.trim("text"))).alias("summary"), F.count(F.when(F.col("role") == "user", 1)).alias("n_user"), F.bool_or(F.contains(F.lower("text"), F.lit("image"))).alias("img"), F.bool_or(F.contains("text", F.lit("?"))).alias("found")
    )
    schema = F.when(F.col("img") & F.col("found"), "images+retrieved").when(F.col("img"), "images").when(F.col("found"), "retrieved").otherwise("plain")
    return rows.select("conv_id", F.coalesce(F.col("summary") != "", F.lit(False)).alias("has_summary"), (F.col("n_user") > 0).alias("has_history"), schema.alias("schema"))


@query("""WITH l AS (SELECT doc_id, k, ls[k] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM documents)),
p AS (SELECT doc_id, k, CASE WHEN length(line) > 250 THEN string_split(regexp_replace(line, '([.!?]) +([\\p{Lu}\\p{N}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) ELSE [line] END AS parts FROM l WHERE trim(line) <> '')
SELECT doc_id, count(*) AS children, sum(length(part))::BIGINT AS chars, max(length(part)) AS longest FROM (SELECT doc_id, unnest(parts) AS part FROM p) GROUP BY doc_id""")
def line_children(spark, sf):
    """Lines as children, those of over 250 characters by sentences."""
    rows = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.trim("line") != "")
    parts = F.when(F.length("line") > 250, F.split(F.regexp_replace("line", "([.!?]) +([\\p{Lu}\\p{N}])", "$1\u0001$2"), "\u0001")).otherwise(F.array("line"))
    rows = rows.select("doc_id", F.explode(parts).alias("part"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("children"), F.sum(F.length("part").cast("long")).alias("chars"), F.max(F.length("part")).cast("long").alias("longest"))


CHUNKS = Literal("chunks", "id long, raw string", [
    (1, '{"title": "Mira Vale/Story", "text": "<b>Mira</b> left home early and walked along the coast until the harbor of salt came into her view again .", "entities": ["Mira", "the", "Tam"]}'), (2, '{"title": "Stub", "text": "Too short", "entities": []}'), (3, '{"text": "x"'),
    (4, '{"title": "Notes", "text": "License text that says copyright and cookie rules apply to all who read this page in any form at all times ever", "entities": null}'),
])


@query(f"""WITH {CHUNKS.sql}, j AS (SELECT id, CASE WHEN json_valid(raw) THEN raw END AS doc FROM chunks), c AS (SELECT id, doc->>'$.title' AS title, trim(regexp_replace(regexp_replace(doc->>'$.text', '<[^>]*>', '', 'g'), ' +([.,])', '\\1', 'g')) AS body, (doc->'$.entities')::VARCHAR[] AS es FROM j WHERE doc IS NOT NULL),
w AS (SELECT *, len(regexp_extract_all(body, '[^ \\t\\n]+')) AS n FROM c) SELECT id, '[' || split_part(title, '/', 1) || ']' AS prefix, body, array_to_string(list_filter(coalesce(es, []), lambda e: length(e) >= 2 AND e <> 'the' AND contains(body, e)), ';') AS entities,
n < 15 OR length(body) < 20 OR (n < 45 AND regexp_matches(lower(body), 'license|copyright|cookie')) AS dropped FROM w""")
def chunk_json_clean(spark, sf):
    """Stored chunks cleaned: markup and spacing, entities that occur, a prefix, and the gate; lines that are no JSON go."""
    rows = CHUNKS.frame(spark, sf).withColumn("c", F.from_json(F.when(F.try_parse_json("raw").isNotNull(), F.col("raw")), "title string, text string, entities array<string>")).where("c is not null")
    body = F.trim(F.regexp_replace(F.regexp_replace("c.text", "<[^>]*>", ""), " +([.,])", "$1"))
    rows = rows.select("id", "c", body.alias("body")).withColumn("n", texts.word_count(F.col("body")))
    kept = F.filter(F.coalesce("c.entities", F.array().cast("array<string>")), lambda e: (F.length(e) >= 2) & (e != "the") & F.contains("body", e))
    drop = (F.col("n") < 15) | (F.length("body") < 20) | ((F.col("n") < 45) & F.regexp_like(F.lower("body"), F.lit("license|copyright|cookie")))
    return rows.select("id", F.concat(F.lit("["), F.substring_index("c.title", "/", 1), F.lit("]")).alias("prefix"), "body", F.array_join(kept, ";").alias("entities"), drop.alias("dropped"))


@query("""WITH s AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) SELECT event_id, before IS NULL OR ts >= before + INTERVAL 30 SECOND AS acquired FROM s""")
def lock_attempts(spark, sf):
    """Whether each attempt at a user's lock comes after the last one's thirty seconds. Within Spark a key's rows are in one task and need no lock."""
    from pyspark.sql import Window

    before = F.lag("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = table(spark, sf, "events").select("event_id", "ts", before.alias("before"))
    return rows.select("event_id", (F.col("before").isNull() | (F.col("ts") >= F.expr("before + interval 30 seconds"))).alias("acquired"))
