"""Sinks and reads of stored state: every query writes, changes and reads back a table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import core
from ..sources import ledger, page_files, sinks
from ..sources.tables import read_jsonl, table, write_jsonl
from ._catalog import Literal, Register

query = Register()

_MSG = "m AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, text FROM conversations)"


def _messages(spark, sf):
    """Messages as they are stored: whoever isn't the user counts as the assistant."""
    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", F.when(F.col("role") == "user", "user").otherwise("assistant").alias("role"), "text")


@query("""WITH s AS (SELECT o_custkey AS page_id, max(o_orderdate) AS seen, count(*) AS chunks FROM orders GROUP BY 1)
SELECT c_custkey AS page_id, CASE WHEN s.page_id IS NULL THEN 'PENDING' ELSE 'PROCESSED' END AS status, coalesce(chunks, 0) AS chunks FROM customer LEFT JOIN s ON c_custkey = s.page_id""")
def sink_state_upsert(spark, sf):
    """Pages are registered as pending; the processed ones then replace them by key."""
    base = table(spark, sf, "customer").select(F.col("c_custkey").alias("page_id"), F.lit("PENDING").alias("status"), F.lit(0).cast("long").alias("chunks"))
    path = sinks.create(base, "state")
    done = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.lit("PROCESSED").alias("status"), F.count("*").alias("chunks"))
    return sinks.upsert(done, path, ["page_id"])


@query("""WITH n AS (SELECT l_orderkey AS page_id, l_linenumber * 10 AS chunk, l_quantity * 2 AS size FROM lineitem WHERE l_linestatus = 'F')
SELECT l_orderkey AS page_id, l_linenumber::BIGINT AS chunk, l_quantity::DOUBLE AS size FROM lineitem WHERE l_orderkey NOT IN (SELECT page_id FROM n) UNION ALL SELECT page_id, chunk::BIGINT, size::DOUBLE FROM n""")
def sink_page_sync(spark, sf):
    """Changed pages lose all their stored chunks and get the new ones, in one version."""
    li = table(spark, sf, "lineitem")
    path = sinks.create(li.select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("long").alias("chunk"), F.col("l_quantity").cast("double").alias("size")), "vectors")
    new = li.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("page_id"), (F.col("l_linenumber") * 10).cast("long").alias("chunk"), (F.col("l_quantity") * 2).cast("double").alias("size"))
    return sinks.replace_groups(new, path, ["page_id"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def sink_orphan_purge(spark, sf):
    """Stored pages whose owner is no longer active are deleted."""
    path = sinks.create(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "orphans")
    active = table(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    gone = core.orphans(sinks.read(spark, path), active, ["o_custkey"]).select("o_orderkey")
    return sinks.delete_keys(gone, path)


@query("SELECT doc_id, 'sha256:' || sha256(text) AS text_hash, length(text) AS chars FROM documents")
def sink_truncate_load(spark, sf):
    """A full load replaces whatever the table held."""
    docs = table(spark, sf, "documents")
    path = sinks.create(docs.select("doc_id", F.lit("old").alias("text_hash"), F.lit(0).cast("long").alias("chars")), "parents")
    return sinks.write(docs.select("doc_id", F.concat(F.lit("sha256:"), F.sha2("text", 256)).alias("text_hash"), F.length("text").cast("long").alias("chars")), path)


@query(f"""WITH {_MSG} SELECT conv_id, turn, role, length(text) AS chars, true AS is_success FROM m UNION ALL SELECT conv_id, max(turn) + 1, 'user', 0, false FROM m GROUP BY conv_id""")
def sink_message_append(spark, sf):
    """Turns are appended; a failed one is kept with ``is_success`` false, which readers of history leave out."""
    m = _messages(spark, sf)
    good = m.select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"), F.lit(True).alias("is_success"))
    path = sinks.create(good, "messages")
    turn = m.schema["turn"].dataType
    failed = m.groupBy("conv_id").agg((F.max("turn") + 1).cast(turn).alias("turn")).select("conv_id", "turn", F.lit("user").alias("role"), F.lit(0).cast("long").alias("chars"), F.lit(False).alias("is_success"))
    return sinks.append(failed, path)


@query("""WITH k AS (SELECT * FROM events WHERE event_type <> 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup')) SELECT user_id, event_id FROM k""")
def sink_scope_delete(spark, sf):
    """First everything of one scope goes, then everything of the users that asked to be forgotten."""
    ev = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    path = sinks.create(ev, "scoped")
    sinks.delete_where(spark, path, F.col("event_type") == "error")
    return sinks.delete_keys(ev.where("event_type = 'signup'").select("user_id"), path).select("user_id", "event_id")


@query("""WITH m AS (SELECT o_custkey AS user_id, o_orderkey AS id, o_totalprice AS importance, starts_with(o_orderpriority, '1') AS critical FROM orders),
r AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id, critical ORDER BY importance, id) AS rn FROM m) SELECT user_id, id FROM r WHERE critical OR n <= 12 OR rn > n - 12""")
def sink_memory_cap(spark, sf):
    """Memories are stored, then each user's least important non-critical ones beyond twelve are deleted."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("importance"), F.col("o_orderpriority").startswith("1").alias("critical"))
    path = sinks.create(o, "memory")
    stored = sinks.read(spark, path)
    sizes = stored.groupBy("user_id").agg(F.count("*").alias("n")).where("n > 12")
    ranked = core.ranked(stored.where("not critical").join(sizes, "user_id"), ["user_id"], ["importance", "id"], "rn")
    return sinks.delete_keys(ranked.where("rn <= n - 12").select("id"), path).select("user_id", "id")


@query("""WITH c AS (SELECT doc_id, source, len(regexp_extract_all(text, '[^ \\t\\n]+')) AS words, length(text) AS n FROM documents)
SELECT source, sum((words >= 15 AND n >= 20)::INT)::BIGINT AS kept, sum((words < 15 OR n < 20)::INT)::BIGINT AS dropped FROM c GROUP BY source""")
def sink_gated_chunks(spark, sf):
    """Chunks that pass the gate are written, the others counted; both counts by page, from what was written."""
    docs = table(spark, sf, "documents")
    words = F.size(F.regexp_extract_all("text", F.lit("[^ \\t\\n]+"), F.lit(0)))
    keep = (words >= 15) & (F.length("text") >= 20)
    path = sinks.create(docs.where(keep).select("doc_id", "source"), "chunks")
    kept = sinks.read(spark, path).groupBy("source").agg(F.count("*").alias("kept"))
    total = docs.groupBy("source").agg(F.count("*").alias("n"))
    return total.join(kept, "source", "left").select("source", F.coalesce("kept", F.lit(0)).alias("kept"), (F.col("n") - F.coalesce("kept", F.lit(0))).alias("dropped"))


@query("SELECT '---' || chr(10) || 'id: ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || '---' AS front, count(*) AS n FROM documents GROUP BY 1")
def sink_markdown_mirror(spark, sf):
    """Each document becomes a text with front matter, in a folder for its language; the front matter is read back."""
    docs = table(spark, sf, "documents")
    path = sinks.scratch(spark, "mirror")
    page = F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\nlang: "), "lang", F.lit("\n---\n"), "text", F.lit("\n␞"))
    docs.select(F.col("lang").alias("folder"), page.alias("value")).write.option("lineSep", "\n").partitionBy("folder").text(path)
    back = spark.read.option("lineSep", "␞\n").text(path).where("value <> ''")
    front = F.regexp_extract("value", "(?s)^(---\nid: [0-9]+\nlang: [a-z]+\n---)\n", 1)
    return back.select(front.alias("front")).groupBy("front").agg(F.count("*").alias("n"))


@query("SELECT lang, source, count(*) AS pages, min(doc_id) AS first_page FROM documents GROUP BY ALL")
def sink_crawl_layout(spark, sf):
    """Pages stored in folders by category and entity, which come back as columns."""
    path = sinks.scratch(spark, "crawl")
    rows = sinks.write(table(spark, sf, "documents").select("doc_id", "lang", "source"), path, ["lang", "source"])
    return rows.groupBy("lang", "source").agg(F.count("*").alias("pages"), F.min("doc_id").alias("first_page"))


@query("SELECT user_id AS job, count(*) AS transitions, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS changed FROM events GROUP BY user_id")
def sink_job_log(spark, sf):
    """Status changes are only appended; the latest one of each job is its status."""
    ev = table(spark, sf, "events").select(F.col("user_id").alias("job"), "event_id", "event_type", "ts")
    path = sinks.create(ev.where("event_type = 'signup'"), "jobs")
    stored = sinks.append(ev.where("event_type <> 'signup'"), path)
    return stored.groupBy("job").agg(F.count("*").alias("transitions"), F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("changed"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def sink_interaction_clear(spark, sf):
    """All interactions of a user are deleted but the latest."""
    ev = table(spark, sf, "events").select("user_id", "event_id")
    path = sinks.create(ev, "interactions")
    last = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return sinks.change(spark, path, lambda old: old.withColumn("k", F.row_number().over(last)).where("k = 1").drop("k"))


@query("""SELECT user_id, least(min(ts), TIMESTAMP '2000-01-01 00:00:00') AS first_seen, greatest(max(ts), TIMESTAMP '2000-01-01 00:00:00') AS last_seen, 'web_user_' || substr(user_id::VARCHAR, 1, 6) AS username FROM events GROUP BY user_id""")
def sink_user_ensure(spark, sf):
    """A user is made at the first event and seen at the last; what was stored before counts too."""
    seen = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    old = F.lit("2000-01-01 00:00:00").cast(seen.schema["first_seen"].dataType)
    path = sinks.create(seen.select("user_id", old.alias("first_seen"), old.alias("last_seen")), "users")
    both = sinks.read(spark, path).unionByName(seen)
    merged = both.groupBy("user_id").agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return sinks.upsert(merged, path, ["user_id"]).withColumn("username", F.concat(F.lit("web_user_"), F.substring(F.col("user_id").cast("string"), 1, 6)))


@query("""WITH e AS (SELECT user_id || ':' || event_type AS key, max(ts) AS written FROM events GROUP BY ALL), n AS (SELECT max(ts) AS now FROM events)
SELECT key, written + INTERVAL 7 DAY > now AS alive FROM e, n WHERE NOT ends_with(key, ':view')""")
def sink_kv_ttl(spark, sf):
    """Keys with a time to live: the last write wins, a pattern is deleted, and what has expired is told from what is alive."""
    ev = table(spark, sf, "events")
    writes = ev.groupBy(F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("key")).agg(F.max("ts").alias("written"))
    path = sinks.create(writes, "kv")
    kept = sinks.delete_where(spark, path, F.col("key").endswith(":view"))
    now = ev.agg(F.max("ts").alias("now"))
    return kept.crossJoin(F.broadcast(now)).select("key", (F.expr("written + interval 7 days") > F.col("now")).alias("alive"))


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, 0.5::DOUBLE AS trust FROM events GROUP BY user_id")
def sink_state_json(spark, sf):
    """Nested state goes out as JSON and comes back typed, with defaults for what it lacks."""
    state = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    path = sinks.create(state.select("user_id", F.to_json(F.struct(F.struct("n", "total").alias("stats"))).alias("doc")), "json")
    back = sinks.read(spark, path).withColumn("s", F.from_json("doc", "stats struct<n:long,total:double>, emotion struct<trust:double>"))
    return back.select("user_id", F.coalesce("s.stats.n", F.lit(0)).alias("n"), F.col("s.stats.total").alias("total"), F.coalesce("s.emotion.trust", F.lit(0.5)).alias("trust"))


@query("SELECT s_nationkey AS entity, count(*) AS n_aliases, min(s_name) AS first_alias FROM supplier GROUP BY 1")
def sink_dictionary(spark, sf):
    """An entity dictionary written as JSON lines and read under its schema."""
    path = sinks.scratch(spark, "dictionary")
    rows = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("entity")).agg(F.sort_array(F.collect_list("s_name")).alias("aliases"))
    write_jsonl(rows, path)
    back = read_jsonl(spark, path, "entity int, aliases array<string>", strict=True)
    return back.select("entity", F.size("aliases").cast("long").alias("n_aliases"), F.get("aliases", F.lit(0)).alias("first_alias"))


@query("SELECT '| ' || lang || ' | ' || count(*) || ' | ' || max(n_chars) || ' |' AS line FROM documents GROUP BY lang")
def sink_report(spark, sf):
    """A report as lines of a markdown table, written as text and read again."""
    path = sinks.scratch(spark, "report")
    rows = table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max("n_chars").alias("most"))
    rows.select(F.concat(F.lit("| "), "lang", F.lit(" | "), F.col("n").cast("string"), F.lit(" | "), F.col("most").cast("string"), F.lit(" |")).alias("value")).write.text(path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("WITH h AS (SELECT md5(text) AS h, min(doc_id) AS owner FROM documents GROUP BY 1) SELECT doc_id, owner, doc_id <> owner AS hit FROM documents JOIN h ON h.h = md5(text)")
def sink_embedding_cache(spark, sf):
    """A cache keyed by the text's hash: the first document of a text fills it, the others hit it."""
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    path = sinks.create(docs.groupBy("h").agg(F.min("doc_id").alias("owner")), "cache")
    return docs.join(sinks.read(spark, path), "h").select("doc_id", "owner", (F.col("doc_id") != F.col("owner")).alias("hit"))


@query("""WITH e AS (SELECT l_partkey AS source, l_suppkey AS target, l_returnflag AS relation, min(l_orderkey * 10 + l_linenumber) AS first_seen FROM lineitem GROUP BY ALL) SELECT * FROM e""")
def sink_edges(spark, sf):
    """Edges are inserted once: what (source, relation, target) already holds is skipped."""
    li = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target"), F.col("l_returnflag").alias("relation"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_seen"), "l_linestatus")
    first = lambda rows: rows.groupBy("source", "target", "relation").agg(F.min("first_seen").alias("first_seen"))
    path = sinks.create(first(li.where("l_linestatus = 'F'")), "edges")
    late = first(li.where("l_linestatus <> 'F'"))
    return sinks.change(spark, path, lambda old: first(old.unionByName(late)))


@query("SELECT vec_id, label, len(embedding) AS dim, label % 2 = 0 AS recreated FROM embeddings")
def sink_collection_migration(spark, sf):
    """Collections whose stored dimension isn't the expected one are made anew from the source."""
    v = table(spark, sf, "embeddings")
    wrong = F.when(F.col("label") % 2 == 0, F.slice("embedding", 1, 8)).otherwise(F.col("embedding"))
    path = sinks.create(v.select("vec_id", "label", wrong.alias("embedding")), "collections")
    stored = sinks.read(spark, path)
    bad = stored.groupBy("label").agg(F.max(F.size("embedding")).alias("dim")).where("dim <> 64").select("label")
    fresh = v.join(bad, "label", "left_semi").select("vec_id", "label", "embedding")
    rows = sinks.replace_groups(fresh, path, ["label"])
    return rows.join(bad.withColumn("recreated", F.lit(True)), "label", "left").select("vec_id", "label", F.size("embedding").cast("long").alias("dim"), F.coalesce("recreated", F.lit(False)).alias("recreated"))


@query("SELECT event_type AS channel, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 100")
def sink_capped_list(spark, sf):
    """Pushes to a list of each channel that keeps its latest hundred."""
    ev = table(spark, sf, "events").select(F.col("event_type").alias("channel"), "event_id", "ts")
    newest = lambda rows: core.top_k(rows, ["channel"], [F.desc("ts"), F.desc("event_id")], 100, "k").drop("k")
    path = sinks.create(newest(ev.where("event_id % 2 = 0")), "lists")
    return sinks.change(spark, path, lambda old: newest(old.unionByName(ev.where("event_id % 2 = 1")))).select("channel", "event_id")


@query("SELECT doc_id, md5(text) AS digest, doc_id % 3 <> 0 AS skipped FROM documents")
def sink_file_ingest(spark, sf):
    """Files are ingested by content hash: those whose hash is stored are skipped, the others written."""
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    path = sinks.create(docs.where("doc_id % 3 <> 0"), "files")
    known = sinks.read(spark, path).select("doc_id", "digest").withColumn("known", F.lit(True))
    rows = docs.join(known, ["doc_id", "digest"], "left").withColumn("skipped", F.coalesce("known", F.lit(False))).drop("known")
    sinks.upsert(rows.where("not skipped").select("doc_id", "digest"), path, ["doc_id"])
    return sinks.read(spark, path).join(rows, ["doc_id", "digest"])


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS found, coalesce(quality, -1) AS quality FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def keyed_lookup(spark, sf):
    """Lookups by key, a whole table of them at once; a missing key gives its default."""
    asked = table(spark, sf, "documents").select("doc_id").distinct()
    return asked.join(table(spark, sf, "labels").withColumn("found", F.lit(True)), "doc_id", "left").select("doc_id", F.coalesce("found", F.lit(False)).alias("found"), F.coalesce("quality", F.lit(-1)).alias("quality"))


@query("""SELECT c_custkey AS user_id, coalesce(n, 0) AS turns, coalesce(total, 0.0) AS total, 0.5::DOUBLE AS trust, n IS NULL AS fresh FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2)::DOUBLE AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def read_or_init(spark, sf):
    """Stored state of every user, or the initial state where none is stored."""
    stored = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).cast("double").alias("total"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).join(stored, "user_id", "left")
    return rows.select("user_id", F.coalesce("n", F.lit(0)).alias("turns"), F.coalesce("total", F.lit(0.0)).alias("total"), F.lit(0.5).alias("trust"), F.col("n").isNull().alias("fresh"))


@query("""WITH s AS (SELECT o_custkey AS user_id, max(o_orderdate) AS last_order, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS open_conv FROM orders GROUP BY 1)
SELECT c_custkey AS user_id, c_mktsegment AS guild, open_conv, n_name AS ambient, coalesce(open_conv % 7 = 0, false) AS summarised FROM customer LEFT JOIN s ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey""")
def user_state(spark, sf):
    """Stats, the latest open conversation, its summary and the ambient state of every user, by a chain of left joins."""
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("open_conv"))
    rows = table(spark, sf, "customer").withColumnRenamed("c_custkey", "user_id").join(o, "user_id", "left").join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select("user_id", F.col("c_mktsegment").alias("guild"), "open_conv", F.col("n_name").alias("ambient"), F.coalesce(F.col("open_conv") % 7 == 0, F.lit(False)).alias("summarised"))


STATES = Literal("states", "user string, doc string", [("a", '{"stats": {"turns": 3}, "emotion": {"trust": 0.7}}'), ("b", '{"stats": {}}'), ("c", "{broken"), ("d", None)], given=("customer", ["concat('u', c_custkey)", "concat('{\"stats\": {\"turns\": ', c_nationkey, '}}')"]))


@query(f"""WITH {STATES.sql}, j AS (SELECT "user", CASE WHEN json_valid(doc) THEN doc END AS doc FROM states) SELECT "user", coalesce((doc->>'$.stats.turns')::BIGINT, 0) AS turns, coalesce((doc->>'$.emotion.trust')::DOUBLE, 0.5) AS trust, doc IS NOT NULL AS usable FROM j""")
def state_cache_read(spark, sf):
    """Cached state read as typed columns; what is missing or can't be parsed takes its default."""
    rows = STATES.frame(spark, sf).withColumn("s", F.from_json("doc", "stats struct<turns:long>, emotion struct<trust:double>"))
    usable = F.col("s").isNotNull() & (F.col("s.stats").isNotNull() | F.col("s.emotion").isNotNull())
    return rows.select("user", F.coalesce("s.stats.turns", F.lit(0)).alias("turns"), F.coalesce("s.emotion.trust", F.lit(0.5)).alias("trust"), usable.alias("usable"))


DICTIONARY = Literal("dict", "seq int, entry string", [(1, '{"name": "Mira Vale", "aliases": ["Mira", "The Archer"]}'), (2, '{"name": "Tam", "aliases": ["Old Tam", "mira"]}'), (3, '{"name": "Port", "aliases": []}')], given=("part", ["cast(1000 + p_partkey as int)", "concat('{\"name\": \"', p_name, '\", \"aliases\": [\"', p_brand, '\"]}')"]))


@query(f"""WITH {DICTIONARY.sql}, n AS (SELECT seq, entry->>'$.name' AS name, unnest(list_concat([entry->>'$.name'], (entry->'$.aliases')::VARCHAR[])) AS alias FROM dict)
SELECT lower(alias) AS alias, arg_max(name, seq) AS canonical, length(lower(alias)) AS n FROM n GROUP BY lower(alias)""")
def alias_dictionary(spark, sf):
    """Names and aliases of an entity dictionary by lower-cased alias; the last registration wins, and the length orders the longest first."""
    rows = DICTIONARY.frame(spark, sf).select("seq", F.from_json("entry", "name string, aliases array<string>").alias("e"))
    names = rows.select("seq", "e.name", F.explode(F.concat(F.array("e.name"), "e.aliases")).alias("a")).withColumn("alias", F.lower("a"))
    return names.groupBy("alias").agg(F.max_by("name", "seq").alias("canonical")).withColumn("n", F.length("alias").cast("long"))


@query("SELECT page_id, url, row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) AS pos, (row_number() OVER (PARTITION BY split_part(url, '/', 3) ORDER BY page_id) - 1) // 500 AS page FROM pages")
def category_listing(spark, sf):
    """The members of each category (here a host) in pages of 500."""
    w = Window.partitionBy(F.get(F.split("url", "/"), F.lit(2))).orderBy("page_id")
    pos = F.row_number().over(w).cast("long")
    return table(spark, sf, "pages").select("page_id", "url", pos.alias("pos"), F.expr("cast(0 as long)").alias("page")).withColumn("page", F.floor((F.col("pos") - 1) / 500).cast("long"))


@query("SELECT a.page_id AS parent, b.page_id AS child FROM pages a JOIN pages b ON regexp_replace(b.url, '/[^/]*$', '') = a.url")
def subpage_listing(spark, sf):
    """Pages below another page, by an equi-join on the address without its last part."""
    p = table(spark, sf, "pages")
    below = p.select(F.col("page_id").alias("child"), F.regexp_replace("url", "/[^/]*$", "").alias("url"))
    return p.join(below, "url").select(F.col("page_id").alias("parent"), "child")


@query("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k FROM embeddings) WHERE k <= 250")
def collection_scroll(spark, sf):
    """The first rows of each collection up to its cap and fifty."""
    return core.top_k(table(spark, sf, "embeddings"), ["label"], ["vec_id"], 250, "k").select("label", "vec_id")


@query("SELECT count(*) AS total, sum((o_orderstatus = 'F')::INT)::BIGINT AS processed, sum((o_orderstatus = 'O')::INT)::BIGINT AS pending, sum((o_orderstatus = 'P')::INT)::BIGINT AS failed, max(o_orderdate) AS last_update FROM orders")
def ingestion_summary(spark, sf):
    n = lambda s: F.sum((F.col("o_orderstatus") == s).cast("long"))
    return table(spark, sf, "orders").agg(F.count("*").alias("total"), n("F").alias("processed"), n("O").alias("pending"), n("P").alias("failed"), F.max("o_orderdate").alias("last_update"))


@query("""WITH s AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 4 <> 0), n AS (SELECT doc_id, md5(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS h FROM documents)
SELECT n.doc_id, s.h IS NOT NULL AND s.h = n.h AND n.doc_id % 4 <> 3 AS unchanged FROM n LEFT JOIN s USING (doc_id)""")
def unchanged_pages(spark, sf):
    """A page is unchanged if the stored hash is the same and its state is processed."""
    docs = table(spark, sf, "documents")
    new = docs.select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("h"))
    old = docs.where("doc_id % 4 <> 0").select("doc_id", F.md5("text").alias("old"), (F.col("doc_id") % 4 != 3).alias("processed"))
    return new.join(old, "doc_id", "left").select("doc_id", F.coalesce((F.col("old") == F.col("h")) & F.col("processed"), F.lit(False)).alias("unchanged"))


def _ledger(spark, sf) -> ledger.Ledger:
    """Customers as users, their orders as conversations and the lines of those as messages, in one ledger."""
    log = ledger.Ledger(spark, sinks.scratch(spark, "ledger"))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    with log.change() as change:
        change.create("users", table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal"))
        change.create("conversations", orders)
        change.create("messages", table(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", F.col("o_custkey").alias("l_custkey"), "l_quantity"))
    return log


@query("""WITH g AS (SELECT c_custkey FROM customer WHERE c_nationkey = 7), o AS (SELECT * FROM orders WHERE o_custkey NOT IN (FROM g)), m AS (SELECT l.*, o_custkey FROM lineitem l JOIN o ON l_orderkey = o_orderkey)
SELECT 'users' AS part, count(*) AS n, sum(c_custkey)::BIGINT AS keys, 2 AS version FROM customer WHERE c_custkey NOT IN (FROM g)
UNION ALL SELECT 'conversations', count(*), sum(o_orderkey)::BIGINT, 2 FROM o UNION ALL SELECT 'messages', count(*), sum(l_orderkey * 8 + l_linenumber)::BIGINT, 2 FROM m""")
def ledger_cascade(spark, sf):
    """All that belongs to the users of one nation goes from three tables in one commit."""
    log = _ledger(spark, sf)
    with log.change() as change:
        gone = log.read("users").where("c_nationkey = 7").select("c_custkey")
        for name, key in (("users", "c_custkey"), ("conversations", "o_custkey"), ("messages", "l_custkey")):
            change.delete(name, gone.toDF(key))
    state = log.state()
    sums = {"users": F.col("c_custkey"), "conversations": F.col("o_orderkey"), "messages": F.col("l_orderkey") * 8 + F.col("l_linenumber")}
    parts = [log.read(name, state=state).agg(F.count("*").alias("n"), F.sum(key).alias("keys")).select(F.lit(name).alias("part"), "n", "keys") for name, key in sums.items()]
    return parts[0].union(parts[1]).union(parts[2]).withColumn("version", F.lit(state.version))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN n ELSE 0 END AS n_turns, CASE WHEN c_custkey % 5 = 0 AND n > 0 THEN last END AS last_turn
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY 1) ON o_custkey = c_custkey WHERE c_custkey % 5 <> 0 OR n IS NOT NULL
UNION ALL SELECT c_custkey, 0, NULL FROM customer WHERE c_custkey % 5 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def turn_persistence(spark, sf):
    """Turns of every fifth user in two batches: the turns are appended and the users' counters raised in one commit; the second batch comes twice."""
    log = ledger.Ledger(spark, sinks.scratch(spark, "ledger"))
    turns = table(spark, sf, "orders").where("o_custkey % 5 = 0").select("o_orderkey", "o_custkey")
    with log.change() as change:
        change.create("turns", turns.limit(0))
        change.create("users", table(spark, sf, "customer").select("c_custkey", F.lit(0).cast("long").alias("n_turns"), F.lit(None).cast("long").alias("last_turn")))
    for batch in (0, 1, 1):
        with log.change("chat", batch) as change:
            if change is None:
                continue
            part = turns.where(F.col("o_orderkey") % 2 == batch)
            change.append("turns", part)
            more = part.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("m"), F.max("o_orderkey").alias("l"))
            counted = log.read("users", state=change.base).join(more, "c_custkey")
            change.upsert("users", counted.select("c_custkey", (F.col("n_turns") + F.col("m")).alias("n_turns"), F.greatest("last_turn", "l").alias("last_turn")), ["c_custkey"])
    return log.read("users")


@query("""SELECT CASE WHEN page_id % 4 = 3 THEN NULL ELSE page_id END AS page_id, (page_id % 7)::VARCHAR AS category, length(html)::INT AS n_chars, md5(html) AS body FROM pages WHERE page_id % 7 IN (2, 5)""")
def page_tree(spark, sf):
    """Pages written as a tree of files and read back through the data source, two of its seven categories; every fourth page has no metadata."""
    page_files.register(spark)
    root = sinks.scratch(spark, "page-tree")
    own = F.when(F.col("page_id") % 4 != 3, F.col("page_id"))
    pages = table(spark, sf, "pages").select((F.col("page_id") % 7).cast("string").alias("category"), F.format_string("p%012d", "page_id").alias("stem"), own.alias("page_id"), F.lit(None).cast("string").alias("title"), F.col("html").alias("text"))
    pages.write.format("page_files").mode("append").save(root)
    found = spark.read.format("page_files").option("splits", 4).load(root).where("category in ('2', '5')")
    given = F.when(F.substring("stem", 2, 12).cast("long") % 4 != 3, F.col("page_id"))
    return found.select(given.alias("page_id"), "category", F.length("text").alias("n_chars"), F.md5("text").alias("body"))
