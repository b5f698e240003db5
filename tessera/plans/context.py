"""Scopes, privacy, set operations, frames over histories, telemetry details, plug-in points and control flow."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import core
from ..sources.tables import table
from . import retrieval
from ._catalog import Literal, Register, case_sql, quoted

query = Register()

#: Events as stored memories: a scope that is a guild, a channel or a private talk, an expiry and a file.
_SCOPED = """e AS (SELECT event_id, user_id, event_type, ts, value, CASE event_id % 5 WHEN 0 THEN 'DM' WHEN 1 THEN 'CHANNEL_' || (event_id % 7) WHEN 2 THEN '' WHEN 3 THEN NULL ELSE 'g' || (event_id % 3) END AS guild,
CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL 1 DAY END AS expires, (SELECT max(ts) FROM events) AS now FROM events)"""


def _scoped(spark, sf) -> DataFrame:
    i = F.col("event_id")
    guild = F.when(i % 5 == 0, "DM").when(i % 5 == 1, F.concat(F.lit("CHANNEL_"), (i % 7).cast("string"))).when(i % 5 == 2, "").when(i % 5 == 3, F.lit(None)).otherwise(F.concat(F.lit("g"), (i % 3).cast("string")))
    ev = table(spark, sf, "events")
    now = ev.agg(F.max("ts").alias("now"))
    return ev.select("event_id", "user_id", "event_type", "ts", "value", guild.alias("guild"), F.when(i % 4 == 0, F.expr("ts + interval 1 day")).alias("expires")).crossJoin(F.broadcast(now))


def is_guild(g: Column) -> Column:
    """A real guild: not empty, not a channel, not a private talk."""
    return F.coalesce((g != "") & ~g.startswith("CHANNEL_") & (g != "DM"), F.lit(False))


@query(f"WITH {_SCOPED} SELECT event_id, coalesce(guild <> '' AND NOT starts_with(guild, 'CHANNEL_') AND guild <> 'DM', false) AS shared, NOT coalesce(expires < now, false) AS live, CASE WHEN coalesce(guild <> '' AND NOT starts_with(guild, 'CHANNEL_') AND guild <> 'DM', false) THEN guild ELSE 'user:' || user_id END AS scope FROM e")
def memory_scopes(spark, sf):
    """Which memories are shared by a guild, which are still valid, and whose they are otherwise."""
    shared = is_guild(F.col("guild"))
    return _scoped(spark, sf).select("event_id", shared.alias("shared"), (~F.coalesce(F.col("expires") < F.col("now"), F.lit(False))).alias("live"), F.when(shared, F.col("guild")).otherwise(F.concat(F.lit("user:"), F.col("user_id").cast("string"))).alias("scope"))


@query(f"WITH {_SCOPED}, q AS (SELECT DISTINCT user_id AS asker, event_type AS conv FROM events) SELECT asker, conv, count(event_id) AS visible, max(event_id) AS latest FROM q JOIN e ON user_id = asker AND event_type = conv AND NOT coalesce(expires < now, false) GROUP BY ALL")
def isolated_memories(spark, sf):
    """What each user sees in each conversation: their own rows that haven't expired."""
    rows = _scoped(spark, sf).where(~F.coalesce(F.col("expires") < F.col("now"), F.lit(False)))
    return rows.groupBy(F.col("user_id").alias("asker"), F.col("event_type").alias("conv")).agg(F.count("*").alias("visible"), F.max("event_id").alias("latest"))


@query("""WITH q AS (SELECT o_custkey AS q, o_orderkey AS id, o_orderpriority[1:1] AS tag, CASE WHEN o_custkey % 3 = 0 THEN '9' ELSE (1 + o_custkey % 5)::VARCHAR END AS wanted FROM orders),
m AS (SELECT *, tag = wanted AS hit, bool_or(tag = wanted) OVER (PARTITION BY q) AS any_ FROM q) SELECT q, id, NOT any_ AS relaxed FROM m WHERE hit OR NOT any_""")
def any_match_fallback(spark, sf):
    """Rows that match a query's filter, or all of its rows where none does."""
    wanted = F.when(F.col("o_custkey") % 3 == 0, "9").otherwise((1 + F.col("o_custkey") % 5).cast("string"))
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("id"), (F.substring("o_orderpriority", 1, 1) == wanted).alias("hit"))
    rows = rows.withColumn("any_", F.bool_or("hit").over(Window.partitionBy("q")))
    return rows.where("hit or not any_").select("q", "id", (~F.col("any_")).alias("relaxed"))


@query(f"""WITH {retrieval.PAIRS}, i AS (SELECT q_id, vec_id % 3 = 0 AS community, label, vec_id, sim FROM s WHERE sim >= 0.05 AND vec_id IN (SELECT page_id FROM pages)),
r AS (SELECT *, row_number() OVER (PARTITION BY q_id, community, label ORDER BY sim DESC, vec_id) AS k FROM i) SELECT q_id, community, label, vec_id, sim FROM r WHERE k <= 5""")
def image_memories(spark, sf):
    """Images whose page still exists, by cosine to each request, in a community's scope or a user's own: the best five of each."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("vec_id"))
    images = table(spark, sf, "embeddings").join(pages, "vec_id", "left_semi")
    near = [retrieval._searched(spark, sf, 5, by_label=True, least=0.05, among=images.where(cond)).withColumn("community", F.lit(shared)) for cond, shared in (("vec_id % 3 = 0", True), ("vec_id % 3 <> 0", False))]
    return core.top_k(near[0].union(near[1]), ["q_id", "community", "label"], [F.desc("sim"), "vec_id"], 5, "k").select("q_id", "community", "label", "vec_id", "sim")


@query("""WITH s AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role <> 'system' AND NOT starts_with(text, '!') AND length(trim(text)) > 0)
SELECT conv_id, turn, role, length(text) AS chars FROM s WHERE k <= 15""")
def channel_history(spark, sf):
    """The last fifteen messages of each channel that people or the bot wrote, without commands."""
    rows = table(spark, sf, "conversations").where((F.col("role") != "system") & ~F.col("text").startswith("!") & (F.length(F.trim("text")) > 0))
    return core.top_k(rows, ["conv_id"], [F.desc("turn")], 15, "k").select("conv_id", "turn", "role", F.length("text").cast("long").alias("chars"))


@query("""WITH m AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, row_number() OVER (PARTITION BY conv_id, length(text) >= 40 ORDER BY turn DESC) AS k, length(text) >= 40 AS good, bool_or(length(text) >= 40) OVER (PARTITION BY conv_id) AS any_ FROM conversations)
SELECT conv_id, turn FROM m WHERE (good AND k <= 2) OR (NOT any_ AND rn <= 2)""")
def transcript_lookback(spark, sf):
    """The last two meaningful lines of a transcript, or its last two lines where none is."""
    good = F.length("text") >= 40
    rows = table(spark, sf, "conversations").select("conv_id", "turn", good.alias("good"))
    rows = core.ranked(core.ranked(rows, ["conv_id"], [F.desc("turn")], "rn"), ["conv_id", "good"], [F.desc("turn")], "k")
    rows = rows.withColumn("any_", F.bool_or("good").over(Window.partitionBy("conv_id")))
    return rows.where("(good and k <= 2) or (not any_ and rn <= 2)").select("conv_id", "turn")


@query("""WITH p AS (SELECT conv_id, turn, role, lead(role) OVER w AS next_role, lead(turn) OVER w AS next_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM p WHERE role = 'user') SELECT conv_id, turn, CASE WHEN k <= 3 AND next_role = 'assistant' THEN next_turn END AS reply, CASE WHEN k <= 3 THEN 'pair' ELSE 'context' END AS part FROM u WHERE k <= 5""")
def batch_transcript(spark, sf):
    """The last three exchanges of a talk and the two user messages before them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.lead("role").over(w).alias("next_role"), F.lead("turn").over(w).alias("next_turn"))
    rows = core.top_k(rows.where("role = 'user'"), ["conv_id"], [F.desc("turn")], 5, "k")
    return rows.select("conv_id", "turn", F.when((F.col("k") <= 3) & (F.col("next_role") == "assistant"), F.col("next_turn")).alias("reply"), F.when(F.col("k") <= 3, "pair").otherwise("context").alias("part"))


@query("""WITH s AS (SELECT user_id AS trace, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id % 3 AS depth FROM events),
n AS (SELECT *, lead(depth) OVER (PARTITION BY trace ORDER BY seq) AS next_depth FROM s),
a AS (SELECT a.trace, a.event_id, min(b.seq) AS stop FROM s a LEFT JOIN s b ON a.trace = b.trace AND b.seq > a.seq AND b.depth <= a.depth GROUP BY a.trace, a.event_id)
SELECT s.event_id, stop IS NULL OR (SELECT depth FROM s x WHERE x.trace = s.trace AND x.seq = stop) < s.depth AS last_sibling FROM s JOIN a ON a.event_id = s.event_id""")
def last_siblings(spark, sf):
    """Is a step the last below its parent: the next step that is no deeper decides."""
    rows = core.ranked(table(spark, sf, "events").select(F.col("user_id").alias("trace"), "event_id", "ts", (F.col("event_id") % 3).cast("int").alias("depth")), ["trace"], ["ts", "event_id"], "seq")
    ahead = Window.partitionBy("trace").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    # the first depth ahead that isn't deeper, for each of the depths there are
    stop = F.lit(None).cast("int")
    for d in (2, 1, 0):
        stop = F.when(F.col("depth") == d, F.first(F.when(F.col("depth") <= d, F.col("depth")), ignorenulls=True).over(ahead)).otherwise(stop)
    return rows.withColumn("stop", stop).select("event_id", (F.col("stop").isNull() | (F.col("stop") < F.col("depth"))).alias("last_sibling"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS interactions FROM events")
def interaction_counter(spark, sf):
    return core.ranked(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "interactions").select("event_id", "interactions")


@query("""SELECT c_custkey AS user_id, coalesce(arg_max(o_orderkey, (o_orderdate, o_orderkey)) FILTER (o_orderstatus = 'O'), -c_custkey) AS conv, count(o_orderkey) FILTER (o_orderstatus = 'O') = 0 AS created FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def open_conversation(spark, sf):
    """Each user's newest open conversation, or a new one."""
    is_open = table(spark, sf, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("user_id")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("conv"))
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")).join(is_open, "user_id", "left")
    return rows.select("user_id", F.coalesce("conv", -F.col("user_id")).alias("conv"), F.col("conv").isNull().alias("created"))


@query("SELECT conv_id, turn, tokens FROM (SELECT conv_id, turn, length(text) // 2 AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'assistant') WHERE k <= 10")
def latest_token_rows(spark, sf):
    rows = table(spark, sf, "conversations").where("role = 'assistant'").withColumn("tokens", F.floor(F.length("text") / 2).cast("long"))
    return core.top_k(rows, ["conv_id"], [F.desc("turn")], 10, "k").select("conv_id", "turn", "tokens")


@query("""WITH u AS (SELECT doc_id AS id, 'documents' AS collection FROM documents UNION ALL SELECT vec_id, 'vectors' FROM embeddings UNION ALL SELECT page_id, 'pages' FROM pages) SELECT id, count(*) AS n, string_agg(collection, ';' ORDER BY collection) AS collections FROM u GROUP BY id""")
def collection_union(spark, sf):
    """Results of several collections in one list, distinct by id, with where each was found."""
    parts = [table(spark, sf, name).select(F.col(key).cast("long").alias("id"), F.lit(label).alias("collection")) for name, key, label in (("documents", "doc_id", "documents"), ("embeddings", "vec_id", "vectors"), ("pages", "page_id", "pages"))]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("collection")), ";").alias("collections"))


SETS = Literal("sets", "id long, found array<string>, mine array<string>, keywords array<string>, live int", [(1, ["a", "b", "c"], ["b"], ["x", "c"], 1), (2, ["a"], ["a"], ["a"], 3), (3, [], ["q"], ["z"], 0), (4, ["m", "n", "m"], [], ["n"], 2)], given=("orders", ["1000000 + o_orderkey", "[o_orderstatus, o_orderpriority]", "[o_orderstatus]", "[o_orderpriority]", "cast(o_custkey % 3 as int)"]))


@query(f"""WITH {SETS.sql} SELECT id, array_to_string(list_sort(list_distinct(list_filter(found, lambda x: NOT list_contains(mine, x)))), ';') AS third_party, list_has_any(found, keywords) AS matches, array_to_string(found[1:greatest(0, len(found) - live)], ';') AS older,
array_to_string(list_concat(list_filter(keywords, lambda x: NOT list_contains(found, x)), found), ';') AS merged, array_to_string(found[1:2], ';') AS first_two, coalesce(found[live + 1], 'none') AS picked FROM sets""")
def array_sets(spark, sf):
    """Differences, intersections, slices, facts put in front where absent, and picks with a bounds check."""
    rows = SETS.frame(spark, sf)
    absent = F.filter("keywords", lambda x: ~F.array_contains("found", x))
    return rows.select(
        "id", F.array_join(F.sort_array(F.array_distinct(F.array_except("found", "mine"))), ";").alias("third_party"), F.arrays_overlap("found", "keywords").alias("matches"), F.array_join(F.slice("found", F.lit(1), F.greatest(F.lit(0), F.size("found") - F.col("live"))), ";").alias("older"),
        F.array_join(F.concat(absent, "found"), ";").alias("merged"), F.array_join(F.slice("found", 1, 2), ";").alias("first_two"), F.coalesce(F.get("found", F.col("live")), F.lit("none")).alias("picked"),
    )


@query("""WITH t AS (SELECT source, text, min(doc_id) AS doc_id FROM documents WHERE trim(text) <> '' GROUP BY ALL) SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM t""")
def ordered_distinct(spark, sf):
    """Texts of each source in order, blank and repeated ones left out."""
    docs = table(spark, sf, "documents").where(F.trim("text") != "").select("source", "doc_id", F.sha2("text", 256).alias("h"))
    return core.ranked(docs.groupBy("source", "h").agg(F.min("doc_id").alias("doc_id")), ["source"], ["doc_id"], "pos").select("source", "doc_id", "pos")


@query("""WITH s AS (SELECT event_id, user_id, event_type, ts, row_number() OVER (PARTITION BY user_id, event_type, ts ORDER BY event_id) AS k FROM events), d AS (SELECT * FROM s WHERE k = 1)
SELECT event_id, coalesce(event_type, 'step') AS stage, CASE event_type WHEN 'error' THEN 2 WHEN 'view' THEN 1 ELSE 0 END AS depth, CASE WHEN starts_with(event_type, 'c') THEN 'click' WHEN event_type IN ('signup', 'purchase') THEN 'business' ELSE 'other' END AS category,
contains(lower(event_type), 'i') OR contains(user_id::VARCHAR, '7') AS found FROM d""")
def trace_steps(spark, sf):
    """Steps without repeats (same name and time), with defaults for stage, depth and category, and whether a search finds them."""
    first = table(spark, sf, "events").groupBy("user_id", "event_type", "ts").agg(F.min("event_id").alias("event_id"))
    t = F.col("event_type")
    return first.select(
        "event_id", F.coalesce(t, F.lit("step")).alias("stage"), F.when(t == "error", 2).when(t == "view", 1).otherwise(0).alias("depth"), F.when(t.startswith("c"), "click").when(t.isin("signup", "purchase"), "business").otherwise("other").alias("category"),
        (F.contains(F.lower(t), F.lit("i")) | F.contains(F.col("user_id").cast("string"), F.lit("7"))).alias("found"),
    )


PURPOSES = Literal("purposes", "code string", [("chat",), ("rewrite",), ("loop_cycle_2",), ("assess",), ("other",), (None,)], given=("conversations", ["role"]))
LABELS = [("chat", "Reply"), ("rewrite", "Query rewrite"), ("assess", "Assessment")]


@query(f"""WITH {PURPOSES.sql} SELECT code, CASE {' '.join(f"WHEN code = '{c}' THEN '{x}'" for c, x in LABELS)} WHEN starts_with(code, 'loop_cycle_') THEN 'Refinement ' || substr(code, 12) ELSE coalesce(code, 'unknown') END AS label FROM purposes""")
def purpose_labels(spark, sf):
    c = F.col("code")
    label = F.when(c.startswith("loop_cycle_"), F.concat(F.lit("Refinement "), F.substring(c, 12, 100))).otherwise(F.coalesce(c, F.lit("unknown")))
    for code, said in LABELS:
        label = F.when(c == code, said).otherwise(label)
    return PURPOSES.frame(spark, sf).select("code", label.alias("label"))


@query("""WITH p AS (SELECT conv_id, count(*) AS n, sum(CASE WHEN role = 'user' THEN length(text) // 2 ELSE 0 END) AS user_tokens, sum(CASE WHEN role = 'assistant' THEN length(text) // 2 ELSE 0 END) AS reply_tokens, sum(CASE WHEN role = 'system' THEN length(text) // 2 ELSE 0 END) AS system_tokens, sum(length(text)) // 2 AS total FROM conversations GROUP BY conv_id)
SELECT conv_id, user_tokens::BIGINT AS user_tokens, reply_tokens::BIGINT AS reply_tokens, system_tokens::BIGINT AS system_tokens, (total - user_tokens - reply_tokens - system_tokens)::BIGINT AS rest, total <= 8000 AS within FROM p""")
def token_breakdown(spark, sf):
    """Tokens of a prompt by section, the rest being its frame, and whether it stays within the ceiling."""
    size = F.floor(F.length("text") / 2).cast("long")
    part = lambda role: F.sum(F.when(F.col("role") == role, size).otherwise(0)).alias(f"{role}_t")
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(*[part(r) for r in ("user", "assistant", "system")], F.floor(F.sum(F.length("text")) / 2).cast("long").alias("total"))
    return rows.select("conv_id", F.col("user_t").alias("user_tokens"), F.col("assistant_t").alias("reply_tokens"), F.col("system_t").alias("system_tokens"), (F.col("total") - F.col("user_t") - F.col("assistant_t") - F.col("system_t")).alias("rest"), (F.col("total") <= 8000).alias("within"))


@query("""WITH f AS (SELECT o_custkey AS step, [CASE WHEN o_orderstatus = 'F' THEN 'CONTRADICT' ELSE 'KEEP' END] AS d FROM orders) SELECT step, count(*) AS facts, sum(len(list_filter(d, lambda x: x = 'CONTRADICT')))::BIGINT AS conflicts FROM f GROUP BY step""")
def conflict_counts(spark, sf):
    return table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("step")).agg(F.count("*").alias("facts"), F.count_if(F.col("o_orderstatus") == "F").alias("conflicts"))


@query("""SELECT count(*) AS cases, round(avg((o_orderstatus = 'F')::INT), 6) AS pass_rate, round(avg(o_totalprice), 4)::DOUBLE AS avg_score, round(100.0 * sum((o_orderstatus = 'F')::INT) / greatest(count(*), 1), 4)::DOUBLE AS hit_pct, round(avg(o_orderkey % 1000) / 1000.0, 6)::DOUBLE AS avg_seconds FROM orders""")
def utilisation_metrics(spark, sf):
    """Pass rate, mean score, hit percentage with a guard against no cases, and mean latency."""
    hit = (F.col("o_orderstatus") == "F").cast("int")
    return table(spark, sf, "orders").agg(F.count("*").alias("cases"), F.round(F.avg(hit), 6).alias("pass_rate"), F.round(F.avg("o_totalprice"), 4).cast("double").alias("avg_score"), F.round(100.0 * F.sum(hit) / F.greatest(F.count("*"), F.lit(1)), 4).alias("hit_pct"), F.round(F.avg(F.col("o_orderkey") % 1000) / 1000.0, 6).alias("avg_seconds"))


@query("""WITH l AS (SELECT lang, source, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT lang, source, count(*) AS total, sum((trim(line) = '')::INT)::BIGINT AS blank, sum((starts_with(trim(line), '#'))::INT)::BIGINT AS comment, sum((trim(line) <> '' AND NOT starts_with(trim(line), '#'))::INT)::BIGINT AS code FROM l GROUP BY ROLLUP (lang, source)""")
def line_rollup(spark, sf):
    """Lines by kind for each component, with totals above."""
    rows = table(spark, sf, "documents").select("lang", "source", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    n = lambda c: F.sum(c.cast("long"))
    blank, note = F.col("line") == "", F.col("line").startswith("#")
    return rows.rollup("lang", "source").agg(F.count("*").alias("total"), n(blank).alias("blank"), n(note).alias("comment"), n(~blank & ~note).alias("code"))


DECISIONS = Literal("decisions", "item long, fact int, verdict string, choice int", [(1, 0, "CONTRADICT", 1), (1, 2, "DUPLICATE", 9), (2, 0, None, 0)], given=("orders", ["1000000 + o_custkey", "o_orderkey", "case when o_orderstatus = 'F' then 'CONTRADICT' when o_orderstatus = 'O' then 'DUPLICATE' else 'KEEP' end", "cast(o_orderkey % 4 as int)"]))
CANDIDATES = Literal("candidates", "item long, fact int, cands array<string>", [(1, 0, ["x", "y"]), (1, 1, ["z"]), (1, 2, ["w"]), (2, 0, ["v"]), (3, 0, [])], given=("orders", ["1000000 + o_custkey", "o_orderkey", "[o_orderpriority, o_orderstatus]"]))


@query(f"WITH {DECISIONS.sql}, {CANDIDATES.sql} SELECT item, fact, coalesce(verdict, 'KEEP_BOTH') AS verdict, cands[choice + 1] AS replaces FROM candidates LEFT JOIN decisions USING (item, fact)")
def decision_join_back(spark, sf):
    """Decisions joined back to their facts; without one both stay, and a choice out of bounds replaces nothing."""
    rows = CANDIDATES.frame(spark, sf).join(DECISIONS.frame(spark, sf), ["item", "fact"], "left")
    return rows.select("item", "fact", F.coalesce("verdict", F.lit("KEEP_BOTH")).alias("verdict"), F.get("cands", F.col("choice")).alias("replaces"))


@query("""SELECT o_orderkey AS message, CASE WHEN o_orderpriority[1:1] = '1' THEN 'DM' WHEN n_regionkey = 0 THEN 'CHANNEL_' || c_nationkey ELSE n_name END AS scope, n_regionkey = 0 AS private FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def message_scope(spark, sf):
    """The scope of a message from its channel's settings: a private talk, a private channel, or the guild."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    scope = F.when(F.substring("o_orderpriority", 1, 1) == "1", "DM").when(F.col("n_regionkey") == 0, F.concat(F.lit("CHANNEL_"), F.col("c_nationkey").cast("string"))).otherwise(F.col("n_name"))
    return rows.select(F.col("o_orderkey").alias("message"), scope.alias("scope"), (F.col("n_regionkey") == 0).alias("private"))


@query("""WITH e AS (SELECT l_orderkey AS chunk, (l_linenumber, l_suppkey) AS pos, s_name, n_name, CASE WHEN n_regionkey = 0 THEN NULL ELSE r_name END AS region FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT chunk, arg_min(s_name, pos) AS canonical, arg_min(region, pos) FILTER (region IS NOT NULL) AS region FROM e GROUP BY chunk""")
def chunk_entities(spark, sf):
    """A chunk takes its name from its first entity, and its region from the first entity that has one."""
    names = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    names = names.select("s_suppkey", "s_name", F.when(F.col("n_regionkey") != 0, F.col("r_name")).alias("region"))
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("chunk"), F.struct("l_linenumber", "l_suppkey").alias("pos"), F.col("l_suppkey").alias("s_suppkey")).join(names, "s_suppkey")
    return rows.groupBy("chunk").agg(F.min_by("s_name", "pos").alias("canonical"), F.min_by("region", F.when(F.col("region").isNotNull(), F.col("pos"))).alias("region"))


@query("""WITH r AS (SELECT o_custkey AS q, 1 AS provider, count(*) FILTER (o_orderstatus = 'P') AS n FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 2, count(*) FILTER (o_orderstatus = 'F') FROM orders GROUP BY 1 UNION ALL SELECT o_custkey, 3, count(*) FROM orders GROUP BY 1)
SELECT q, min(provider) AS provider, arg_min(n, provider) AS results FROM r WHERE n > 0 GROUP BY q""")
def provider_fallback(spark, sf):
    """The first of several providers that has results answers."""
    o = table(spark, sf, "orders")
    parts = [o.where(cond).groupBy(F.col("o_custkey").alias("q")).agg(F.count("*").alias("n")).withColumn("provider", F.lit(k)) for k, cond in ((1, "o_orderstatus = 'P'"), (2, "o_orderstatus = 'F'"), (3, "true"))]
    return reduce(DataFrame.unionByName, parts).groupBy("q").agg(F.min("provider").alias("provider"), F.min_by("n", "provider").alias("results"))


#: Rounds of the refinement loop and the score at which a query is satisfied without another.
ROUNDS, ENOUGH = 2, 0.9


@query("""WITH r0 AS (SELECT o_custkey AS q, max(o_totalprice) / 498761.0 AS score FROM orders WHERE o_orderstatus = 'P' GROUP BY 1), a AS (SELECT DISTINCT o_custkey AS q FROM orders),
s0 AS (SELECT q, coalesce(score, 0.0) AS score FROM a LEFT JOIN r0 USING (q)), r1 AS (SELECT o_custkey AS q, max(o_totalprice) / 450011.0 AS s1 FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
s1 AS (SELECT q, CASE WHEN score >= 0.9 THEN score ELSE greatest(score, coalesce(s1, 0.0)) END AS s, score >= 0.9 AS done0 FROM s0 LEFT JOIN r1 USING (q)), r2 AS (SELECT o_custkey AS q, max(o_totalprice) / 400009.0 AS s2 FROM orders GROUP BY 1)
SELECT q, round(CASE WHEN s >= 0.9 THEN s ELSE greatest(s, coalesce(s2, 0.0)) END, 6)::DOUBLE AS score, CASE WHEN done0 THEN 0 WHEN s >= 0.9 THEN 1 ELSE 2 END AS rounds FROM s1 LEFT JOIN r2 USING (q)""")
def refinement_loop(spark, sf):
    """Queries that aren't satisfied search again, in a wider source each round, at most twice; the others are left alone."""
    o = table(spark, sf, "orders")
    best = lambda cond, scale: o.where(cond).groupBy(F.col("o_custkey").alias("q")).agg((F.max("o_totalprice") / scale).alias("new"))
    state = o.select(F.col("o_custkey").alias("q")).distinct().join(best("o_orderstatus = 'P'", 498761.0), "q", "left").select("q", F.coalesce("new", F.lit(0.0)).alias("score"), F.lit(0).alias("rounds"))
    for source in (best("o_orderstatus = 'F'", 450011.0), best("true", 400009.0))[:ROUNDS]:
        open_ = state.where(F.col("score") < ENOUGH).join(source, "q", "left").select("q", F.greatest("score", F.coalesce("new", F.lit(0.0))).alias("score"), (F.col("rounds") + 1).alias("rounds"))
        state = state.where(F.col("score") >= ENOUGH).unionByName(open_)
    return state.select("q", F.round("score", 6).alias("score"), "rounds")


@query("""WITH d AS (SELECT doc_id, lower(text) AS t, CASE WHEN doc_id % 3 = 0 THEN 'vector' WHEN doc_id % 3 = 1 THEN 'web' ELSE 'both' END AS target FROM documents), v AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label), w AS (SELECT count(*) AS n FROM pages)
SELECT target, count(*) AS asked, (CASE WHEN target IN ('vector', 'both') THEN (SELECT sum(least(n, 3)) FROM v) ELSE 0 END + CASE WHEN target IN ('web', 'both') THEN (SELECT least(n, 4) FROM w) ELSE 0 END)::BIGINT AS results FROM d GROUP BY target""")
def adaptive_search(spark, sf):
    """Searches go to the vectors, the web or both: three rows of each collection, four pages of the web."""
    asked = table(spark, sf, "documents").select(F.when(F.col("doc_id") % 3 == 0, "vector").when(F.col("doc_id") % 3 == 1, "web").otherwise("both").alias("target")).groupBy("target").agg(F.count("*").alias("asked"))
    vectors = table(spark, sf, "embeddings").groupBy("label").count().agg(F.sum(F.least("count", F.lit(3))).alias("vector_rows"))
    web = table(spark, sf, "pages").agg(F.least(F.count("*"), F.lit(4)).alias("web_rows"))
    rows = asked.crossJoin(F.broadcast(vectors)).crossJoin(F.broadcast(web))
    n = F.when(F.col("target").isin("vector", "both"), F.col("vector_rows")).otherwise(0) + F.when(F.col("target").isin("web", "both"), F.col("web_rows")).otherwise(0)
    return rows.select("target", "asked", n.cast("long").alias("results"))


def embed(rows: DataFrame, text: str = "text", dim: int = 16, name: str = "vector") -> DataFrame:
    """A deterministic stand-in for an embedding model: signed hashes of the words, normalised. The plug-in point takes any function of this shape."""
    words = F.regexp_extract_all(F.lower(F.concat(F.lit("passage: "), F.col(text))), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))
    slots = F.transform(words, lambda w: F.struct(F.pmod(F.crc32(w.cast("binary")), F.lit(dim)).cast("int").alias("i"), F.when(F.pmod(F.crc32(F.concat(w, F.lit("#")).cast("binary")), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    sums = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda k: F.aggregate(F.filter("slots_", lambda x: x["i"] == k), F.lit(0.0), lambda a, x: a + x["s"]))
    norm = F.sqrt(F.aggregate("sums_", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("slots_", slots).withColumn("sums_", sums)
    return rows.withColumn(name, F.transform("sums_", lambda x: F.when(norm > 0, x / norm).otherwise(0.0))).drop("slots_", "sums_")


def stages(rows: DataFrame, *functions) -> DataFrame:
    """Run ingestion or chat stages, each a function of a DataFrame."""
    return reduce(DataFrame.transform, functions, rows)


def _crc(x: str) -> str:
    """CRC-32 of a text in SQL: its UTF-8 bytes, each followed by eight shifts."""
    data = f"list_transform(range(1, strlen({x}) + 1), lambda i: ('0x' || substr(hex(encode({x})), 2 * i - 1, 2))::BIGINT)"
    steps = f"list_prepend(4294967295::BIGINT, flatten(list_transform({data}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1])))"
    return f"xor(list_reduce({steps}, lambda a, y: CASE WHEN y >= 0 THEN xor(a, y) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295)"


@query(f"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower('passage: ' || text), '[\\p{{L}}\\p{{N}}_]+')) AS w FROM benchmark WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}_]')),
h AS (SELECT w, {_crc("w")} % 16 AS slot, CASE WHEN {_crc("w || '#'")} % 2 = 0 THEN 1 ELSE -1 END AS sign FROM (SELECT DISTINCT w FROM w)),
s AS (SELECT item_id, slot, sum(sign) AS x FROM w JOIN h USING (w) GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(x * x)) AS norm FROM s GROUP BY item_id)
SELECT i.item_id, k::INT AS slot, CASE WHEN norm > 0 THEN round(coalesce(x, 0) / norm, 6) ELSE 0 END::DOUBLE AS value FROM (SELECT item_id, norm, unnest(range(16)) AS k FROM n) i LEFT JOIN s ON s.item_id = i.item_id AND s.slot = k""")
def embedding_stage(spark, sf):
    """Embeds every passage; each component of each vector."""
    rows = stages(table(spark, sf, "benchmark"), lambda df: df.where(F.regexp_like("text", F.lit("[\\p{L}\\p{N}_]"))), embed)
    return rows.select("item_id", F.posexplode("vector").alias("slot", "x")).select("item_id", "slot", F.round(F.col("x") + 0.0, 6).alias("value"))


#: Tools by name: what they are found by, and what they do to a message.
TOOLS = {"shout": ("(?i)loud", F.upper), "count": ("(?i)how many", lambda c: F.length(c).cast("string")), "echo": (".", lambda c: c)}


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)loud') THEN 'shout' WHEN regexp_matches(text, '(?i)how many') THEN 'count' ELSE 'echo' END AS tool, md5(CASE WHEN regexp_matches(text, '(?i)loud') THEN upper(text) WHEN regexp_matches(text, '(?i)how many') THEN length(text)::VARCHAR ELSE text END) AS result FROM conversations""")
def tool_execution(spark, sf):
    """Each message goes to the first tool that its words name; the tools are column functions in a register."""
    tool, result = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, (pattern, run) in reversed(TOOLS.items()):
        fits = F.regexp_like("text", F.lit(pattern)) if pattern != "." else F.lit(True)
        tool, result = F.when(fits, name).otherwise(tool), F.when(fits, run(F.col("text"))).otherwise(result)
    return table(spark, sf, "conversations").select("conv_id", "turn", tool.alias("tool"), F.md5(result).alias("result"))


@query("""WITH t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations), l AS (SELECT conv_id, count(*) AS messages, string_agg(text, ' | ' ORDER BY turn) AS summary FROM t WHERE k <= 100 GROUP BY conv_id)
SELECT conv_id, messages, md5(summary) AS summary, messages % 10 = 0 AS due FROM l""")
def conversation_summary(spark, sf):
    """A stand-in summary of each talk's last hundred messages, and whether one is due after every ten."""
    last = core.top_k(table(spark, sf, "conversations"), ["conv_id"], [F.desc("turn")], 100, "k")
    rows = last.groupBy("conv_id").agg(F.count("*").alias("messages"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("s")))), lambda x: x["s"]), " | ").alias("summary"))
    return rows.select("conv_id", "messages", F.md5("summary").alias("summary"), (F.col("messages") % 10 == 0).alias("due"))


@query("""WITH x AS (SELECT conv_id, count(*) AS n, sum(length(text)) AS chars, bool_or(contains(text, '?')) AS asks FROM conversations GROUP BY conv_id)
SELECT conv_id, chars >= 500 AS sufficient, CASE WHEN chars < 500 THEN 'refine' ELSE 'answer' END AS next_step, CASE WHEN asks THEN 'question' ELSE 'statement' END AS kind FROM x""")
def context_assessment(spark, sf):
    """A rule in place of a model: is there enough context to answer, and what comes next."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.bool_or(F.contains("text", F.lit("?"))).alias("asks"))
    return rows.select("conv_id", (F.col("chars") >= 500).alias("sufficient"), F.when(F.col("chars") < 500, "refine").otherwise("answer").alias("next_step"), F.when(F.col("asks"), "question").otherwise("statement").alias("kind"))


@query("""WITH s AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) FILTER (role = 'system') AS sys, string_agg('<' || role || '>' || replace(replace(text, '<', '&lt;'), '>', '&gt;') || '</' || role || '>', chr(10) ORDER BY turn) FILTER (role <> 'system') AS body FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(concat_ws(chr(10) || chr(10), CASE WHEN sys IS NOT NULL THEN '[System]' || chr(10) || sys END, CASE WHEN body IS NOT NULL THEN '[History]' || chr(10) || body END, '[Format] json')) AS prompt FROM s""")
def prompt_assembly(spark, sf):
    """Prompts from sections that may be missing; what users wrote is fenced and escaped."""
    safe = F.replace(F.replace("text", F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = F.concat(F.lit("<"), "role", F.lit(">"), safe, F.lit("</"), "role", F.lit(">"))
    joined = lambda cond, c: F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("turn", c.alias("s"))))), lambda x: x["s"])
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(joined(F.col("role") == "system", F.col("text")).alias("sys"), joined(F.col("role") != "system", line).alias("body"))
    part = lambda name, c: F.when(F.size(c) > 0, F.concat(F.lit(f"[{name}]\n"), F.array_join(c, "\n")))
    return rows.select("conv_id", F.md5(F.concat_ws("\n\n", part("System", "sys"), part("History", "body"), F.lit("[Format] json"))).alias("prompt"))
