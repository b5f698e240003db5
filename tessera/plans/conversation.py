"""Message-log queries: filters, windows, islands and budgets over ``conversations``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import core
from ..sources.tables import table
from ._catalog import Register

query = Register()


def _order():
    return Window.partitionBy("conv_id").orderBy("turn")


def _log(spark, sf):
    return table(spark, sf, "conversations")


@query("SELECT conv_id, turn FROM conversations WHERE role <> 'system' AND length(trim(text)) >= 3 AND NOT regexp_matches(text, '^[!/.$-][a-z]') AND NOT starts_with(text, 'http')")
def noise_filter(spark, sf):
    noisy = F.regexp_like("text", F.lit("^[!/.$-][a-z]")) | F.col("text").startswith("http")
    return _log(spark, sf).where((F.col("role") != "system") & (F.length(F.trim("text")) >= 3) & ~noisy).select("conv_id", "turn")


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= 6")
def recent_history(spark, sf):
    return core.top_k(_log(spark, sf), ["conv_id"], [F.desc("turn")], 6, "k").select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, answer_turn, length(answer) AS answer_chars FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS answer, lead(turn) OVER w AS answer_turn FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'")
def turn_pairs(spark, sf):
    """Each user message with the assistant message right after it."""
    rows = _log(spark, sf).withColumns({"r": F.lead("role").over(_order()), "answer": F.lead("text").over(_order()), "answer_turn": F.lead("turn").over(_order())})
    return rows.where("role = 'user' and r = 'assistant'").select("conv_id", "turn", "answer_turn", F.length("answer").cast("long").alias("answer_chars"))


@query("""WITH c AS (SELECT *, CASE WHEN role IS NOT DISTINCT FROM lag(role) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
i AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM c)
SELECT conv_id, island::BIGINT AS island, role, min(turn) AS first_turn, md5(string_agg(text, chr(10) ORDER BY turn)) AS body FROM i GROUP BY conv_id, island, role""")
def coalesce_speakers(spark, sf):
    """Neighbouring messages of one speaker as one block with the first one's turn."""
    rows = core.islands(_log(spark, sf), ["conv_id"], ["turn"], ["role"])
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    return rows.groupBy("conv_id", "island", "role").agg(F.min("turn").alias("first_turn"), F.md5(body).alias("body"))


@query("""SELECT conv_id, turn, cum::BIGINT AS cum FROM (SELECT *, sum(length(text) // 2 + 10) OVER w AS cum, row_number() OVER w AS pos FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE cum <= 600 OR pos <= 2""")
def history_budget(spark, sf):
    """Newest messages within the budget, never fewer than two."""
    size = text.token_estimate(F.col("text")) + 10
    return core.floor_pack(_log(spark, sf), ["conv_id"], [F.desc("turn")], size, 600, 2).select("conv_id", "turn", "cum")


@query("SELECT conv_id, turn FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) WHERE k <= greatest(4, 2 * (n % 10 + 2))")
def anchor_window(spark, sf):
    n = F.count("*").over(Window.partitionBy("conv_id"))
    rows = core.ranked(_log(spark, sf).withColumn("n", n), ["conv_id"], [F.desc("turn")], "k")
    return rows.where(F.col("k") <= F.greatest(F.lit(4), 2 * (F.col("n") % 10 + 2))).select("conv_id", "turn")


@query("""WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role = 'user'),
m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (length(text) < 60)::INT, k) AS r FROM u WHERE k <= 3) SELECT conv_id, turn FROM m WHERE r = 1""")
def last_meaningful(spark, sf):
    """The newest of the last three user messages that says enough, else the newest."""
    last = core.top_k(_log(spark, sf).where("role = 'user'"), ["conv_id"], [F.desc("turn")], 3, "k")
    return last.groupBy("conv_id").agg(F.min_by("turn", F.struct((F.length("text") < 60).cast("int"), "k")).alias("turn"))


@query("SELECT conv_id, turn, (coalesce(sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS turn_index FROM conversations")
def turn_index(spark, sf):
    before = F.sum((F.col("role") == "user").cast("long")).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    return _log(spark, sf).select("conv_id", "turn", (F.coalesce(before, F.lit(0)) + 1).alias("turn_index"))


@query("SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n % 3 = 0")
def every_n_trigger(spark, sf):
    return core.ranked(_log(spark, sf), ["conv_id"], ["turn"], "n").where("n % 3 = 0").select("conv_id", "turn")


@query("""WITH l AS (SELECT *, (length(text) + 1) // 2 AS t, sum((length(text) + 1) // 2) OVER (PARTITION BY conv_id) AS total, sum((length(text) + 1) // 2) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS cum FROM conversations)
SELECT conv_id, turn FROM l WHERE total <= 800 OR cum <= 800""")
def transcript_tail(spark, sf):
    """Everything if it fits, else the newest lines that do."""
    rows = _log(spark, sf).withColumn("t", F.floor((F.length("text") + 1) / 2))
    total = F.sum("t").over(Window.partitionBy("conv_id"))
    cum = F.sum("t").over(Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"total": total, "cum": cum}).where("total <= 800 or cum <= 800").select("conv_id", "turn")


@query("SELECT conv_id, count(*) AS messages, count(DISTINCT role) AS speakers, sum(length(text))::BIGINT AS raw_chars, sum(CASE WHEN role <> 'system' THEN length(text) ELSE 0 END)::BIGINT AS kept_chars, (sum(length(text) // 2 + 4))::BIGINT AS tokens FROM conversations GROUP BY conv_id")
def transcript_stats(spark, sf):
    n = F.length("text").cast("long")
    return _log(spark, sf).groupBy("conv_id").agg(F.count("*").alias("messages"), F.countDistinct("role").alias("speakers"), F.sum(n).alias("raw_chars"), F.sum(F.when(F.col("role") != "system", n).otherwise(0)).alias("kept_chars"), F.sum(text.token_estimate(F.col("text")) + 4).alias("tokens"))


@query("SELECT conv_id, turn, '[' || lpad((turn % 24)::VARCHAR, 2, '0') || ':00] <' || role || '>: ' || text AS line FROM conversations")
def transcript_lines(spark, sf):
    clock = F.lpad((F.col("turn") % 24).cast("string"), 2, "0")
    return _log(spark, sf).select("conv_id", "turn", F.concat(F.lit("["), clock, F.lit(":00] <"), "role", F.lit(">: "), "text").alias("line"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(text, '[{};]|def |import ') THEN 'CODE' WHEN contains(text, '?') THEN 'QUESTION' WHEN len(regexp_extract_all(text, '[^ \\t\\n]+')) <= 7 THEN 'SMALL_TALK' ELSE 'KNOWLEDGE' END AS intent FROM conversations WHERE role = 'user'")
def intent_route(spark, sf):
    t = F.col("text")
    intent = F.when(F.regexp_like(t, F.lit("[{};]|def |import ")), "CODE").when(F.contains(t, F.lit("?")), "QUESTION").when(text.word_count(t) <= 7, "SMALL_TALK").otherwise("KNOWLEDGE")
    return _log(spark, sf).where("role = 'user'").select("conv_id", "turn", intent.alias("intent"))


@query("""WITH s AS (SELECT conv_id, sum(CASE WHEN role = 'user' THEN length(text) // 2 ELSE 0 END) AS u, sum(CASE WHEN role = 'assistant' THEN length(text) // 2 ELSE 0 END) AS a, sum(CASE WHEN role = 'system' THEN length(text) // 2 ELSE 0 END) AS y FROM conversations GROUP BY conv_id),
g AS (SELECT *, least(y, 300, 2000) AS gy FROM s), h AS (SELECT *, least(u, 900, greatest(2000 - gy, 0)) AS gu FROM g)
SELECT conv_id, gy::BIGINT AS system_tokens, gu::BIGINT AS user_tokens, least(a, 1200, greatest(2000 - gy - gu, 0))::BIGINT AS assistant_tokens FROM h""")
def budget_allocation(spark, sf):
    """Greedy grants in weight order from one pool of 2000 tokens."""
    need = lambda r: F.sum(F.when(F.col("role") == r, text.token_estimate(F.col("text"))).otherwise(0)).alias(r)
    rows = _log(spark, sf).groupBy("conv_id").agg(need("system"), need("user"), need("assistant")).withColumn("pool", F.lit(2000).cast("long"))
    for role, most in (("system", 300), ("user", 900), ("assistant", 1200)):
        rows = rows.withColumn(f"{role}_tokens", F.least(F.col(role), F.lit(most).cast("long"), F.greatest("pool", F.lit(0).cast("long")))).withColumn("pool", F.col("pool") - F.col(f"{role}_tokens"))
    return rows.select("conv_id", "system_tokens", "user_tokens", "assistant_tokens")


@query("SELECT DISTINCT conv_id, role, md5(text) AS signature FROM conversations")
def signature_dedup(spark, sf):
    return _log(spark, sf).select("conv_id", "role", F.md5("text").alias("signature")).distinct()


@query("SELECT role, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, role) AS place FROM conversations GROUP BY role")
def frequency_ranking(spark, sf):
    return core.ranked(_log(spark, sf).groupBy("role").agg(F.count("*").alias("n")), [], [F.desc("n"), "role"], "place")
