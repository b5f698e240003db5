"""Keyed state, rate limits, caches, traces and telemetry over ``events``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scores
from ..operators import core
from ..sources.tables import table
from ..streaming import emotions, expiring, state
from ..streaming import json_field as fields
from ._catalog import Register

query = Register()


def _events(spark, sf):
    return table(spark, sf, "events")


@query("SELECT user_id, time_bucket(INTERVAL 1 hour, ts) AS bucket, count(*) AS n, count(*) <= 2 AS within FROM events GROUP BY ALL")
def rate_limit_tumbling(spark, sf):
    return state.tumbling_counts(_events(spark, sf), "1 hour", 2)


@query("SELECT event_id, k <= 1 AS allowed, greatest(1 - k, 0) AS remaining FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, time_bucket(INTERVAL 1 day, ts) ORDER BY ts, event_id) AS k FROM events)")
def rate_limit_verdict(spark, sf):
    rows = _events(spark, sf).withColumn("bucket", F.date_trunc("day", "ts"))
    rows = core.ranked(rows, ["user_id", "bucket"], ["ts", "event_id"], "k")
    return rows.select("event_id", (F.col("k") <= 1).alias("allowed"), F.greatest(1 - F.col("k"), F.lit(0)).alias("remaining"))


@query("SELECT event_id, coalesce(ts < lag(ts) OVER w + INTERVAL 24 hour, false) AS hit FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def ttl_cache_hits(spark, sf):
    """An event hits the cache if the key's previous event is less than a day older."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return _events(spark, sf).withColumn("prev", F.lag("ts").over(w)).select("event_id", F.coalesce(F.col("ts") < F.expr("prev + interval 24 hours"), F.lit(False)).alias("hit"))


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM (SELECT DISTINCT ON (event_type, user_id, ts) * FROM events ORDER BY event_type, user_id, ts, event_id)) WHERE k <= 60")
def rolling_buffer(spark, sf):
    """The last 60 distinct events of each channel."""
    rows = core.latest_wins(_events(spark, sf), ["event_type", "user_id", "ts"], ["event_id"])
    return core.top_k(rows, ["event_type"], [F.desc("ts"), F.desc("event_id")], 60, "k").select("event_type", "event_id")


@query("SELECT user_id, count(*) AS steps, min(ts) AS started, max(ts) AS ended, (epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))))::BIGINT AS latency_s, sum((event_type = 'error')::INT)::BIGINT AS errors, CASE WHEN sum((event_type = 'error')::INT) > 0 THEN 'FAILED' ELSE 'OK' END AS status FROM events GROUP BY user_id")
def trace_assembly(spark, sf):
    bad = F.sum((F.col("event_type") == "error").cast("long"))
    rows = _events(spark, sf).groupBy("user_id").agg(F.count("*").alias("steps"), F.min("ts").alias("started"), F.max("ts").alias("ended"), bad.alias("errors"))
    seconds = F.unix_timestamp(F.col("ended").cast("timestamp")) - F.unix_timestamp(F.col("started").cast("timestamp"))
    return rows.select("user_id", "steps", "started", "ended", seconds.alias("latency_s"), "errors", F.when(F.col("errors") > 0, "FAILED").otherwise("OK").alias("status"))


@query("""WITH l AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v, max(ts) AS t FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, round(0.4 + (least(1.0, v / 100.0) - 0.4) * exp(-(epoch(date_trunc('second', now)) - epoch(date_trunc('second', t))) * (ln(2) / 1800.0)), 4)::DOUBLE AS joy FROM l, n""")
def ambient_decay(spark, sf):
    """The last stored channel value of each key, decayed to its baseline up to the table's last instant."""
    e = _events(spark, sf)
    last = e.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"), F.max("ts").alias("t"))
    rows = last.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    age = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("t").cast("timestamp"))
    return rows.select("user_id", scores.decay_to_baseline(F.least(F.lit(1.0), F.col("v") / 100.0), F.lit(0.4), age, 1800.0).alias("joy"))


@query()
def anchored_rate_limit(spark, sf):
    """Windows that start at the first event after the last one ended; see ``streaming.state``."""
    return state.anchored_limit(_events(spark, sf), 6 * 3600, 1)


@query(emotions.oracle())
def emotion_fold(spark, sf):
    """Eight-channel state folded over each user's events in order; see ``streaming.emotions``."""
    return emotions.emotion_states(_events(spark, sf))


@query("SELECT e.event_id FROM events e JOIN (SELECT user_id, min(ts) AS cutoff FROM events WHERE event_type = 'error' GROUP BY user_id) c USING (user_id) WHERE ts > cutoff UNION ALL SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error')")
def clear_barrier(spark, sf):
    """Events after their key's cutoff; keys without one keep everything."""
    e = _events(spark, sf)
    cut = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("ts").alias("cutoff"))
    return e.join(cut, "user_id", "left").where("cutoff is null or ts > cutoff").select("event_id")


@query("SELECT event_type, count(*) AS steps, round(sum(value), 2) AS total, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def token_totals(spark, sf):
    return _events(spark, sf).groupBy("event_type").agg(F.count("*").alias("steps"), F.round(F.sum("value"), 2).alias("total"), F.round(F.avg("value"), 4).alias("mean"))


@query("SELECT user_id, event_type, round(greatest(0.5, 100.0 * sum(value) / nullif(sum(sum(value)) OVER (PARTITION BY user_id), 0)), 4) AS pct FROM events GROUP BY user_id, event_type")
def token_share(spark, sf):
    by = _events(spark, sf).groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    total = F.sum("v").over(Window.partitionBy("user_id"))
    return by.select("user_id", "event_type", F.round(F.greatest(F.lit(0.5), 100.0 * F.col("v") / F.nullif(total, F.lit(0.0))), 4).alias("pct"))


@query("""WITH d AS (SELECT *, event_id % 3 AS depth FROM events), a AS (SELECT *, sum((depth = 0)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM d),
b AS (SELECT *, sum((depth = 1)::INT) OVER (PARTITION BY user_id, r ORDER BY ts, event_id) AS c FROM a), g AS (SELECT *, sum((depth = 2)::INT) OVER (PARTITION BY user_id, r, c ORDER BY ts, event_id) AS g FROM b)
SELECT event_id, CASE depth WHEN 0 THEN '#' || r WHEN 1 THEN '#' || r || '.' || c ELSE '#' || r || '.' || c || '.' || g END AS step_no FROM g""")
def step_numbers(spark, sf):
    """Hierarchical step numbers by running counts that restart below each parent."""
    rows = _events(spark, sf).withColumn("depth", F.col("event_id") % 3)
    keys = ["user_id"]
    for depth, name in enumerate(("r", "c", "g")):
        w = Window.partitionBy(*keys).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(name, F.sum((F.col("depth") == depth).cast("long")).over(w))
        keys.append(name)
    full = F.when(F.col("depth") == 0, F.concat(F.lit("#"), "r")).when(F.col("depth") == 1, F.concat(F.lit("#"), "r", F.lit("."), "c")).otherwise(F.concat(F.lit("#"), "r", F.lit("."), "c", F.lit("."), "g"))
    return rows.select("event_id", full.alias("step_no"))


@query("SELECT e.event_id, (SELECT max(s.event_id) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'view' AND s.event_id < e.event_id) AS step_id FROM events e WHERE e.event_type = 'click'")
def latest_step_attach(spark, sf):
    """Each call with the latest earlier step of its key, by one union and one window."""
    e = _events(spark, sf)
    calls = e.where("event_type = 'click'").select("user_id", "event_id")
    steps = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("step_id"))
    return core.as_of_latest(calls, steps, ["user_id"], "event_id", "step_id", ["step_id"]).select("event_id", "step_id")


@query("SELECT event_id, CASE WHEN h < 5 THEN 'night' WHEN h < 9 THEN 'early' WHEN h < 12 THEN 'morning' WHEN h < 18 THEN 'day' ELSE 'evening' END AS band FROM (SELECT event_id, hour(ts) + minute(ts) / 60.0 AS h FROM events)")
def circadian_bands(spark, sf):
    h = F.hour("ts") + F.minute("ts") / 60.0
    return _events(spark, sf).select("event_id", F.when(h < 5, "night").when(h < 9, "early").when(h < 12, "morning").when(h < 18, "day").otherwise("evening").alias("band"))


@query("SELECT event_id, coalesce((props::JSON ->> 'k')::BIGINT, 0) AS k FROM events")
def json_field(spark, sf):
    return _events(spark, sf).select("event_id", F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0).cast("long")).alias("k"))


@query("""WITH RECURSIVE e AS (
  SELECT user_id, event_id, event_type, coalesce(trim(props, ' '), '') AS content, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE user_id IS NOT NULL),
r AS (
  SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS last, 0::BIGINT AS n, []::STRUCT(id BIGINT, s VARCHAR, c VARCHAR, a BIGINT)[] AS buf, NULL::BIGINT AS id, NULL::BIGINT AS size, NULL::BIGINT AS first_id, NULL::BIGINT AS last_id
  FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, k, us, n, CASE WHEN fires THEN held[-10:] ELSE held END, event_id, CASE WHEN fires THEN len(held) END, CASE WHEN fires THEN held[1].id END, CASE WHEN fires THEN held[-1].id END
  FROM (
    SELECT *, n % 30 = 0 AND len(held) > 0 AS fires FROM (
      SELECT *, CASE WHEN content = '' OR len(list_filter(old, lambda x: x.s = event_type AND x.c = content AND x.a = us)) > 0 THEN old
        ELSE list_append(old, {'id': event_id, 's': event_type, 'c': content, 'a': us})[-60:] END AS held
      FROM (
        SELECT e.user_id, e.k, e.us, e.event_id, e.event_type, e.content, CASE WHEN fresh THEN 1 ELSE r.n + 1 END AS n, CASE WHEN fresh THEN [] ELSE r.buf END AS old
        FROM (SELECT r.*, e.us AS next_us, coalesce(e.us >= r.last + 604800000000, false) AS fresh FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) r
        JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))))
SELECT user_id AS channel, id, n, size, first_id, last_id FROM r WHERE size IS NOT NULL""")
def topic_buffer(spark, sf):
    """Each channel's rolling buffer at every thirtieth message: its size before the trim, and its oldest and newest message."""
    rows = _events(spark, sf).select("user_id", "ts", "event_id", F.col("event_type").alias("speaker"), F.col("props").alias("content"))
    found = expiring.fold_table(rows, expiring.TopicBuffer(), "user_id", "ts", "event_id")
    return found.select(F.col("key").cast("long").alias("channel"), "id", "n", "size", "first_id", "last_id")


@query("""WITH g AS (SELECT *, coalesce(ts >= lag(ts) OVER w + INTERVAL 7 day, false)::INT AS fresh FROM events WHERE event_type IS NOT NULL WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS run FROM g)
SELECT event_type, event_id AS id, least(row_number() OVER w, 100) AS kept, first_value(event_id) OVER (PARTITION BY event_type, run ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS oldest_id
FROM i WINDOW w AS (PARTITION BY event_type, run ORDER BY ts, event_id)""")
def bounded_history(spark, sf):
    """After each trace how many of its kind are kept, 100 at most and none across a pause of a week, and the oldest of them."""
    found = expiring.fold_table(_events(spark, sf).select("event_type", "ts", "event_id"), expiring.History(), "event_type", "ts", "event_id")
    return found.withColumnRenamed("key", "event_type")


@query("SELECT conv_id, turn, coalesce(text, '') AS reply, length(coalesce(text, ''))::INT AS n_chars FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL")
def streamed_reply(spark, sf):
    """Each turn as the reply of a model: a JSON object, cut into fragments, whose field is read by the automaton and put together.

    Decoys hold the field's name in a string and in an inner object, and a letter is written as an escape, in the key too.
    """
    said = table(spark, sf, "conversations").where("conv_id is not null and turn is not null")
    parts = [F.lit('say "response": "no"').alias("note"), F.struct(F.lit("inner").alias("response")).alias("meta"), F.array(F.lit("response")).alias("list")]
    whole = F.replace(F.to_json(F.struct(*parts, F.coalesce("text", F.lit("")).alias("response"), "role")), F.lit("o"), F.lit("\\u006f"))
    fragments = fields.cut(said.select("conv_id", "turn", whole.alias("json")), "json", ["conv_id", "turn"])
    pieces = fields.field_table(fragments, "response", ["conv_id", "turn"], "seq", "fragment").where("piece <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    reply = F.array_join(F.transform(ordered, lambda x: x["piece"]), "")
    replies = said.select("conv_id", "turn").join(pieces.groupBy("conv_id", "turn").agg(reply.alias("reply")), ["conv_id", "turn"], "left")
    return replies.select("conv_id", "turn", F.coalesce("reply", F.lit("")).alias("reply"), F.length(F.coalesce("reply", F.lit(""))).alias("n_chars"))
