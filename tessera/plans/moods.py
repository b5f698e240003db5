"""Emotional state: tiers, moods, snapshots, times and safety checks as column expressions, over states made from ``events``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import core
from ..sources.tables import table
from ..streaming import state
from ..streaming import json_field as fields
from ._catalog import Literal, Register, case_sql, quoted

query = Register()

CHANNELS = state.CHANNELS
#: A state for each user: eight channels between 0 and 1, from what the user did.
_STATE = "s AS (SELECT user_id, " + ", ".join(f"round((sum(event_id * {k + 3}) % 101) / 100.0, 2)::DOUBLE AS {c}" for k, c in enumerate(CHANNELS)) + ", count(*) AS n FROM events GROUP BY user_id)"


def _states(spark, sf) -> DataFrame:
    values = [F.round((F.sum(F.col("event_id") * (k + 3)) % 101) / 100.0, 2).alias(c) for k, c in enumerate(CHANNELS)]
    return table(spark, sf, "events").groupBy("user_id").agg(*values, F.count("*").alias("n"))


# Upper bounds of the tiers of each channel; what reaches the last bound is in the last tier.
TIERS = {
    "trust": ((0.35, "T1"), (0.55, "T2"), (0.75, "T3"), (0.90, "T4"), "T5"), "attachment": ((0.20, "A1"), (0.45, "A2"), (0.70, "A3"), (0.88, "A4"), "A5"),
    "shyness": ((0.25, "B1"), (0.55, "B2"), (0.85, "B3"), "B4"), "curiosity": ((0.30, "C1"), (0.60, "C2"), (0.85, "C3"), "C4"), "comfort": ((0.30, "S1"), (0.60, "S2"), (0.85, "S3"), "S4"),
}
#: Mixed emotions and moods, the first that fits wins.
DYADS = [
    ("shyness >= 0.80 AND attachment >= 0.65 AND irritation < 0.25 AND sadness < 0.35", "Sweet Gap Moe"), ("sadness >= 0.45 AND trust >= 0.70 AND irritation < 0.25", "Vulnerable Confiding"),
    ("irritation >= 0.40 AND irritation < 0.70 AND trust >= 0.60 AND attachment >= 0.20", "Affectionate Pout"), ("joy >= 0.55 AND shyness >= 0.55 AND irritation < 0.20 AND sadness < 0.30 AND trust >= 0.40", "Flustered Sweetness"),
    ("comfort >= 0.70 AND curiosity >= 0.60 AND irritation < 0.20 AND sadness < 0.30", "Relaxed Wonder"),
]
MOODS = [
    ("irritation >= 0.40 AND trust >= 0.60 AND attachment >= 0.20", "Playful Pout"), ("irritation >= 0.40", "Annoyed"), ("sadness >= 0.40", "Sad"), ("shyness >= 0.50", "Flustered Affection"), ("curiosity >= 0.60", "Curious"), ("joy >= 0.40", "Happy"),
]
AMBIENT = [("irritation >= 0.40", "tense"), ("irritation >= 0.20", "teasing"), ("sadness >= 0.40", "melancholic"), ("joy >= 0.60 AND shyness >= 0.20", "sweet"), ("joy >= 0.50", "cheerful"), ("curiosity >= 0.50", "inquisitive"), ("comfort >= 0.60", "cosy")]


def first_of(rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    out = F.lit(otherwise).cast("string")
    for test, name in reversed(rules):
        out = F.when(F.expr(test), name).otherwise(out)
    return out


def tier(channel: str) -> Column:
    *steps, last = TIERS[channel]
    return first_of([(f"{channel} < {bound}", name) for bound, name in steps], last)


_TIER_SQL = ", ".join(case_sql([(f"{c} < {b}", quoted(n)) for b, n in steps], quoted(last)) + f" AS {c}_tier" for c, (*steps, last) in TIERS.items())
_RULES = lambda rules, otherwise=None: case_sql([(t, quoted(n)) for t, n in rules], quoted(otherwise))


@query(f"WITH {_STATE} SELECT user_id, {_TIER_SQL} FROM s")
def emotion_tiers(spark, sf):
    return _states(spark, sf).select("user_id", *[tier(c).alias(f"{c}_tier") for c in TIERS])


@query(f"WITH {_STATE} SELECT user_id, {_RULES(DYADS)} AS dyad, {_RULES(MOODS, 'Calm')} AS mood, {_RULES(AMBIENT, 'balanced')} AS ambient FROM s")
def emotion_moods(spark, sf):
    """The mixed emotion, the mood and the description of a room, each by priority."""
    return _states(spark, sf).select("user_id", first_of(DYADS).alias("dyad"), first_of(MOODS, "Calm").alias("mood"), first_of(AMBIENT, "balanced").alias("ambient"))


#: Channels that a room shares.
TRANSIENT = ("joy", "sadness", "irritation", "shyness", "curiosity", "comfort")


@query(f"WITH {_STATE}, g AS (SELECT user_id % 7 AS guild, {', '.join(f'arg_max({c}, user_id) AS {c}' for c in TRANSIENT)} FROM s GROUP BY 1) SELECT user_id, {', '.join(f'round(greatest(0.0, least(1.0, g.{c})), 4)::DOUBLE AS {c}' for c in TRANSIENT)}, trust, attachment FROM s JOIN g ON guild = user_id % 7")
def ambient_blend(spark, sf):
    """A room's latest snapshot replaces the six passing channels of everyone in it; trust and attachment stay personal."""
    s = _states(spark, sf).withColumn("guild", F.col("user_id") % 7)
    rooms = s.groupBy("guild").agg(*[F.max_by(c, "user_id").alias(f"g_{c}") for c in TRANSIENT])
    shared = [F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(f"g_{c}"))), 4).alias(c) for c in TRANSIENT]
    return s.join(rooms, "guild").select("user_id", *shared, "trust", "attachment")


@query("""WITH g AS (SELECT event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events), h AS (SELECT event_id, gap // 36000000 / 100.0 AS h FROM g WHERE gap IS NOT NULL)
SELECT event_id, CASE WHEN h < 36 THEN floor(h)::BIGINT || ' h' WHEN h < 168 THEN floor(h)::BIGINT || ' h (' || floor(h / 24)::BIGINT || ' d)' WHEN h < 336 THEN floor(h)::BIGINT || ' h (about a week)' WHEN h < 720 THEN floor(h)::BIGINT || ' h (half a month)' ELSE floor(h)::BIGINT || ' h (' || floor(h / 720)::BIGINT || ' months)' END AS absence FROM h""")
def absence_phrases(spark, sf):
    """How long somebody was away, in words by bands of hours and days."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    rows = table(spark, sf, "events").select("event_id", (us(F.col("ts")) - us(F.lag("ts").over(w))).alias("gap")).where("gap is not null")
    h = F.floor(F.col("gap") / 36000000) / 100.0
    n = F.concat(F.floor(h).cast("string"), F.lit(" h"))
    said = F.when(h < 36, n).when(h < 168, F.concat(n, F.lit(" ("), F.floor(h / 24).cast("string"), F.lit(" d)"))).when(h < 336, F.concat(n, F.lit(" (about a week)"))).when(h < 720, F.concat(n, F.lit(" (half a month)"))).otherwise(F.concat(n, F.lit(" ("), F.floor(h / 720).cast("string"), F.lit(" months)")))
    return rows.select("event_id", said.alias("absence"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts + INTERVAL 7 HOUR, '%H:%M') WHEN 1 THEN strftime(ts + INTERVAL 7 HOUR, '%H:%M') WHEN 2 THEN strftime(ts, '%H:%M') ELSE 'Now' END AS shown FROM events")
def local_times(spark, sf):
    """Times as texts: with an offset or ``Z`` they are shown at UTC+7, without they stay, and what is no time is ``Now``."""
    ts = F.col("ts").cast("timestamp")
    raw = F.when(F.col("event_id") % 4 == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(F.col("event_id") % 4 == 1, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).when(F.col("event_id") % 4 == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.lit("soon"))
    rows = table(spark, sf, "events").select("event_id", raw.alias("raw"))
    zoned = F.regexp_like("raw", F.lit("(Z|[+-][0-9]{2}:[0-9]{2})$"))
    at = F.try_to_timestamp("raw")
    shown = F.when(at.isNull(), "Now").when(zoned, F.date_format(at + F.expr("interval 7 hours"), "HH:mm")).otherwise(F.date_format(at, "HH:mm"))
    return rows.select("event_id", shown.alias("shown"))


@query(f"WITH {_STATE} SELECT a.user_id, round((greatest(0.0, 1.0 - abs(a.joy - b.joy)) + greatest(0.0, 1.0 - abs(a.sadness - b.sadness))) / 2, 6)::DOUBLE AS match FROM s a JOIN s b ON b.user_id = a.user_id + 1")
def emotion_match(spark, sf):
    """Mean closeness of a user's state and the next user's over the channels that both have, 0.5 where they share none."""
    shared = lambda a, b: F.array_intersect(F.map_keys(a), F.map_keys(b))

    def match(a: Column, b: Column) -> Column:
        total = F.aggregate(shared(a, b), F.lit(0.0), lambda acc, k: acc + F.greatest(F.lit(0.0), 1.0 - F.abs(F.try_element_at(a, k) - F.try_element_at(b, k))))
        return F.when(F.size(shared(a, b)) == 0, 0.5).otherwise(total / F.size(shared(a, b)))

    own = F.create_map(F.lit("joy"), "joy", F.lit("sadness"), "sadness", F.lit("trust"), "trust")
    theirs = F.create_map(F.lit("joy"), "joy", F.lit("sadness"), "sadness", F.lit("comfort"), "comfort")
    states = _states(spark, sf)
    others = states.select((F.col("user_id") - 1).alias("user_id"), theirs.alias("theirs"))
    return states.select("user_id", own.alias("own")).join(others, "user_id").select("user_id", F.round(match(F.col("own"), F.col("theirs")), 6).alias("match"))


#: Tokens of the three budgets, and their overrun.
BUDGETS = [("small_talk", 5000), ("rag", 8000), ("loop", 12000)]


@query(f"WITH c AS (SELECT conv_id, count(*) AS n, sum(length(text) // 2) AS used FROM conversations GROUP BY conv_id), m AS (SELECT *, CASE WHEN n <= 2 THEN 'small_talk' WHEN n % 2 = 0 THEN 'loop' ELSE 'rag' END AS mode FROM c) SELECT conv_id, mode, {case_sql([(f'mode = {quoted(m)}', str(b)) for m, b in BUDGETS])} AS budget, used <= {case_sql([(f'mode = {quoted(m)}', str(b * 108 // 100)) for m, b in BUDGETS])} AS within FROM m")
def budget_modes(spark, sf):
    """The budget that a talk falls under, and whether what it uses stays within it and its overrun of 8 %."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.floor(F.length("text") / 2)).alias("used"))
    rows = rows.withColumn("mode", F.when(F.col("n") <= 2, "small_talk").when(F.col("n") % 2 == 0, "loop").otherwise("rag"))
    pick = lambda scale: F.coalesce(*[F.when(F.col("mode") == m, b * scale // 100) for m, b in BUDGETS])
    return rows.select("conv_id", "mode", pick(100).alias("budget"), (F.col("used") <= pick(108)).alias("within"))


TAGS = [("travel", ["road", "harbor", "the "]), ("food", ["tea", "bread", "er "]), ("night", ["moon", "dark", "on "])]


@query(f"SELECT doc_id, array_to_string(list_filter([{', '.join('CASE WHEN ' + ' OR '.join(f'contains(lower(text), {quoted(w)})' for w in ws) + f' THEN {quoted(t)} END' for t, ws in TAGS)}], lambda x: x IS NOT NULL), ';') AS tags, CASE WHEN length(text) > 80 THEN substr(text, 1, 77) || '...' ELSE text END AS caption FROM documents")
def content_tags(spark, sf):
    """Tags whose keywords a text holds, and a caption of at most eighty characters."""
    low = F.lower("text")
    tags = [F.when(F.greatest(*[F.contains(low, F.lit(w)) for w in words]), F.lit(t)) for t, words in TAGS]
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_compact(F.array(*tags)), ";").alias("tags"), F.when(F.length("text") > 80, F.concat(F.substring("text", 1, 77), F.lit("..."))).otherwise(F.col("text")).alias("caption"))


NOTES = Literal("notes", "id long, raw string", [(1, '["Likes tea", " ", "Lives by the sea"]'), (2, "One line\n- two\n\n* three"), (3, ""), (4, None)], given=("documents", ["1000000 + doc_id", "text"]))


@query(f"""WITH {NOTES.sql}, l AS (SELECT id, CASE WHEN raw IS NULL THEN [] WHEN starts_with(raw, '[') THEN (raw::JSON)::VARCHAR[] ELSE string_split(raw, chr(10)) END AS ls FROM notes)
SELECT id, array_to_string(list_transform(list_filter(list_transform(ls, lambda x: trim(regexp_replace(trim(x), '^[-*]\\s*', ''))), lambda x: x <> ''), lambda x: '- ' || x), chr(10)) AS bullets FROM l""")
def fact_bullets(spark, sf):
    """Facts that come as a list or as lines, as bullet points."""
    items = F.when(F.col("raw").startswith("["), F.from_json("raw", "array<string>")).otherwise(F.split("raw", "\n"))
    bare = F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(F.regexp_replace(F.trim(x), "^[-*]\\s*", ""))), lambda x: x != "")
    return NOTES.frame(spark, sf).select("id", F.array_join(F.transform(bare, lambda x: F.concat(F.lit("- "), x)), "\n").alias("bullets"))


ANSWERS = Literal("answers", "id long, doc string", [(1, '{"response": "Hi", "sentiment": "0.7", "images": ["a", "b", "c", "d"], "tags": "x"}'), (2, '{"response": 5, "images": []}'), (3, "{}")], given=("conversations", ["1000000 + conv_id * 1000 + turn", "concat('{\"response\": \"', role, '\", \"sentiment\": \"0.5\"}')"]))


@query(f"""WITH {ANSWERS.sql} SELECT id, coalesce(doc->>'$.response', '') AS response, coalesce(try_cast(doc->>'$.sentiment' AS DOUBLE), 0.0)::DOUBLE AS sentiment, least(3, coalesce(json_array_length(doc->'$.images'), 0))::BIGINT AS images FROM answers""")
def response_fields(spark, sf):
    """Fields of a reply with their types forced: texts, a number or 0, and at most three images."""
    get = lambda p: F.get_json_object("doc", p)
    images = F.from_json(get("$.images"), "array<string>")
    return ANSWERS.frame(spark, sf).select("id", F.coalesce(get("$.response"), F.lit("")).alias("response"), F.coalesce(F.expr("try_cast(get_json_object(doc, '$.sentiment') as double)"), F.lit(0.0)).alias("sentiment"), F.least(F.lit(3), F.coalesce(F.size(images), F.lit(0))).cast("long").alias("images"))


FILES = Literal("files", "id long, head string, ip string", [(1, "FFD8FFE0", "10.1.2.3"), (2, "89504E470D0A1A0A", "8.8.8.8"), (3, "52494646AAAAAAAA57454250", "127.0.0.1"), (4, "4749463839", "192.168.0.9"), (5, "00", "172.20.1.1"), (6, "25504446", "169.254.1.1"), (7, "FFD8", "x")], given=("pages", ["1000000 + page_id", "concat('FFD8FFE', page_id % 10)", "concat(page_id % 224, '.', page_id % 256, '.0.', page_id % 7)"]))
# Signatures of image files, and networks that are never fetched from.
SIGNATURES = [("^FFD8FF", "jpeg"), ("^89504E470D0A1A0A", "png"), ("^52494646.{8}57454250", "webp"), ("^474946383[79]", "gif")]
DENIED = [("10.0.0.0", 8), ("127.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16), ("0.0.0.0", 8)]


def _number(ip: str) -> int:
    a, b, c, d = map(int, ip.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


_IP = "CASE WHEN regexp_matches(ip, '^\\d+\\.\\d+\\.\\d+\\.\\d+$') THEN split_part(ip, '.', 1)::BIGINT * 16777216 + split_part(ip, '.', 2)::BIGINT * 65536 + split_part(ip, '.', 3)::BIGINT * 256 + split_part(ip, '.', 4)::BIGINT END"


@query(f"""WITH {FILES.sql}, n AS (SELECT *, {_IP} AS n FROM files) SELECT id, {case_sql([(f"regexp_matches(head, '{p}')", quoted(k)) for p, k in SIGNATURES])} AS kind, n IS NULL OR {' OR '.join(f'n // {1 << (32 - m)} = {_number(net) >> (32 - m)}' for net, m in DENIED)} AS denied FROM n""")
def fetch_guards(spark, sf):
    """The kind of a file by its first bytes, and whether its address is one that must not be fetched."""
    kind = F.lit(None).cast("string")
    for pattern, name in reversed(SIGNATURES):
        kind = F.when(F.regexp_like("head", F.lit(pattern)), name).otherwise(kind)
    part = lambda k: F.regexp_extract("ip", "^(\\d+)\\.(\\d+)\\.(\\d+)\\.(\\d+)$", k)
    n = F.when(part(1) != "", part(1).cast("long") * 16777216 + part(2).cast("long") * 65536 + part(3).cast("long") * 256 + part(4).cast("long"))
    rows = FILES.frame(spark, sf).withColumn("n", n)
    inside = [F.shiftright("n", 32 - m) == (_number(net) >> (32 - m)) for net, m in DENIED]
    denied = F.col("n").isNull()
    for test in inside:
        denied = denied | F.coalesce(test, F.lit(False))
    return rows.select("id", kind.alias("kind"), denied.alias("denied"))


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) SELECT event_id, k % 3 = 0 AS extract, k % 10 = 0 AS summarise, k % 100 = 0 AS refresh, k % 30 = 0 AS topic FROM e""")
def background_triggers(spark, sf):
    """What an event sets off in the background: every third, tenth, hundredth and thirtieth of its user."""
    rows = core.ranked(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "k")
    return rows.select("event_id", *[(F.col("k") % n == 0).alias(name) for name, n in (("extract", 3), ("summarise", 10), ("refresh", 100), ("topic", 30))])


@query("SELECT user_id AS trace, last_ts FROM (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id) ORDER BY last_ts DESC, trace LIMIT 100")
def trace_history(spark, sf):
    """The hundred latest traces."""
    return table(spark, sf, "events").groupBy(F.col("user_id").alias("trace")).agg(F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts"), "trace").limit(100)


@query("SELECT event_type AS channel, user_id AS reader, count(*) AS received FROM (SELECT a.event_type, b.user_id FROM events a JOIN (SELECT DISTINCT event_type, user_id FROM events) b ON a.event_type = b.event_type AND a.user_id <> b.user_id) GROUP BY ALL")
def pubsub_fanout(spark, sf):
    """What each reader of a channel receives: all of its messages but their own. Counted, not listed, so no pair is made."""
    ev = table(spark, sf, "events")
    own = ev.groupBy(F.col("event_type").alias("channel"), F.col("user_id").alias("reader")).agg(F.count("*").alias("own"))
    every = ev.groupBy(F.col("event_type").alias("channel")).agg(F.count("*").alias("n"))
    return own.join(every, "channel").select("channel", "reader", (F.col("n") - F.col("own")).alias("received")).where("received > 0")


@query("""WITH v AS (SELECT l_partkey AS entity, max(l_shipdate) AS updated FROM lineitem GROUP BY 1), g AS (SELECT max(l_shipdate) AS latest FROM lineitem) SELECT entity, updated > latest - INTERVAL 30 DAY AS reload FROM v, g""")
def dimension_refresh(spark, sf):
    """Which entries of a cached dimension have changed since it was last read."""
    li = table(spark, sf, "lineitem")
    latest = li.agg(F.max("l_shipdate").alias("latest"))
    rows = li.groupBy(F.col("l_partkey").alias("entity")).agg(F.max("l_shipdate").alias("updated")).crossJoin(F.broadcast(latest))
    return rows.select("entity", (F.col("updated") > F.expr("latest - interval 30 days")).alias("reload"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type = 'error' AS bad, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, event_id, 'CLOSED' AS before, true AS allowed, CASE WHEN bad THEN 1 ELSE 0 END AS fails, CASE WHEN bad AND 1 >= 2 THEN t END AS opened FROM e WHERE k = 1
UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN opened IS NULL THEN 'CLOSED' WHEN t >= opened + 3600 THEN 'HALF_OPEN' ELSE 'OPEN' END, opened IS NULL OR t >= opened + 3600,
  CASE WHEN opened IS NOT NULL AND t < opened + 3600 THEN fails WHEN bad THEN fails + 1 ELSE 0 END, CASE WHEN opened IS NOT NULL AND t < opened + 3600 THEN opened WHEN bad AND (opened IS NOT NULL OR fails + 1 >= 2) THEN t END
FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1) SELECT event_id, before AS state, allowed FROM r""")
def circuit_breaker(spark, sf):
    """The breaker's state at each call: two failures open it, an hour later one call may try, and its outcome closes or opens it again."""
    return state.breaker(table(spark, sf, "events"), failures=2, rest=3600.0)


@query("""SELECT conv_id, string_agg(text, '' ORDER BY turn) AS emitted FROM conversations GROUP BY conv_id""")
def incremental_field(spark, sf):
    """A whole conversation as one JSON field that comes in fragments: what all of them together give."""
    said = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("said"))
    whole = F.to_json(F.struct(F.array_join(F.transform("said", lambda x: x["text"]), "").alias("response")))
    fragments = fields.cut(said.select("conv_id", whole.alias("json")), "json", ["conv_id"], 50)
    pieces = fields.field_table(fragments, "response", ["conv_id"], "seq", "fragment")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "piece")))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias("emitted"))
