"""Understanding of messages: cleaning, routing, entities, snippets, facts and formats, over ``conversations``, ``benchmark`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import core
from ..sources.tables import table
from . import retrieval
from ._catalog import Literal, Register, case_sql, chain, chain_sql, quoted

query = Register()

# What a chat platform puts into messages.
MENTIONS = [("<@!?&?[0-9]+>", ""), ("<#[0-9]+>", ""), ("<a?:[a-zA-Z0-9_]+:[0-9]+>", ""), ("<t:[0-9]+(?::[a-zA-Z])?>", ""), ("@(everyone|here)\\b", ""), ("[ \\t\\n\\r]+", " ")]
#: Words around a question, by what is stripped: abbreviations, greetings, requests before it and particles after it. Parameters of a deployment.
#: Short forms as whole words, also beside letters beyond ASCII; twice, as neighbours share the blank between them.
SHORT = [(f"(^|[^\\p{{L}}\\p{{N}}_]){short}([^\\p{{L}}\\p{{N}}_]|$)", f"\\1{long}\\2") for short, long in (("u", "you"), ("pls", "please"), ("r", "are"))] * 2
GREETINGS, REQUESTS, ENDINGS, NAMES = ["hello there", "hello", "hi", "hey"], ["can you tell me about", "tell me about", "do you know", "please"], ["please", "thanks", "right", "ok"], ["bot"]
REACTIONS = ["haha", "ok", "okay", "wow", "thanks", "bye", "yes", "no", "it", "me", "you"]
CODE = "(?i)\\bclass\\s+\\w+|\\bstruct\\s+\\w+|\\bpublic\\s*:|\\bprivate\\s*:|\\b#include\\b|\\bint\\s+main\\b|\\bdef\\s+\\w+\\s*\\(|\\bfunction\\s+\\w+\\s*\\(|\\bvoid\\s+\\w+\\s*\\(|\\bunordered_map<|\\bvector<|\\bconsole\\.log\\("
REFERS = "(?i)\\b(he|she|it|they|that one|this one|there)\\b|^(and|so|then)\\b"
IMAGE_NOUNS, IMAGE_ACTIONS, IMAGE_ANCHORS = ["image", "photo", "picture"], ["show", "send", "find", "last time"], ["show me the picture", "send the image"]
TOOLS = [("summary", "(?i)summar(y|ise|ize)|so far"), ("report", "(?i)(show|give).{0,15}report"), ("web_search", "(?i)search (the )?(web|google)|look it up")]

ASKS = Literal("asks", "id long, message string, entities array<string>", [
    (1, "<@!123> Hello there, can you tell me about the salt harbor please?", ["Salt Harbor"]), (2, "haha ok", []), (3, "And where is it?", []), (4, "def run(x): return x", []), (5, "Show me the picture of the bow", ["Long Bow"]),
    (6, "hi bot pls search the web for tides <:wave:77>", []), (7, "Give a report <t:1700000000:R> @everyone", []), (8, "", []), (9, "   ", None), (10, "tell me about Mira and the long bow, thanks", ["Mira Vale", "Long Bow"]), (11, "what did we say so far", []), (12, None, []),
], given=("conversations", ["1000000 + conv_id * 1000 + turn", "text", "[role]"]))


def _any(words: list[str]) -> str:
    return "|".join(w.replace(".", "\\.") for w in sorted(words, key=len, reverse=True))


EDGES = [("^[,.?!\\s:-]+|[,.?!\\s:-]+$", "")]
ONCE = EDGES + [(f"^(?:{_any(GREETINGS)})(?:\\s+|$|[,.?!:-])", ""), ("^\\s+", ""), (f"^(?:{_any(REQUESTS)})(?:\\s+|$|[,.?!:-])", ""), ("^\\s+", ""), (f"(?:\\s+|^|[,.?!:-])(?:{_any(ENDINGS)})$", ""), (f"^(?:{_any(NAMES)})(?:\\s+|$|[,.?!:-])", ""), ("^\\s+|\\s+$", "")]
CLEANING = MENTIONS + [("^\\s+|\\s+$", "")]
#: Three passes, as one may uncover what the next strips.
QUESTION = SHORT + ONCE * 3 + EDGES


def cleaned(message: Column) -> Column:
    """The question in a message without mentions, greetings, requests and particles; the message itself where nothing would be left."""
    plain = chain(F.coalesce(message, F.lit("")), CLEANING)
    out = chain(F.lower(plain), QUESTION)
    return F.when(out == "", plain).otherwise(out)


_PLAIN = chain_sql("coalesce(message, '')", CLEANING)
_CLEAN = f"CASE WHEN {chain_sql(f'lower({_PLAIN})', QUESTION)} = '' THEN {_PLAIN} ELSE {chain_sql(f'lower({_PLAIN})', QUESTION)} END"


@query(f"WITH {ASKS.sql} SELECT id, {_PLAIN} AS plain, {_CLEAN} AS question FROM asks")
def query_cleaning(spark, sf):
    return ASKS.frame(spark, sf).select("id", chain(F.coalesce("message", F.lit("")), CLEANING).alias("plain"), cleaned(F.col("message")).alias("question"))


def meaningful(question: Column) -> Column:
    """At least three letters in words that aren't mere reactions."""
    words = F.filter(F.regexp_extract_all(F.lower(question), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)), lambda w: ~w.isin(REACTIONS))
    return F.length(F.array_join(words, "")) >= 3


_MEANS = f"length(array_to_string(list_filter(regexp_extract_all(lower(q), '[\\p{{L}}\\p{{N}}_]+'), lambda w: w NOT IN ({', '.join(map(quoted, REACTIONS))})), '')) >= 3"


@query(f"""WITH {ASKS.sql}, c AS (SELECT id, coalesce(message, '') AS m, {_CLEAN} AS q FROM asks) SELECT id, {_MEANS} AS meaningful, regexp_matches(m, {quoted(REFERS)}) AS refers, regexp_matches(m, {quoted(CODE)}) AS code,
({' OR '.join(f"contains(lower(m), {quoted(x)})" for x in IMAGE_ANCHORS)}) OR (({' OR '.join(f"contains(lower(m), {quoted(x)})" for x in IMAGE_NOUNS)}) AND ({' OR '.join(f"contains(lower(m), {quoted(x)})" for x in IMAGE_ACTIONS)})) AS image,
{case_sql([(f"regexp_matches(m, {quoted(p)})", quoted(t)) for t, p in TOOLS])} AS tool FROM c""")
def message_tests(spark, sf):
    """Is a message meaningful, does it refer back, is it code, does it ask for an image, and which tool's words does it hold."""
    m = F.coalesce("message", F.lit(""))
    has = lambda words: F.greatest(*[F.contains(F.lower(m), F.lit(w)) for w in words])
    tool = F.lit(None).cast("string")
    for name, pattern in reversed(TOOLS):
        tool = F.when(F.regexp_like(m, F.lit(pattern)), name).otherwise(tool)
    return ASKS.frame(spark, sf).select(
        "id", meaningful(cleaned(F.col("message"))).alias("meaningful"), F.regexp_like(m, F.lit(REFERS)).alias("refers"), F.regexp_like(m, F.lit(CODE)).alias("code"),
        (has(IMAGE_ANCHORS) | (has(IMAGE_NOUNS) & has(IMAGE_ACTIONS))).alias("image"), tool.alias("tool"),
    )


_ROUTE = f"""c AS (SELECT id, coalesce(message, '') AS m, entities, {_CLEAN} AS q FROM asks), f AS (SELECT *, {_MEANS} AS means, regexp_matches(m, {quoted(CODE)}) AS code, coalesce(len(entities), 0) > 0 AS named,
{case_sql([(f"regexp_matches(m, {quoted(p)})", quoted(t)) for t, p in TOOLS])} AS tool, len(string_split(trim(m), ' ')) AS n FROM c)"""


def _routed(spark, sf) -> DataFrame:
    m = F.coalesce("message", F.lit(""))
    tool = F.lit(None).cast("string")
    for name, pattern in reversed(TOOLS):
        tool = F.when(F.regexp_like(m, F.lit(pattern)), name).otherwise(tool)
    rows = ASKS.frame(spark, sf).withColumns({"q": cleaned(F.col("message")), "code": F.regexp_like(m, F.lit(CODE)), "named": F.coalesce(F.size("entities") > 0, F.lit(False)), "tool": tool, "n": F.size(F.split(F.trim(m), " ")).cast("long")})
    return rows.withColumn("means", meaningful(F.col("q"))).withColumn("named", F.col("named"))


@query(f"""WITH {ASKS.sql}, {_ROUTE} SELECT id, CASE WHEN code OR named OR tool IS NOT NULL OR n > 25 THEN 'KNOWLEDGE' WHEN NOT means OR n <= 2 THEN 'SMALL_TALK' ELSE 'KNOWLEDGE' END AS intent,
array_to_string(list_filter([CASE WHEN tool IS NOT NULL THEN 'TOOL' END, CASE WHEN named THEN 'LORE' END, CASE WHEN code THEN 'CODE' END, CASE WHEN NOT means THEN 'CHAT' END], lambda x: x IS NOT NULL), ';') AS intents,
CASE WHEN tool = 'web_search' AND named THEN 'HYBRID' WHEN tool = 'web_search' THEN 'WEB' WHEN named OR means THEN 'VECTOR' ELSE 'BYPASS' END AS mode FROM f""")
def intent_routing(spark, sf):
    """Small talk or knowledge, the list of intents, and where to retrieve from."""
    intent = F.when(F.col("code") | F.col("named") | F.col("tool").isNotNull() | (F.col("n") > 25), "KNOWLEDGE").when(~F.col("means") | (F.col("n") <= 2), "SMALL_TALK").otherwise("KNOWLEDGE")
    intents = F.array_compact(F.array(F.when(F.col("tool").isNotNull(), "TOOL"), F.when(F.col("named"), "LORE"), F.when(F.col("code"), "CODE"), F.when(~F.col("means"), "CHAT")))
    web = F.col("tool").eqNullSafe("web_search")
    mode = F.when(web & F.col("named"), "HYBRID").when(web, "WEB").when(F.col("named") | F.col("means"), "VECTOR").otherwise("BYPASS")
    return _routed(spark, sf).select("id", intent.alias("intent"), F.array_join(intents, ";").alias("intents"), mode.alias("mode"))


@query(f"""WITH {ASKS.sql}, c AS (SELECT id, {_CLEAN} AS q, entities FROM asks), a AS (SELECT *, list_sort(list_distinct(list_filter(coalesce(entities, []), lambda e: NOT contains(lower(q), lower(e))))) AS more FROM c)
SELECT id, CASE WHEN len(more) > 0 THEN q || ' (' || array_to_string(more, ', ') || ')' ELSE q END AS enriched FROM a""")
def query_enrichment(spark, sf):
    """Entities that the question doesn't name in full are appended, sorted."""
    more = F.sort_array(F.array_distinct(F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: ~F.contains(F.lower("q"), F.lower(e)))))
    rows = ASKS.frame(spark, sf).withColumn("q", cleaned(F.col("message"))).withColumn("more", more)
    return rows.select("id", F.when(F.size("more") > 0, F.concat("q", F.lit(" ("), F.array_join("more", ", "), F.lit(")"))).otherwise(F.col("q")).alias("enriched"))


SLANG = Literal("slang", "pattern string, canonical string", [("green dragon", "Jade Wyrm"), ("the port", "Salt Harbor"), ("bow lady", "Mira Vale")])
CHATTER = Literal("chatter", "id long, said string", [(1, "Where is the port?"), (2, "I met Green Dragon near the port"), (3, "bow ladybird"), (4, "nothing"), (5, None)], given=("conversations", ["1000000 + conv_id * 1000 + turn", "text"]))


@query(f"WITH {CHATTER.sql} SELECT id, {chain_sql('said', [(f'(?i)' + chr(92) + 'b' + p + chr(92) + 'b', c) for p, c in SLANG.rows])} AS resolved FROM chatter")
def slang_resolution(spark, sf):
    """Nicknames become canonical names; the rules are a small table in order."""
    return CHATTER.frame(spark, sf).select("id", chain(F.col("said"), [(f"(?i)\\b{p}\\b", c) for p, c in SLANG.rows]).alias("resolved"))


@query(r"""WITH t AS (SELECT conv_id, turn, CASE WHEN starts_with(text, '!') THEN text WHEN turn % 3 = 0 THEN '!ask ' || text ELSE text END AS text FROM conversations)
SELECT conv_id, turn, CASE WHEN starts_with(text, '!') THEN lower(split_part(regexp_replace(text[2:], '\s+', ' ', 'g'), ' ', 1)) END AS command, CASE WHEN starts_with(text, '!') THEN length(trim(regexp_replace(text[2:], '^\S+', ''))) END AS rest FROM t""")
def prefix_commands(spark, sf):
    """Messages that begin with the prefix, cut into the command and the rest."""
    text = F.when(F.col("text").startswith("!"), F.col("text")).when(F.col("turn") % 3 == 0, F.concat(F.lit("!ask "), "text")).otherwise(F.col("text"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", text.alias("text")).withColumn("body", F.when(F.col("text").startswith("!"), F.substring("text", 2, 1 << 30)))
    return rows.select("conv_id", "turn", F.lower(F.substring_index(F.regexp_replace("body", "\\s+", " "), " ", 1)).alias("command"), F.length(F.trim(F.regexp_replace("body", "^\\S+", ""))).cast("long").alias("rest"))


@query(r"""SELECT conv_id, turn, md5(trim(regexp_replace(regexp_replace(text || CASE WHEN turn % 2 = 0 THEN ' <emotion>calm ' || turn || '</emotion> end' ELSE '' END, '(?is)<emotion>.*?</emotion>', '', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS body FROM conversations""")
def message_content(spark, sf):
    """Messages without the blocks that report emotions."""
    text = F.concat("text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" <emotion>calm "), F.col("turn").cast("string"), F.lit("</emotion> end"))).otherwise(""))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.md5(F.trim(chain(text, [("(?is)<emotion>.*?</emotion>", ""), ("[ \\t\\n\\r]+", " ")]))).alias("body"))


def split_points(text: Column, limit: int) -> Column:
    """Ends of the parts of a message: at the last newline, else the last space, beyond 60 % of the limit, else at the limit."""
    start = F.struct(F.array().cast("array<int>").alias("ends"), F.lit(0).alias("at"))

    def step(acc: Column, _: Column) -> Column:
        part = F.substring(text, acc["at"] + 1, F.lit(limit))
        last = lambda c: F.lit(limit) - F.instr(F.reverse(part), c) + 1
        cut = F.when(F.contains(part, F.lit("\n")) & (last("\n") >= int(0.6 * limit)), last("\n")).when(F.contains(part, F.lit(" ")) & (last(" ") >= int(0.6 * limit)), last(" ")).otherwise(F.lit(limit))
        left = F.length(text) - acc["at"]
        end = acc["at"] + F.when(left <= limit, left).otherwise(cut)
        return F.when(left > 0, F.struct(F.concat(acc["ends"], F.array(end.cast("int"))).alias("ends"), end.cast("int").alias("at"))).otherwise(acc)

    most = F.sequence(F.lit(1), F.ceil(F.length(text) / (0.6 * limit)).cast("int") + 1)
    return F.aggregate(most, start, step, lambda acc: acc["ends"])


@query()
def message_split(spark, sf):
    """Long texts as messages of at most 1900 characters."""
    rows = table(spark, sf, "documents").select("doc_id", "text", split_points(F.col("text"), 1900).alias("ends"))
    rows = rows.select("doc_id", "text", F.posexplode("ends").alias("part", "end_"), "ends")
    start = F.when(F.col("part") == 0, 0).otherwise(F.get("ends", F.col("part") - 1))
    return rows.select("doc_id", F.col("part").cast("long").alias("part"), start.cast("long").alias("start"), F.col("end_").cast("long").alias("end_"), F.md5(F.substring(F.col("text"), start + 1, F.col("end_") - start)).alias("digest"))


_TOK = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(g.text), '[\\p{L}\\p{N}_]+'), lambda w: length(w) >= 3)))[1:6]"


@query(f"""WITH {retrieval.WORDS_SQL}, q AS (SELECT item_id, {_TOK} AS toks FROM benchmark g), s AS (SELECT item_id, doc_id, substr(text, 1, 300) AS snip, toks, found.rank AS pos FROM q JOIN found USING (item_id) JOIN documents USING (doc_id) WHERE found.rank <= 20),
g AS (SELECT *, row_number() OVER (PARTITION BY item_id, substr(snip, 1, 80) ORDER BY pos) = 1 AS fresh, length(snip) >= 30 AS long_, len(toks) < 3 OR len(list_filter(toks, lambda t: contains(lower(snip), t))) > 0 AS near FROM s),
f AS (SELECT *, long_ AND fresh AND near AS good, bool_or(long_ AND fresh AND near) OVER (PARTITION BY item_id) AS any_ FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS rank FROM f WHERE good OR (NOT any_ AND fresh)) SELECT item_id, doc_id, rank FROM k WHERE rank <= 4""")
def snippet_filter(spark, sf):
    """Of the twenty results of each question, searched among all documents, the first four good snippets: long enough, new in their first 80 characters and sharing a word; all new ones where none is good.

    A snippet is the 300 characters that a result shows.
    """
    toks = F.slice(F.sort_array(F.array_distinct(F.filter(F.regexp_extract_all(F.lower("gold"), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)), lambda w: F.length(w) >= 3))), 1, 6)
    q = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("gold")).select("item_id", toks.alias("toks"))
    results = retrieval.by_words(spark, sf, 20).withColumnRenamed("rank", "pos").join(q, "item_id")
    rows = table(spark, sf, "documents").select("doc_id", F.substring("text", 1, 300).alias("snip")).join(results, "doc_id")
    rows = core.ranked(rows, ["item_id", F.substring("snip", 1, 80)], ["pos"], "same")
    near = (F.size("toks") < 3) | F.exists("toks", lambda t: F.contains(F.lower("snip"), t))
    rows = rows.withColumn("fresh", F.col("same") == 1).withColumn("good", (F.length("snip") >= 30) & F.col("fresh") & near)
    rows = rows.withColumn("any_", F.bool_or("good").over(Window.partitionBy("item_id")))
    return core.top_k(rows.where("good or (not any_ and fresh)"), ["item_id"], ["pos"], 4).select("item_id", "doc_id", "rank")


@query("""WITH c AS (SELECT page_id, split_part(url, '/', 3) AS site, trim(regexp_replace(regexp_replace(html, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS body FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY page_id) AS k FROM c WHERE length(body) >= 150 AND NOT regexp_matches(lower(body), 'access denied|enable javascript|captcha')) SELECT page_id, site, md5(substr(body, 1, 2500)) AS body FROM r WHERE k <= 2""")
def deep_pages(spark, sf):
    """The first two pages of each site that hold enough text and aren't a barrier, cut to 2500 characters."""
    body = F.trim(chain(F.col("html"), [("(?s)<[^>]*>", " "), ("[ \\t\\n\\r]+", " ")]))
    rows = table(spark, sf, "pages").select("page_id", F.get(F.split("url", "/"), F.lit(2)).alias("site"), body.alias("body"))
    rows = rows.where((F.length("body") >= 150) & ~F.regexp_like(F.lower("body"), F.lit("access denied|enable javascript|captcha")))
    return core.top_k(rows, ["site"], ["page_id"], 2, "k").select("page_id", "site", F.md5(F.substring("body", 1, 2500)).alias("body"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href FROM pages) SELECT page_id, count(*) AS n, count(DISTINCT href) AS links, coalesce(min(href), '') AS first_link FROM l GROUP BY page_id""")
def search_results(spark, sf):
    """Links of a result page."""
    rows = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))).alias("href"))
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.countDistinct("href").alias("links"), F.coalesce(F.min("href"), F.lit("")).alias("first_link"))


FACTS = Literal("facts", "id long, kind string, fact string, importance double", [
    (1, "preference", "The user likes tea", 0.9), (2, "user_fact", "short", 0.9), (3, "user_fact", "The user is from the coast", 0.64), (4, "gossip", "Someone said something", 0.9), (5, "guild_event", "Festival at the harbor", 0.8), (6, "profile", "You are an assistant by design", 0.95), (7, "user_fact", "The user is called Tam", None),
], given=("documents", ["1000000 + doc_id", "lang", "text", "cast(n_chars as double) / 1000"]))
#: Kinds that count as facts about the user, kinds that are stored, what speaks of the assistant itself.
AS_FACT, STORED, PERSONA = ["preference", "profile", "habit"], ["user_fact", "guild_event", "shared_story"], "(?i)\\b(assistant|language model|system prompt)\\b"


@query(f"""WITH {FACTS.sql}, k AS (SELECT *, CASE WHEN kind IN ('{"', '".join(AS_FACT)}') THEN 'user_fact' ELSE kind END AS k FROM facts)
SELECT id, k AS kind FROM k WHERE k IN ('{"', '".join(STORED)}') AND length(fact) >= 8 AND importance >= 0.65 AND NOT regexp_matches(fact, {quoted(PERSONA)})""")
def fact_validation(spark, sf):
    """Extracted facts that may be stored: known kinds, long and important enough, not about the assistant."""
    kind = F.when(F.col("kind").isin(AS_FACT), "user_fact").otherwise(F.col("kind"))
    rows = FACTS.frame(spark, sf).withColumn("kind", kind)
    return rows.where(F.col("kind").isin(STORED) & (F.length("fact") >= 8) & (F.col("importance") >= 0.65) & ~F.regexp_like("fact", F.lit(PERSONA))).select("id", "kind")


@query("""WITH p AS (SELECT a.vec_id AS fact_id, b.vec_id AS memory_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id <> a.vec_id WHERE a.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY sim DESC, memory_id) AS k FROM p WHERE sim >= 0.1), m AS (SELECT fact_id, arg_min(memory_id, k) AS candidate, max(sim) AS sim FROM t WHERE k <= 3 GROUP BY fact_id)
SELECT vec_id AS fact_id, CASE WHEN sim >= 0.85 THEN 'DUPLICATE' WHEN sim >= 0.3 THEN 'CONTRADICT' ELSE 'KEEP_BOTH' END AS decision, CASE WHEN sim >= 0.3 THEN candidate END AS replaces FROM embeddings LEFT JOIN m ON vec_id = fact_id WHERE vec_id % 20 = 0""")
def conflict_reconciliation(spark, sf):
    """New facts against their best stored candidates: a duplicate is dropped, a near one replaced, anything else kept beside; without a candidate both stay."""
    near = core.top_k(retrieval._searched(spark, sf, 3, scoped=True, least=0.1, itself=False), ["q_id"], [F.desc("sim"), "vec_id"], 3, "k")
    best = near.groupBy(F.col("q_id").alias("fact_id")).agg(F.min_by("vec_id", "k").alias("candidate"), F.max("sim").alias("sim"))
    facts = table(spark, sf, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("fact_id"))
    decision = F.when(F.col("sim") >= 0.85, "DUPLICATE").when(F.col("sim") >= 0.3, "CONTRADICT").otherwise("KEEP_BOTH")
    return facts.join(best, "fact_id", "left").select("fact_id", decision.alias("decision"), F.when(F.col("sim") >= 0.3, F.col("candidate")).alias("replaces"))


PARTS = Literal("parts", "id long, spec string, most int", [(1, "1,3,5-8", 7), (2, "9-12", 10), (3, "x,2", 5), (4, "4-2", 9), (5, "", 3)], given=("lineitem", ["1000000 + l_orderkey * 10 + l_linenumber", "concat(l_linenumber, '-', l_linenumber + 2, ',', l_linenumber)", "cast(7 as int)"]))


@query(rf"""WITH {PARTS.sql}, p AS (SELECT id, most, unnest(string_split(spec, ',')) AS p FROM parts), b AS (SELECT id, most, regexp_extract(trim(p), '^(\d+)(?:-(\d+))?$', 1) AS a, regexp_extract(trim(p), '^(\d+)(?:-(\d+))?$', 2) AS b FROM p),
n AS (SELECT id, most, unnest(range(a::INT, CASE WHEN b = '' THEN a::INT ELSE b::INT END + 1)) AS i FROM b WHERE a <> '') SELECT id, string_agg(DISTINCT i, ',' ORDER BY i) AS chosen FROM n WHERE i BETWEEN 1 AND most GROUP BY id""")
def index_ranges(spark, sf):
    """Selections like ``1,3,5-8`` as sorted distinct numbers within bounds; what isn't one is left out."""
    rows = PARTS.frame(spark, sf).select("id", "most", F.explode(F.split("spec", ",")).alias("p"))
    rows = rows.select("id", "most", F.regexp_extract(F.trim("p"), "^(\\d+)(?:-(\\d+))?$", 1).alias("a"), F.regexp_extract(F.trim("p"), "^(\\d+)(?:-(\\d+))?$", 2).alias("b")).where("a <> ''")
    low, high = F.col("a").cast("int"), F.when(F.col("b") == "", F.col("a")).otherwise(F.col("b")).cast("int")
    rows = rows.where(low <= high).select("id", "most", F.explode(F.sequence(low, high)).alias("i")).where("i between 1 and most")
    return rows.groupBy("id").agg(F.array_join(F.sort_array(F.collect_set("i")), ",").alias("chosen"))


FALLBACK = ["service temporarily unavailable", "internal server error", "empty response", "try again later"]


@query(f"""WITH r AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'Internal Server Error: ' || turn WHEN 1 THEN '  ' WHEN 2 THEN NULL ELSE text END AS reply FROM conversations)
SELECT conv_id, turn, reply IS NULL OR trim(reply) = '' OR {' OR '.join(f"contains(lower(reply), '{p}')" for p in FALLBACK)} AS fallback FROM r""")
def fallback_replies(spark, sf):
    """Replies that are empty or an apology, which are never cached."""
    reply = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("Internal Server Error: "), F.col("turn").cast("string"))).when(F.col("turn") % 5 == 1, "  ").when(F.col("turn") % 5 == 2, F.lit(None)).otherwise(F.col("text"))
    bad = F.greatest(*[F.contains(F.lower("reply"), F.lit(p)) for p in FALLBACK])
    return table(spark, sf, "conversations").select("conv_id", "turn", reply.alias("reply")).select("conv_id", "turn", F.coalesce(F.col("reply").isNull() | (F.trim("reply") == "") | bad, F.lit(True)).alias("fallback"))


TOP = 1200


@query(f"""WITH p AS (SELECT doc_id, text AS parent, substr(text, 1500, 200) AS child FROM documents), f AS (SELECT *, CASE WHEN length(child) >= 80 THEN strpos(parent, substr(child, 1, 80)) ELSE 0 END AS p80, CASE WHEN length(child) >= 20 THEN strpos(parent, substr(child, 1, 20)) ELSE 0 END AS p20 FROM p),
h AS (SELECT *, CASE WHEN p80 > 0 THEN p80 ELSE p20 END AS hit, ({TOP} - length(child)) // 2 AS half FROM f),
w AS (SELECT *, greatest(1, hit - half) AS from_, least(length(parent), hit + length(child) - 1 + half) AS to_ FROM h)
SELECT doc_id, CASE WHEN length(parent) <= {TOP} THEN length(parent) WHEN child = '' THEN {TOP} WHEN hit = 0 THEN length(child) ELSE to_ - from_ + 1 END::BIGINT AS chars,
md5(CASE WHEN length(parent) <= {TOP} THEN parent WHEN child = '' THEN substr(parent, 1, {TOP}) WHEN hit = 0 THEN child ELSE CASE WHEN from_ > 1 THEN '... ' ELSE '' END || substr(parent, from_, to_ - from_ + 1) || CASE WHEN to_ < length(parent) THEN ' ...' ELSE '' END END) AS digest FROM w""")
def parent_window(spark, sf):
    """The part of a long parent around the child that was found: 1200 characters, the child in the middle, with ellipses where cut."""
    parent, child = F.col("text"), F.col("child")
    rows = table(spark, sf, "documents").select("doc_id", "text", F.substring("text", 1500, 200).alias("child"))
    find = lambda n: F.when(F.length(child) >= n, F.position(F.substring(child, 1, n), parent)).otherwise(0)
    rows = rows.withColumn("at", F.coalesce(F.nullif(find(80), F.lit(0)), find(20)))
    half = F.floor((F.lit(TOP) - F.length(child)) / 2)
    rows = rows.withColumns({"from_": F.greatest(F.lit(1), F.col("at") - half).cast("int"), "to_": F.least(F.length(parent), F.col("at") + F.length(child) - 1 + half).cast("int")})
    n = F.col("to_") - F.col("from_") + 1
    cut = F.concat(F.when(F.col("from_") > 1, "... ").otherwise(""), F.substring(parent, F.col("from_"), n), F.when(F.col("to_") < F.length(parent), " ...").otherwise(""))
    cases = [(F.length(parent) <= TOP, F.length(parent), parent), (child == "", F.lit(TOP), F.substring(parent, 1, TOP)), (F.col("at") == 0, F.length(child), child), (F.lit(True), n, cut)]
    pick = lambda k: F.when(cases[0][0], cases[0][k]).when(cases[1][0], cases[1][k]).when(cases[2][0], cases[2][k]).otherwise(cases[3][k])
    return rows.select("doc_id", pick(1).cast("long").alias("chars"), F.md5(pick(2)).alias("digest"))


@query("""WITH s AS (SELECT o_custkey AS q, o_orderkey AS id, regexp_extract(o_orderpriority, '^(\\d)', 1)::INT AS part, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
g AS (SELECT q, count(*) AS n, list(part ORDER BY k) AS parts FROM s GROUP BY q) SELECT q, n, n >= 2 AND parts = list_sort(parts) AS sequential FROM g""")
def sequential_guard(spark, sf):
    """Retrieved parts that are already in ascending order keep it."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("q"), F.struct("o_orderdate", "o_orderkey", F.regexp_extract("o_orderpriority", "^(\\d)", 1).cast("int").alias("part")).alias("s"))
    parts = F.transform(F.sort_array(F.collect_list("s")), lambda x: x["part"])
    grouped = rows.groupBy("q").agg(F.count("*").alias("n"), parts.alias("parts"))
    return grouped.select("q", "n", ((F.col("n") >= 2) & (F.col("parts") == F.sort_array("parts"))).alias("sequential"))


@query("""WITH h AS (SELECT conv_id, turn, role, CASE WHEN role = 'assistant' AND NOT starts_with(text, '{') THEN '{"response":' || to_json(text) || '}' ELSE text END AS wrapped FROM conversations) SELECT conv_id, turn, starts_with(wrapped, '{"response":') AS wrapped, md5(wrapped) AS digest FROM h""")
def history_wrapping(spark, sf):
    """Replies in a history are wrapped as JSON unless they are JSON already."""
    wrap = (F.col("role") == "assistant") & ~F.col("text").startswith("{")
    doc = F.when(wrap, F.to_json(F.struct(F.col("text").alias("response")))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", doc.startswith('{"response":').alias("wrapped"), F.md5(doc).alias("digest"))


REPLIES = Literal("replies", "id long, raw string", [
    (1, '{"response": "Hi", "tags": ["a", "b"]}'), (2, 'Sure!\n```json\n{"response": "Fenced"}\n```'), (3, 'noise {"response": "Span", "caption": "c"} tail'), (4, 'broken "response": "Field", {'), (5, "plain words"), (6, None), (7, "{}"),
], given=("conversations", ["1000000 + conv_id * 1000 + turn", "text"]))
_FENCE = "regexp_extract(raw, '(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```', 1)"
_SPAN = "regexp_extract(raw, '(?s)(\\{.*\\})', 1)"


@query(f"""WITH {REPLIES.sql}, c AS (SELECT id, raw, CASE WHEN json_valid(raw) THEN raw WHEN {_FENCE} <> '' AND json_valid({_FENCE}) THEN {_FENCE} WHEN {_SPAN} <> '' AND json_valid({_SPAN}) THEN {_SPAN} END AS doc FROM replies)
SELECT id, CASE WHEN doc IS NOT NULL THEN coalesce(doc->>'$.response', '') WHEN regexp_matches(raw, '"response"\\s*:\\s*"') THEN regexp_extract(raw, '"response"\\s*:\\s*"([^"]*)"', 1) ELSE coalesce(raw, '') END AS response, doc IS NOT NULL AS parsed FROM c""")
def robust_json(spark, sf):
    """A reply's field from JSON as it is, in a code fence, or between braces; else by pattern, else the whole text."""
    raw = F.col("raw")
    valid = lambda c: F.from_json(c, "response string, tags array<string>, caption string").isNotNull() & F.try_parse_json(c).isNotNull()
    fence, span = F.regexp_extract(raw, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1), F.regexp_extract(raw, "(?s)(\\{.*\\})", 1)
    doc = F.when(F.try_parse_json(raw).isNotNull(), raw).when((fence != "") & valid(fence), fence).when((span != "") & valid(span), span)
    field = F.when(F.regexp_like(raw, F.lit('"response"\\s*:\\s*"')), F.regexp_extract(raw, '"response"\\s*:\\s*"([^"]*)"', 1)).otherwise(F.coalesce(raw, F.lit("")))
    rows = REPLIES.frame(spark, sf).withColumn("doc", doc)
    return rows.select("id", F.when(F.col("doc").isNotNull(), F.coalesce(F.get_json_object("doc", "$.response"), F.lit(""))).otherwise(field).alias("response"), F.col("doc").isNotNull().alias("parsed"))
