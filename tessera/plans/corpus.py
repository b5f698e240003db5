"""Text, markup, chunking, quality, incremental-load and graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import html_tree, text
from ..operators import core
from ..sources.tables import table
from ._catalog import Register

query = Register()


def _docs(spark, sf):
    return table(spark, sf, "documents")


@query("SELECT doc_id, (length(text) // 2)::BIGINT AS tokens, greatest(1, floor(length(text) / 1.3))::BIGINT AS chunk_tokens, len(regexp_extract_all(text, '[^ \\t\\n]+'))::BIGINT AS words FROM documents")
def token_estimates(spark, sf):
    t = F.col("text")
    return _docs(spark, sf).select("doc_id", text.token_estimate(t).alias("tokens"), text.chunk_token_estimate(t).alias("chunk_tokens"), text.word_count(t).alias("words"))


@query("SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(trim(lower(p_name)), '[^\\p{L}\\p{N}_ -]', '', 'g'), '[ -]+', '_', 'g'), ''), 'untitled') AS slug FROM part")
def slugify(spark, sf):
    return table(spark, sf, "part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS text_hash, md5(lower(text)) AS query_key FROM documents")
def text_hashes(spark, sf):
    return _docs(spark, sf).select("doc_id", text.text_hash(F.col("text")).alias("text_hash"), F.md5(F.lower("text")).alias("query_key"))


@query("""WITH n AS (SELECT doc_id, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(doc_id || '::' || source || '::0')) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', (strpos('0123456789abcdef', substr(h, 17, 1)))::BIGINT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS chunk_id FROM n""")
def uuid5_ids(spark, sf):
    name = F.concat(F.col("doc_id").cast("string"), F.lit("::"), "source", F.lit("::0"))
    return _docs(spark, sf).select("doc_id", text.uuid5(name).alias("chunk_id"))


@query("WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS n1, greatest(len(w) - 1, 0)::BIGINT AS n2, greatest(len(w) - 2, 0)::BIGINT AS n3, coalesce(md5(w[1] || ' ' || w[2]), '') AS first_pair FROM w")
def ngram_tokens(spark, sf):
    w = text.words(F.col("text"))
    n = lambda k: F.size(text.ngrams(F.col("w"), k)).cast("long")
    rows = _docs(spark, sf).select("doc_id", w.alias("w"))
    return rows.select("doc_id", n(1).alias("n1"), n(2).alias("n2"), n(3).alias("n3"), F.coalesce(F.md5(F.get(text.ngrams(F.col("w"), 2), F.lit(0))), F.lit("")).alias("first_pair"))


@query("""SELECT doc_id, k - 1 AS seq, md5(parts[k]) AS body FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \\n]+([\\p{Lu}\\p{N}])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS parts FROM documents))""")
def sentence_explode(spark, sf):
    return _docs(spark, sf).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("seq", "s")).select("doc_id", F.col("seq").cast("long").alias("seq"), F.md5("s").alias("body"))


@query("SELECT doc_id, k - 1 AS seq, length(parts[k]) AS chars FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)) WHERE trim(parts[k]) <> ''")
def line_explode(spark, sf):
    rows = _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line")).where(F.trim("line") != "")
    return rows.select("doc_id", F.col("seq").cast("long").alias("seq"), F.length("line").cast("long").alias("chars"))


@query()
def chunk_pack(spark, sf):
    """Greedy chunks of lines: flush before 512 tokens would be passed and once 256 are reached."""
    lines = F.split("text", "\n")
    sizes = F.transform(lines, lambda x: text.chunk_token_estimate(x))
    chunk = F.posexplode(core.greedy_pack(lines, sizes, 256, 512)).alias("chunk_index", "c")
    return _docs(spark, sf).select("doc_id", chunk).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("c.first").alias("first_line"), F.col("c.last").alias("last_line"), F.col("c.size").alias("tokens"))


@query("""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls, text FROM documents),
s AS (SELECT *, len(list_filter(ls, lambda x: regexp_matches(x, '^[\\p{L} ]{1,30}: '))) AS spoken, len(list_filter(ls, lambda x: regexp_matches(x, '^ *[*-] '))) / greatest(1, len(ls)) AS listed FROM l)
SELECT doc_id, CASE WHEN len(ls) = 0 THEN 'empty' WHEN contains(text, ' | ') THEN 'table' WHEN spoken >= 2 THEN 'dialogue' WHEN listed >= 0.5 THEN 'list' WHEN listed > 0 THEN 'mixed' ELSE 'prose' END AS content_type FROM s""")
def content_types(spark, sf):
    return _docs(spark, sf).select("doc_id", text.content_type(F.col("text")).alias("content_type"))


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, len(regexp_extract_all(html, '<a '))::BIGINT AS n_links FROM pages")
def html_title(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.html_title(F.col("html")).alias("title"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("n_links"))


_BARE = "html"
for _p in ("<script[^>]*>.*?</script>", "<style[^>]*>.*?</style>", "<!--.*?-->", "<[^>]*>"):
    _BARE = f"regexp_replace({_BARE}, '(?s){_p}', ' ', 'g')"


@query(f"SELECT page_id, md5(trim(regexp_replace({_BARE}, '[ \\t\\n\\r]+', ' ', 'g'))) AS body FROM pages")
def html_text(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(text.html_text(F.col("html"))).alias("body"))


@query("""WITH p AS (SELECT page_id, list_filter(regexp_extract_all(html, '(?s)<p>.*?</p>'), lambda x: length(regexp_replace(x, '<[^>]*>', '', 'g')) >= 40) AS ps FROM pages)
SELECT page_id, len(ps)::BIGINT AS paragraphs, len(list_filter(ps, lambda x: length(array_to_string(regexp_extract_all(x, '(?s)<a [^>]*>.*?</a>'), '')) <= 0.4 * length(x)))::BIGINT AS kept FROM p""")
def link_density(spark, sf):
    """Paragraphs of at least 40 characters, and those that aren't mostly links."""
    found = F.filter(F.regexp_extract_all("html", F.lit("(?s)<p>.*?</p>"), F.lit(0)), lambda x: F.length(F.regexp_replace(x, "<[^>]*>", "")) >= 40)
    dense = lambda x: F.length(F.array_join(F.regexp_extract_all(x, F.lit("(?s)<a [^>]*>.*?</a>"), F.lit(0)), "")) <= 0.4 * F.length(x)
    rows = table(spark, sf, "pages").select("page_id", found.alias("ps"))
    return rows.select("page_id", F.size("ps").cast("long").alias("paragraphs"), F.size(F.filter("ps", dense)).cast("long").alias("kept"))


# How much an address of each kind is trusted, and what is never opened.
DOMAINS, NEVER = {".org": 2.0, ".net": 1.0}, ["/ads/", "login."]
_SITE = "split_part(url, '/', 3)"


@query(f"""WITH t AS (SELECT page_id, url, {_SITE} AS site, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages), q AS (SELECT site, list_distinct(list_filter(regexp_extract_all(lower(arg_min(title, page_id)), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) >= 3)) AS asked FROM t GROUP BY site),
r AS (SELECT t.*, asked, row_number() OVER (PARTITION BY site ORDER BY page_id) AS pos FROM t JOIN q USING (site)),
s AS (SELECT site, page_id, round(len(list_filter(asked, lambda w: contains(lower(url || ' ' || title), w))) + {' + '.join(f"CASE WHEN contains(url, '{d}') THEN {b} ELSE 0.0 END" for d, b in DOMAINS.items())} - 0.1 * (pos - 1), 6)::DOUBLE AS score FROM r WHERE pos <= 8 AND NOT ({' OR '.join(f"contains(url, '{n}')" for n in NEVER)})),
k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, page_id) AS rank FROM s) SELECT site, page_id, score, rank FROM k WHERE rank <= 3""")
def url_rank(spark, sf):
    """The best three of the first eight results of every result list (here a site, asked for its first title): words shared with address and title, trust in the domain, position."""
    site = F.get(F.split("url", "/"), F.lit(2))
    rows = table(spark, sf, "pages").select("page_id", "url", site.alias("site"), text.html_title(F.col("html")).alias("title"))
    asked = F.array_distinct(F.filter(text.words(F.col("q"), 1), lambda w: F.length(w) >= 3))
    lists = rows.groupBy("site").agg(F.min_by("title", "page_id").alias("q")).select("site", asked.alias("asked"))
    first = core.top_k(rows, ["site"], ["page_id"], 8, "pos").join(lists, "site")
    said = F.lower(F.concat("url", F.lit(" "), "title"))
    boost = sum((F.when(F.contains("url", F.lit(d)), b).otherwise(0.0) for d, b in DOMAINS.items()), F.lit(0.0))
    score = F.size(F.filter("asked", lambda w: F.contains(said, w))) + boost - 0.1 * (F.col("pos") - 1)
    good = first.where(~F.greatest(*[F.contains("url", F.lit(n)) for n in NEVER])).select("site", "page_id", F.round(score, 6).alias("score"))
    return core.top_k(good, ["site"], [F.desc("score"), "page_id"], 3)


@query("""SELECT doc_id, CASE WHEN words < 5 OR length(text) < 20 OR (words < 45 AND regexp_matches(lower(text), 'license|copyright|cookie')) THEN 'drop' WHEN q BETWEEN 0.5 AND 0.7 THEN 'rewrite' ELSE 'keep' END AS gate, q AS quality
FROM (SELECT *, CASE WHEN words >= 30 AND NOT starts_with(text, '{') THEN 0.95 WHEN words >= 15 THEN 0.85 ELSE 0.7 END::DOUBLE AS q FROM (SELECT *, len(regexp_extract_all(text, '[^ \\t\\n]+')) AS words FROM documents))""")
def chunk_gate(spark, sf):
    """What becomes of a chunk; the least number of words is a setting of the gate, 5 here, so that short chunks of quality 0.7 reach the rewrite."""
    t, n = F.col("text"), F.col("words")
    rows = _docs(spark, sf).withColumn("words", text.word_count(t))
    rows = rows.withColumn("quality", F.when((n >= 30) & ~t.startswith("{"), 0.95).when(n >= 15, 0.85).otherwise(0.7))
    drop = (n < 5) | (F.length(t) < 20) | ((n < 45) & F.regexp_like(F.lower(t), F.lit("license|copyright|cookie")))
    return rows.select("doc_id", F.when(drop, "drop").when(F.col("quality").between(0.5, 0.7), "rewrite").otherwise("keep").alias("gate"), "quality")


@query("SELECT doc_id, (length(text) < 10)::INT + (length(text) > 4000)::INT * 2 + (lang IS NULL)::INT * 4 AS errors FROM documents WHERE length(text) < 10 OR length(text) > 4000 OR lang IS NULL")
def chunk_validation(spark, sf):
    """Documents with errors as a bit set: too short, too long, no language."""
    tests = [F.length("text") < 10, F.length("text") > 4000, F.col("lang").isNull()]
    errors = sum((c.cast("int") * 2**i for i, c in enumerate(tests)), F.lit(0))
    return _docs(spark, sf).select("doc_id", errors.alias("errors")).where("errors > 0")


@query("SELECT count(*) AS docs, count(DISTINCT source) AS sources, round(avg(length(text)), 1) AS avg_chars, round(100.0 * avg((length(text) > 2000)::INT), 2)::DOUBLE AS pct_long, sum((lang = 'en')::INT)::BIGINT AS n_en FROM documents")
def corpus_stats(spark, sf):
    long = F.avg((F.length("text") > 2000).cast("int"))
    return _docs(spark, sf).agg(F.count("*").alias("docs"), F.countDistinct("source").alias("sources"), F.round(F.avg(F.length("text")), 1).alias("avg_chars"), F.round(100.0 * long, 2).alias("pct_long"), F.sum((F.col("lang") == "en").cast("long")).alias("n_en"))


@query("SELECT lang, source, count(*) AS n, sum((n_chars >= 500)::INT)::BIGINT AS approved, sum((n_chars < 500)::INT)::BIGINT AS excluded FROM documents GROUP BY ROLLUP (lang, source)")
def category_breakdown(spark, sf):
    ok = F.col("n_chars") >= 500
    return _docs(spark, sf).rollup("lang", "source").agg(F.count("*").alias("n"), F.sum(ok.cast("long")).alias("approved"), F.sum((~ok).cast("long")).alias("excluded"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) > 1 THEN 0.6 ELSE 1.0 END::DOUBLE AS score FROM documents")
def hash_dedup(spark, sf):
    """Later copies of a text are penalised; copies are counted through an aggregate, so a popular text isn't sorted in one task."""
    docs = _docs(spark, sf).select("doc_id", F.md5("text").alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    return docs.join(first, "h").select("doc_id", F.when(F.col("doc_id") > F.col("first_id"), 0.6).otherwise(1.0).alias("score"))


@query("""SELECT d.doc_id, round(0.35 * (CASE WHEN n_chars < 100 THEN 0.5 ELSE 1.0 END) + 0.40 * coalesce(quality, 0.5) + 0.25 * (1 - coalesce(toxic, 0)), 6)::DOUBLE AS score,
CASE WHEN toxic = 1 THEN 'QUARANTINED' WHEN 0.35 * (CASE WHEN n_chars < 100 THEN 0.5 ELSE 1.0 END) + 0.40 * coalesce(quality, 0.5) + 0.25 * (1 - coalesce(toxic, 0)) >= 0.85 THEN 'APPROVED' ELSE 'WARNING' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def quality_status(spark, sf):
    rows = _docs(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left")
    score = 0.35 * F.when(F.col("n_chars") < 100, 0.5).otherwise(1.0) + 0.40 * F.coalesce("quality", F.lit(0.5)) + 0.25 * (1 - F.coalesce("toxic", F.lit(0)))
    return rows.select("doc_id", F.round(score, 6).alias("score"), F.when(F.col("toxic") == 1, "QUARANTINED").when(score >= 0.85, "APPROVED").otherwise("WARNING").alias("status"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphans_anti(spark, sf):
    active = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return core.orphans(table(spark, sf, "customer").select("c_custkey"), active, ["c_custkey"])


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def new_keys_anti(spark, sf):
    return _docs(spark, sf).select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT DISTINCT a.doc_id, EXISTS (SELECT 1 FROM documents b WHERE md5(b.text) = md5(a.text) AND b.doc_id < a.doc_id) AS skip_embedding FROM documents a")
def unchanged_semi(spark, sf):
    """Whether a text's hash was seen at a smaller id."""
    docs = _docs(spark, sf).select("doc_id", F.md5("text").alias("h"))
    seen = docs.groupBy("h").agg(F.min("doc_id").alias("low"))
    return docs.join(seen, "h").select("doc_id", (F.col("low") < F.col("doc_id")).alias("skip_embedding")).distinct()


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
def upsert_latest(spark, sf):
    return core.latest_wins(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, max(o_totalprice) FROM orders GROUP BY o_custkey")
def key_merge(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return core.key_merge(old, new, ["c_custkey"])


@query("SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY user_id")
def first_last_seen(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("n"))


@query("""WITH l AS (SELECT user_id AS k, max(ts) AS atime, sum(length(props))::BIGINT AS size FROM events GROUP BY user_id), t AS (SELECT *, sum(size) OVER () AS used, sum(size) OVER (ORDER BY atime, k) - size AS ahead FROM l)
SELECT k FROM t WHERE ahead < used - 0.7 * used""")
def lru_evict(spark, sf):
    """Oldest entries first until 70 % of what is used remains.

    The order is cut into ranges of days; sums of whole days are few, and only within a day entries are ordered one by one.
    """
    rows = table(spark, sf, "events").groupBy(F.col("user_id").alias("k")).agg(F.max("ts").alias("atime"), F.sum(F.length("props").cast("long")).alias("size")).withColumn("day", F.date_trunc("day", "atime"))
    days = rows.groupBy("day").agg(F.sum("size").alias("total"))
    before = days.select("day", (F.sum("total").over(Window.orderBy("day")) - F.col("total")).alias("before"), F.sum("total").over(Window.partitionBy()).alias("used"))
    within = F.sum("size").over(Window.partitionBy("day").orderBy("atime", "k")) - F.col("size")
    return rows.withColumn("within", within).join(before, "day").where("before + within < used - 0.7 * used").select("k")


@query("SELECT doc_id, lang, approved FROM (SELECT doc_id, lang, n_chars >= 300 AS approved, row_number() OVER (PARTITION BY md5(text) ORDER BY lang, doc_id) AS k FROM documents) WHERE k = 1")
def scan_and_select(spark, sf):
    """The first listing of each page wins; every survivor gets a verdict."""
    rows = _docs(spark, sf).select("doc_id", "lang", (F.col("n_chars") >= 300).alias("approved"), F.md5("text").alias("h"))
    return core.latest_wins(rows, ["h"], ["lang", "doc_id"]).select("doc_id", "lang", "approved")


@query("SELECT s_suppkey, n_name AS canonical, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def alias_resolve(spark, sf):
    names = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("canonical"), F.col("r_name").alias("region"))


@query("SELECT a.n_nationkey AS entity, b.n_nationkey AS related FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey <> b.n_nationkey UNION SELECT n_nationkey, 1000 + n_regionkey FROM nation")
def one_hop_expand(spark, sf):
    """Siblings and the parent of every entity."""
    n = table(spark, sf, "nation")
    other = n.select(F.col("n_nationkey").alias("related"), "n_regionkey")
    siblings = n.join(other, "n_regionkey").where("n_nationkey <> related").select(F.col("n_nationkey").alias("entity"), "related")
    return siblings.union(n.select("n_nationkey", F.lit(1000) + F.col("n_regionkey"))).distinct()


@query("""WITH e AS (SELECT l_partkey AS source, l_suppkey AS target, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT source AS entity, * FROM e UNION ALL SELECT target, * FROM e WHERE source <> target""")
def relationships_of(spark, sf):
    """Each entity's edges on either side; edges are counted first, so a popular entity isn't gathered in one task."""
    edges = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")).agg(F.count("*").alias("n"))
    entity = F.explode(F.array_distinct(F.array("source", "target"))).alias("entity")
    return edges.select(entity, "source", "target", "n").where("entity is not null")


@query("SELECT l_partkey, min(l_suppkey) AS first_supplier, count(DISTINCT l_suppkey) AS n_related, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') AS related FROM lineitem GROUP BY l_partkey")
def entity_merge(spark, sf):
    """One row per canonical entity with the union of its related ones."""
    related = F.sort_array(F.collect_set("l_suppkey"))
    rows = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("first_supplier"), related.alias("r"))
    return rows.select("l_partkey", "first_supplier", F.size("r").cast("long").alias("n_related"), F.array_join("r", ",").alias("related"))


@query("SELECT DISTINCT doc_id, p.word FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'))) AS w FROM documents) d JOIN (SELECT DISTINCT lower(regexp_extract(text, '[\\p{L}]+')) AS word FROM benchmark) p ON d.w = p.word")
def mention_join(spark, sf):
    """Documents joined to the dictionary words they mention."""
    words = table(spark, sf, "benchmark").select(F.lower(F.regexp_extract("text", "[\\p{L}]+", 0)).alias("word")).distinct()
    return core.mention_join(_docs(spark, sf).select("doc_id", "text"), "text", words, "word").select("doc_id", "word").distinct()


@query("SELECT doc_id, array_to_string(list_sort(list_distinct([x FOR x IN ['a', 'b', lang, source] IF x <> 'b'])), ',') AS others, array_to_string(list_sort(list_distinct([lang, source, 'a'])), ',') AS tags FROM documents")
def tag_union(spark, sf):
    """Ordered set operations on tag arrays."""
    tags = F.array_union(F.array("lang", "source"), F.array(F.lit("a")))
    others = F.array_except(F.array(F.lit("a"), F.lit("b"), F.col("lang"), F.col("source")), F.array(F.lit("b")))
    return _docs(spark, sf).select("doc_id", F.array_join(F.sort_array(others), ",").alias("others"), F.array_join(F.sort_array(tags), ",").alias("tags"))


_HIDDEN = "|".join(sorted(html_tree.HIDDEN))
#: Pages without comments and what is no content, and a text with its markup as blanks and its entities read.
_SHOWN = "shown AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)" + "|".join(f"<{t}(?: [^>]*)?>.*?</{t}>" for t in sorted(html_tree.HIDDEN)) + "', ' ', 'g') AS h FROM pages)"


def _bare(x: str) -> str:
    x = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    for name, c in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        x = f"replace({x}, '&{name};', '{c}')"
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query(f"""WITH {_SHOWN}, heads AS (SELECT page_id, 0 AS k, {_bare("regexp_extract(h, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS t FROM shown),
paras AS (SELECT page_id, i AS k, {_bare("p")} AS t, p FROM (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT page_id, [regexp_extract(x, '(?s)^(.*?)(?:</p>|</?(?:div|ul|ol|table|h[1-6]|article|section|li|body)[ >]|$)', 1) FOR x IN regexp_split_to_array(h, '<p(?: [^>]*)?>')[2:]] AS ps FROM shown))),
linked AS (SELECT *, coalesce(list_sum([length({_bare("x")}) FOR x IN regexp_extract_all(p, '(?s)<a[^>]*>(.*?)</a>', 1)]), 0) AS n FROM paras),
parts AS (SELECT page_id, k, t FROM heads WHERE length(t) >= 15 UNION ALL SELECT page_id, k, t FROM linked WHERE length(t) >= 40 AND n <= 0.4 * length(t))
SELECT page_id, count(*) AS n_parts, md5(string_agg(t, chr(10) || chr(10) ORDER BY k)) AS body FROM parts GROUP BY page_id""")
def page_main_text(spark, sf):
    """A page's own text by its tree: the heading and the paragraphs that aren't mostly links."""
    found = html_tree.main_text(html_tree.page_nodes(table(spark, sf, "pages")))
    return found.select("page_id", "n_parts", F.md5("body").alias("body"))


@query(f"""WITH {_SHOWN}, cut AS (SELECT page_id, regexp_extract(h, '(?s)^(.*?)<h1', 1) AS lead, {_bare("regexp_extract(h, '(?s)<h1[^>]*>(.*?)</h1>', 1)")} AS title, regexp_extract(h, '(?s)</h1>(.*)$', 1) AS rest FROM shown),
s AS (SELECT page_id, 0 AS level, '' AS title, {_bare("lead")} AS t FROM cut UNION ALL SELECT page_id, 1, title, {_bare("rest")} FROM cut)
SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY level) - 1)::INT AS section, level, title AS path, md5(t) AS body FROM s WHERE level > 0 OR t <> ''""")
def page_outline(spark, sf):
    """Sections of every page with the headings above them."""
    found = html_tree.page_sections(table(spark, sf, "pages"))
    return found.select("page_id", "section", "level", "path", F.md5("text").alias("body"))
