"""Page classification, quality gates, categories, chunk metadata and reports on the wiki pages and on the driver's documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as texts
from ..operators import core
from ..sources.tables import table
from . import markup
from ._catalog import Literal, Register, case_sql, chain_sql, quoted
from .markup import MD, PAGES, SECTIONS

query = Register()

# Categories, infobox names, title patterns and section titles by kind of page, each with its confidence.
CATEGORY_RULES = [
    (["resonators", "playable characters"], "CHARACTER", 0.95), (["5-star resonators", "4-star resonators"], "CHARACTER", 0.95), (["characters"], "CHARACTER", 0.85),
    (["broadblades", "swords", "pistols", "rectifiers", "gauntlets"], "WEAPON", 0.95), (["weapons"], "WEAPON", 0.90), (["5-star weapons", "4-star weapons", "3-star weapons"], "WEAPON", 0.95),
    (["echoes"], "ECHO", 0.90), (["echo", "sonata effects"], "ECHO", 0.85), (["bosses", "weekly bosses", "overworld bosses"], "BOSS", 0.90), (["enemies"], "BOSS", 0.70),
    (["archon quests", "companion quests"], "QUEST", 0.95), (["world quests", "side quests", "quests"], "QUEST", 0.90), (["materials", "consumables", "resources"], "ITEM", 0.90), (["items"], "ITEM", 0.85),
    (["regions", "sub-regions", "areas"], "REGION", 0.90), (["lahai-roi", "jinzhou", "rinascita", "new federation", "black shores"], "REGION", 0.80), (["factions", "organizations"], "FACTION", 0.90),
    (["npcs", "non-playable characters"], "NPC", 0.90), (["game mechanics", "combat mechanics", "systems"], "MECHANIC", 0.90), (["tutorials", "guides"], "TUTORIAL", 0.85),
    (["timeline", "lore timeline"], "TIMELINE", 0.90), (["dialogue", "voice lines"], "DIALOGUE", 0.85), (["navigation templates", "disambiguation"], "META_NAVIGATION", 0.90),
]
INFOBOX_RULES = [
    ("character infobox", "CHARACTER", 0.95), ("character", "CHARACTER", 0.90), ("weapon infobox", "WEAPON", 0.95), ("weapon", "WEAPON", 0.90), ("echo infobox", "ECHO", 0.95), ("echo", "ECHO", 0.90), ("boss infobox", "BOSS", 0.95),
    ("enemy infobox", "BOSS", 0.90), ("quest infobox", "QUEST", 0.90), ("item infobox", "ITEM", 0.90), ("npc infobox", "NPC", 0.90), ("region infobox", "REGION", 0.90), ("faction infobox", "FACTION", 0.90),
]
TITLE_RULES = [
    ("(?i)^.+/(?:Backstory|Forte Examination Report|Voice Lines|Trivia|Gallery|Stats|Ascension)$", "CHARACTER", 0.90), ("(?i)^(?:Chapter|Act|Part)\\s+\\d+", "QUEST", 0.75), ("(?i)voice[\\s_-]?lines?$", "DIALOGUE", 0.80),
    ("(?i)\\(disambiguation\\)$", "META_NAVIGATION", 0.95), ("(?i)^list of\\s", "META_NAVIGATION", 0.70), ("(?i)^category:", "META_NAVIGATION", 0.95),
]
SECTION_RULES = [
    ("resonance skill", "CHARACTER", 0.65), ("forte circuit", "CHARACTER", 0.70), ("resonance chain", "CHARACTER", 0.70), ("resonance liberation", "CHARACTER", 0.65), ("ascension materials", "WEAPON", 0.60), ("weapon passive", "WEAPON", 0.65),
    ("sonata effect", "ECHO", 0.65), ("attack patterns", "BOSS", 0.60), ("quest objectives", "QUEST", 0.65), ("quest steps", "QUEST", 0.60), ("dialogue", "QUEST", 0.50), ("departments", "FACTION", 0.55), ("members", "FACTION", 0.45),
]

PROFILE = Literal("profile", "page_id long, title string, categories array<string>, infobox string, sections array<string>", [
    (1, "Mira Vale", ["Playable Characters", "Weapons"], "Character Infobox", ["Story"]), (2, "Tide Bow", [], "Weapon Infobox", []), (3, "Blade", None, "Weapon Stats Infobox", []), (4, "Mira/Backstory", [], None, []),
    (5, "Chapter 3", [], "", []), (6, "List of ports", ["Harbors"], None, []), (7, "Guild", [], None, ["Members", "Departments", "Dialogue"]), (8, "Foo", [], None, ["History"]), (9, "The Gate", ["World Quests"], None, []), (10, "Vale (disambiguation)", None, None, None),
], given=("documents", ["1000000 + doc_id", "source", "[lang]", "lang", "[source]"]))


def classified(rows: DataFrame) -> DataFrame:
    """``kind, confidence, source, is_skip`` from categories, then the infobox, the title and the section titles; the first that fits wins."""
    cats = F.transform(F.coalesce("categories", F.array().cast("array<string>")), lambda c: F.trim(F.lower(c)))
    box, title = F.trim(F.lower(F.coalesce("infobox", F.lit("")))), F.trim(F.coalesce("title", F.lit("")))
    verdict = lambda kind, c, source: F.struct(F.lit(kind).alias("kind"), F.lit(c).alias("confidence"), F.lit(source).alias("source"))
    none = F.lit(None).cast("struct<kind:string,confidence:double,source:string>")

    def first(rules) -> Column:
        out = none
        for test, value in reversed(rules):
            out = F.when(test, value).otherwise(out)
        return out

    by_category = first([(F.arrays_overlap(cats, F.array(*map(F.lit, names))), verdict(kind, c, "category")) for names, kind, c in CATEGORY_RULES])
    exact = first([(box == name, verdict(kind, c, "infobox")) for name, kind, c in INFOBOX_RULES])
    partial = first([(F.contains(box, F.lit(name)), verdict(kind, round(c * 0.9, 4), "infobox")) for name, kind, c in INFOBOX_RULES])
    by_title = first([(F.regexp_like(title, F.lit(p)), verdict(kind, c, "title")) for p, kind, c in TITLE_RULES])
    has = lambda part: F.exists(F.coalesce("sections", F.array().cast("array<string>")), lambda s: F.contains(F.lower(s), F.lit(part)))
    # of equally sure section titles the first in the list wins
    by_section = first([(has(part), verdict(kind, c, "heuristic")) for part, kind, c in sorted(SECTION_RULES, key=lambda r: -r[2])])
    out = F.coalesce(by_category, exact, partial, by_title, by_section, verdict("GENERIC", 0.3, "fallback"))
    rows = rows.withColumn("v_", out)
    skip = F.col("v_.source").eqNullSafe("category") & F.col("v_.kind").isin("QUEST", "DIALOGUE") | F.col("v_.source").eqNullSafe("title") & (F.col("v_.kind") == "META_NAVIGATION")
    return rows.select("*", "v_.*", skip.alias("is_skip")).drop("v_")


def _classes_sql() -> str:
    s = lambda kind, c, source: f"{{'kind': '{kind}', 'confidence': {c}::DOUBLE, 'source': '{source}'}}"
    cats = "list_transform(coalesce(categories, []), lambda c: trim(lower(c)))"
    box = "trim(lower(coalesce(infobox, '')))"
    parts = [
        case_sql([(f"list_has_any({cats}, {quoted(n)})", s(k, c, "category")) for n, k, c in CATEGORY_RULES]),
        case_sql([(f"{box} = {quoted(n)}", s(k, c, "infobox")) for n, k, c in INFOBOX_RULES]),
        case_sql([(f"contains({box}, {quoted(n)})", s(k, round(c * 0.9, 4), "infobox")) for n, k, c in INFOBOX_RULES]),
        case_sql([(f"regexp_matches(trim(coalesce(title, '')), {quoted(p)})", s(k, c, "title")) for p, k, c in TITLE_RULES]),
        case_sql([(f"len(list_filter(coalesce(sections, []), lambda x: contains(lower(x), {quoted(p)}))) > 0", s(k, c, "heuristic")) for p, k, c in sorted(SECTION_RULES, key=lambda r: -r[2])]),
    ]
    return f"""WITH {PROFILE.sql}, v AS (SELECT page_id, coalesce({', '.join(parts)}, {s('GENERIC', 0.3, 'fallback')}) AS v FROM profile)
SELECT page_id, v.kind AS kind, v.confidence AS confidence, v.source AS source, (v.source = 'category' AND v.kind IN ('QUEST', 'DIALOGUE')) OR (v.source = 'title' AND v.kind = 'META_NAVIGATION') AS is_skip FROM v"""


@query(_classes_sql())
def page_types(spark, sf):
    return classified(PROFILE.frame(spark, sf)).select("page_id", "kind", "confidence", "source", "is_skip")


# Deductions of the gates.
SKIP, EMPTY, FAILED_TABLE, NAVIGATION, NO_CONTENT, NO_PRIMARY, NO_NAME = 0.05, 0.1, 0.15, 0.5, 1.0, 0.3, 0.2

_FAILED = "(length(wikitext) - length(replace(wikitext, '{|', ''))) // 2 - len(regexp_extract_all(wikitext, '(?s)\\{\\|.*?\\n\\|\\}'))"


@query(f"""WITH {SECTIONS}, l AS (SELECT *, lag(level) OVER (PARTITION BY page_id ORDER BY section) AS above FROM sections WHERE content <> '' OR level > 0),
g AS (SELECT page_id, count(*) AS n, sum((above > 0 AND level > above + 2)::INT) AS skips, sum((content = '')::INT) AS empty FROM l GROUP BY page_id)
SELECT page_id, CASE WHEN coalesce(n, 0) = 0 THEN 0.0 ELSE round(greatest(0.0, 1.0 - {SKIP} * coalesce(skips, 0) - {EMPTY} * coalesce(empty, 0) - {FAILED_TABLE} * ({_FAILED})), 2) END::DOUBLE AS score, coalesce(n, 0)::BIGINT AS sections FROM pages_ LEFT JOIN g USING (page_id)""")
def gate_structure(spark, sf):
    """1 less what skipped heading levels, empty sections and tables that can't be parsed cost; 0 without sections."""
    rows = markup._sections(spark, sf).where("content <> '' or level > 0").withColumn("above", F.lag("level").over(Window.partitionBy("page_id").orderBy("section")))
    skip = F.coalesce((F.col("above") > 0) & (F.col("level") > F.col("above") + 2), F.lit(False))
    found = rows.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(skip.cast("int")).alias("skips"), F.sum((F.col("content") == "").cast("int")).alias("empty"))
    failed = F.regexp_count("wikitext", F.lit("\\{\\|")) - F.size(F.regexp_extract_all("wikitext", F.lit("(?s)\\{\\|.*?\\n\\|\\}"), F.lit(0)))
    score = F.greatest(F.lit(0.0), 1.0 - SKIP * F.col("skips") - EMPTY * F.col("empty") - FAILED_TABLE * failed)
    rows = PAGES.frame(spark, sf).join(found, "page_id", "left")
    return rows.select("page_id", F.when(F.coalesce("n", F.lit(0)) == 0, 0.0).otherwise(F.round(score, 2)).alias("score"), F.coalesce("n", F.lit(0)).alias("sections"))


_NAV = "(contains(lower(title), 'disambiguation') OR starts_with(lower(title), 'list of '))"
_ENTITIES = f"len(list_filter({markup._ENT}, lambda e: lower(e) = lower(title)))"


@query(f"""WITH {MD} SELECT page_id, round(greatest(0.0, 1.0 - {NAVIGATION} * {_NAV}::INT - {NO_CONTENT} * (md = '')::INT), 2)::DOUBLE AS content_score, md <> '' AND NOT {_NAV} AS content_ok,
round(greatest(0.0, 1.0 - {NO_PRIMARY} * (len({markup._ENT}) = 0)::INT - {NO_NAME} * (contains(title, '/'))::INT), 2)::DOUBLE AS entity_score FROM md""")
def gate_content_entities(spark, sf):
    """Content gate: navigation pages and empty ones; entity gate: pages without entities, and subpages, which have no name of their own."""
    nav = F.contains(F.lower("title"), F.lit("disambiguation")) | F.lower("title").startswith("list of ")
    names = F.concat(F.regexp_extract_all("wikitext", F.lit("\\[\\[([^\\]|]+)"), F.lit(1)), F.regexp_extract_all("wikitext", F.lit(f"(?i)\\{{\\{{(?:{markup.NAMED})\\|([^}}|]+)"), F.lit(1)))
    content = 1.0 - NAVIGATION * nav.cast("int") - NO_CONTENT * (F.col("md") == "").cast("int")
    entity = 1.0 - NO_PRIMARY * (F.size(names) == 0).cast("int") - NO_NAME * F.contains("title", F.lit("/")).cast("int")
    least = lambda x: F.round(F.greatest(F.lit(0.0), x), 2)
    return markup._md(spark, sf).select("page_id", least(content).alias("content_score"), ((F.col("md") != "") & ~nav).alias("content_ok"), least(entity).alias("entity_score"))


_G4 = """g AS (SELECT doc_id, source, lang, greatest(1, floor(length(text) / 1.3)) AS tokens, min(doc_id) OVER (PARTITION BY md5(text)) < doc_id AS again FROM documents),
s AS (SELECT *, round(1.0 - CASE WHEN tokens < 20 THEN 0.1 WHEN tokens > 1024 THEN 0.3 ELSE 0.0 END - CASE WHEN again THEN 0.4 ELSE 0.0 END, 2)::DOUBLE AS score FROM g)"""


def _chunk_scores(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", texts.chunk_token_estimate(F.col("text")).alias("tokens"), F.md5("text").alias("h"))
    first = docs.groupBy("h").agg(F.min("doc_id").alias("first_id"))
    rows = docs.join(first, "h").withColumn("again", F.col("first_id") < F.col("doc_id"))
    size = F.when(F.col("tokens") < 20, 0.1).when(F.col("tokens") > 1024, 0.3).otherwise(0.0)
    return rows.withColumn("score", F.round(1.0 - size - F.when(F.col("again"), 0.4).otherwise(0.0), 2))


@query(f"WITH {_G4} SELECT doc_id, score, score >= 0.5 AS passed, CASE WHEN score >= 0.85 THEN 'APPROVED' WHEN score >= 0.6 THEN 'WARNING' ELSE 'QUARANTINED' END AS status FROM s")
def gate_chunks(spark, sf):
    """Chunk gate with its report: too small or large, or a text that a smaller id has."""
    status = F.when(F.col("score") >= 0.85, "APPROVED").when(F.col("score") >= 0.6, "WARNING").otherwise("QUARANTINED")
    return _chunk_scores(spark, sf).select("doc_id", "score", (F.col("score") >= 0.5).alias("passed"), status.alias("status"))


@query(f"WITH {_G4} SELECT sum((score >= 0.85)::INT)::BIGINT AS approved, sum((score >= 0.6 AND score < 0.85)::INT)::BIGINT AS warnings, sum((score < 0.6)::INT)::BIGINT AS quarantined, count(*) AS total FROM s")
def quality_counters(spark, sf):
    n = lambda c: F.sum(c.cast("long"))
    s = F.col("score")
    return _chunk_scores(spark, sf).agg(n(s >= 0.85).alias("approved"), n((s >= 0.6) & (s < 0.85)).alias("warnings"), n(s < 0.6).alias("quarantined"), F.count("*").alias("total"))


@query(f"WITH {_G4} SELECT source, count(*) AS chunks, max(doc_id) AS last_chunk, max_by(lang, doc_id) AS last_lang FROM s GROUP BY source")
def chunks_per_page(spark, sf):
    """How many chunks each page has, with its last one."""
    return _chunk_scores(spark, sf).groupBy("source").agg(F.count("*").alias("chunks"), F.max("doc_id").alias("last_chunk"), F.max_by("lang", "doc_id").alias("last_lang"))


# Categories without meaning for readers.
JUNK, JUNK_WORDS = "(?i)^(pages|articles) (with|using)|stubs?$|templates?$", ["hidden categories", "maintenance"]
CATS = Literal("cats", "page_id long, names array<string>", [(1, ["Ports", "ports", "Pages with maps", "Hidden Categories"]), (2, ["Bow stub", "Ports", ""]), (3, None), (4, ["Ports", "Regions", "Ports"])], given=("documents", ["1000000 + doc_id", "[lang, source, lang]"]))
_JUNK = f"(c = '' OR lower(trim(c)) IN ('{JUNK_WORDS[0]}', '{JUNK_WORDS[1]}') OR regexp_matches(c, '{JUNK}'))"


def junk(c: Column) -> Column:
    return (c == "") | F.lower(F.trim(c)).isin(JUNK_WORDS) | F.regexp_like(c, F.lit(JUNK))


@query(f"""WITH {CATS.sql}, e AS (SELECT page_id, k, names[k] AS c FROM (SELECT *, unnest(range(1, len(names) + 1)) AS k FROM cats)), d AS (SELECT page_id, c, min(k) AS k FROM e WHERE NOT {_JUNK} GROUP BY ALL)
SELECT page_id, coalesce(string_agg(c, ';' ORDER BY k), '') AS kept FROM cats LEFT JOIN d USING (page_id) GROUP BY page_id""")
def categories_clean(spark, sf):
    """Distinct categories in order without the junk."""
    return CATS.frame(spark, sf).select("page_id", F.coalesce(F.array_join(F.array_distinct(F.filter("names", lambda c: ~junk(c))), ";"), F.lit("")).alias("kept"))


@query(f"WITH {CATS.sql}, e AS (SELECT unnest(names) AS c FROM cats) SELECT c AS category, count(*) AS n, {_JUNK} AS junk FROM e GROUP BY ALL")
def category_frequency(spark, sf):
    rows = CATS.frame(spark, sf).select(F.explode("names").alias("c"))
    return rows.groupBy(F.col("c").alias("category")).agg(F.count("*").alias("n")).withColumn("junk", junk(F.col("category")))


TAXONOMY = Literal("taxonomy", "field string, priority int, name string, alias string", [
    ("element", 1, "Tide", "tide"), ("element", 2, "Ember", "ember"), ("weapon", 1, "Bow", "bow"), ("weapon", 2, "Sword", "sword"), ("region", 1, "Salt Harbor", "harbor"), ("region", 2, "Coast", "coastal"),
])


@query(f"""WITH {TAXONOMY.sql}, {PAGES.sql}, h AS (SELECT page_id, field, arg_min(name, priority) AS name FROM pages_, taxonomy WHERE contains(lower(array_to_string(coalesce(categories, []), ' ')) || ' ' || lower(title), alias) GROUP BY ALL)
SELECT page_id, max(name) FILTER (field = 'element') AS element, max(name) FILTER (field = 'weapon') AS weapon, max(name) FILTER (field = 'region') AS region FROM pages_ LEFT JOIN h USING (page_id) GROUP BY page_id""")
def taxonomy_fallback(spark, sf):
    """Missing metadata from categories and title: of each field the first taxonomy entry with an alias among them."""
    by: dict = {}
    for field, priority, name, alias in sorted(TAXONOMY.rows, key=lambda r: -r[1]):
        said = F.contains(F.concat(F.lower(F.array_join(F.coalesce("categories", F.array().cast("array<string>")), " ")), F.lit(" "), F.lower("title")), F.lit(alias))
        by[field] = F.when(said, name).otherwise(by.get(field, F.lit(None).cast("string")))
    return PAGES.frame(spark, sf).select("page_id", *[by[f].alias(f) for f in ("element", "weapon", "region")])


@query("""WITH t AS (SELECT doc_id, source, lang, len(regexp_extract_all(text, '[^ \\t\\n]+')) AS words, starts_with(text, '{') AS json FROM documents)
SELECT doc_id, '[' || upper(lang) || ': ' || source || ' | Section: ' || (doc_id % 5) || ']' AS prefix, CASE WHEN words >= 30 AND NOT json THEN 0.95 WHEN words >= 15 THEN 0.85 ELSE 0.7 END::DOUBLE AS quality,
CASE WHEN lang = 'en' THEN 'character' WHEN lang IN ('fr', 'de') THEN 'story' ELSE 'world' END AS collection FROM t""")
def chunk_metadata(spark, sf):
    """Page metadata carried to each chunk: context prefix, quality by word count, and the collection its kind goes to."""
    words = texts.word_count(F.col("text"))
    prefix = F.concat(F.lit("["), F.upper("lang"), F.lit(": "), "source", F.lit(" | Section: "), (F.col("doc_id") % 5).cast("string"), F.lit("]"))
    quality = F.when((words >= 30) & ~F.col("text").startswith("{"), 0.95).when(words >= 15, 0.85).otherwise(0.7)
    return table(spark, sf, "documents").select("doc_id", prefix.alias("prefix"), quality.alias("quality"), F.when(F.col("lang") == "en", "character").when(F.col("lang").isin("fr", "de"), "story").otherwise("world").alias("collection"))


@query("""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS site, CASE WHEN contains(url, '/en/') THEN 'WORLD' WHEN contains(url, '/de/') THEN 'STORY' WHEN contains(url, '/fr/') THEN 'CHARACTER' ELSE 'GENERIC' END AS kind,
split_part(regexp_replace(url, '^[a-z]+://', ''), '/', 2) AS first_dir FROM pages""")
def path_metadata(spark, sf):
    """Kind of page from the folders in its path."""
    kind = F.when(F.contains("url", F.lit("/en/")), "WORLD").when(F.contains("url", F.lit("/de/")), "STORY").when(F.contains("url", F.lit("/fr/")), "CHARACTER").otherwise("GENERIC")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("site"), kind.alias("kind"), F.coalesce(F.try_element_at(F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/"), F.lit(2)), F.lit("")).alias("first_dir"))


@query(f"""WITH {PAGES.sql} SELECT page_id, CASE WHEN contains(title, ':') THEN 'deny' WHEN regexp_matches(title, '(?i)^list of|gallery') THEN 'deny' WHEN contains(title, '/') THEN 'allow' ELSE 'allow' END AS verdict,
CASE WHEN contains(title, ':') THEN 'namespace' WHEN regexp_matches(title, '(?i)^list of|gallery') THEN 'noise' WHEN contains(title, '/') THEN 'lore' ELSE 'main' END AS reason FROM pages_""")
def page_selection(spark, sf):
    """Which titles are crawled, and why: namespaces and noise are denied first, lore and main pages allowed."""
    reason = F.when(F.contains("title", F.lit(":")), "namespace").when(F.regexp_like("title", F.lit("(?i)^list of|gallery")), "noise").when(F.contains("title", F.lit("/")), "lore").otherwise("main")
    rows = PAGES.frame(spark, sf).withColumn("reason", reason)
    return rows.select("page_id", F.when(F.col("reason").isin("namespace", "noise"), "deny").otherwise("allow").alias("verdict"), "reason")


@query(f"""WITH {PAGES.sql}, p AS (SELECT *, split_part(title, '/', 1) AS root FROM pages_), r AS (SELECT root, min(page_id) AS main, max(array_to_string(coalesce(categories, []), ';')) AS cats FROM p WHERE NOT contains(title, '/') GROUP BY root)
SELECT page_id, coalesce(main, page_id) AS parent, coalesce(nullif(array_to_string(coalesce(categories, []), ';'), ''), cats, '') AS categories FROM p LEFT JOIN r USING (root)""")
def metadata_inheritance(spark, sf):
    """Subpages take what they lack from the page before the slash."""
    rows = PAGES.frame(spark, sf).withColumn("root", F.substring_index("title", "/", 1)).withColumn("own", F.array_join(F.coalesce("categories", F.array().cast("array<string>")), ";"))
    main = rows.where(~F.contains("title", F.lit("/"))).groupBy("root").agg(F.min("page_id").alias("main"), F.max("own").alias("cats"))
    return rows.join(main, "root", "left").select("page_id", F.coalesce("main", "page_id").alias("parent"), F.coalesce(F.nullif("own", F.lit("")), "cats", F.lit("")).alias("categories"))


ALIASES = Literal("aliases", "seq int, alias string, canonical string", [(1, "Mira", "Mira Vale"), (2, "salt harbor", "Salt Harbor"), (3, "Old Tam", "Tam"), (4, "Long Bow", "Long Bow"), (5, "mira", "Mira Vale"), (6, "North Pier", "Salt Harbor")])


@query(f"""WITH {ALIASES.sql}, {PAGES.sql}, a AS (SELECT lower(alias) AS k, arg_max(canonical, seq) AS canonical FROM aliases GROUP BY 1),
l AS (SELECT page_id, title, unnest({markup._ENT}) AS link FROM pages_) SELECT DISTINCT page_id, coalesce(canonical, trim(link)) AS target, canonical IS NOT NULL AS known FROM l LEFT JOIN a ON k = lower(trim(link)) WHERE coalesce(canonical, trim(link)) <> title AND NOT contains(link, ':')""")
def cross_references(spark, sf):
    """Links of each page through the alias table (of several registrations the last wins), distinct and without the page itself."""
    known = ALIASES.frame(spark, sf).groupBy(F.lower("alias").alias("k")).agg(F.max_by("canonical", "seq").alias("canonical"))
    names = F.concat(F.regexp_extract_all("wikitext", F.lit("\\[\\[([^\\]|]+)"), F.lit(1)), F.regexp_extract_all("wikitext", F.lit(f"(?i)\\{{\\{{(?:{markup.NAMED})\\|([^}}|]+)"), F.lit(1)))
    links = PAGES.frame(spark, sf).select("page_id", "title", F.explode(names).alias("link")).where(~F.contains("link", F.lit(":"))).withColumn("k", F.lower(F.trim("link")))
    rows = links.join(known, "k", "left").withColumn("target", F.coalesce("canonical", F.trim("link")))
    return rows.where("target <> title").select("page_id", "target", F.col("canonical").isNotNull().alias("known")).distinct()


@query(f"""WITH {PAGES.sql}, {CATS.sql} SELECT (SELECT count(*) FROM pages_) AS pages, (SELECT count(DISTINCT c) FROM (SELECT unnest(categories) AS c FROM pages_)) AS categories,
(SELECT array_to_string(list_sort(list(DISTINCT c)), ';') FROM (SELECT unnest(categories) AS c FROM pages_)) AS names""")
def registry_summary(spark, sf):
    pages = PAGES.frame(spark, sf)
    cats = pages.select(F.explode("categories").alias("c")).agg(F.countDistinct("c").alias("categories"), F.array_join(F.sort_array(F.collect_set("c")), ";").alias("names"))
    return pages.agg(F.count("*").alias("pages")).crossJoin(cats)


@query(f"""WITH {SECTIONS} SELECT level, count(*) AS sections, count(DISTINCT page_id) AS pages, array_to_string(list_sort(list(DISTINCT heading)), ';') AS headings FROM sections GROUP BY level""")
def structure_profile(spark, sf):
    return markup._sections(spark, sf).groupBy("level").agg(F.count("*").alias("sections"), F.countDistinct("page_id").alias("pages"), F.array_join(F.sort_array(F.collect_set("heading")), ";").alias("headings"))


@query(f"""WITH {SECTIONS}, f AS (SELECT page_id, section, heading, content, regexp_matches(lower(heading), 'story|backstory|youth|part') AS lore FROM sections WHERE content <> '')
SELECT CASE WHEN lore THEN page_id + 50000 ELSE page_id END AS page_id, count(*) AS sections, sum(length(content))::BIGINT AS chars FROM f GROUP BY 1""")
def page_split(spark, sf):
    """Pages in two: sections whose titles tell a story become a page of their own."""
    lore = F.regexp_like(F.lower("heading"), F.lit("story|backstory|youth|part"))
    rows = markup._sections(spark, sf).where("content <> ''").withColumn("page_id", F.when(lore, F.col("page_id") + 50000).otherwise(F.col("page_id")))
    return rows.groupBy("page_id").agg(F.count("*").alias("sections"), F.sum(F.length("content").cast("long")).alias("chars"))


@query("SELECT n_nationkey AS entity, n_name AS canonical, count(s_name) AS n_aliases, array_to_string(coalesce(list_sort(list(s_name)) FILTER (s_name IS NOT NULL), []), ';') AS aliases FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL".replace("coalesce(list_sort(list(s_name)) FILTER (s_name IS NOT NULL), [])", "list_sort(coalesce(list(s_name) FILTER (s_name IS NOT NULL), []))"))
def entities_with_aliases(spark, sf):
    """Every entity with the list of its aliases, empty where it has none."""
    rows = table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.groupBy(F.col("n_nationkey").alias("entity"), F.col("n_name").alias("canonical")).agg(F.count("s_name").alias("n_aliases"), F.array_join(F.sort_array(F.collect_list("s_name")), ";").alias("aliases"))


REGISTRY = Literal("registry", "name string, element string, region string", [("mira vale", "Tide", None), ("salt harbor", None, "Coast")])


@query(f"""WITH {PAGES.sql}, {REGISTRY.sql} SELECT page_id, coalesce(element, 'unknown') AS element, coalesce(region, 'unknown') AS region FROM pages_ LEFT JOIN registry ON name = lower(split_part(title, '/', 1))""")
def metadata_sync(spark, sf):
    """A second pass fills attributes of pages from the registry, whatever the order in which both were read."""
    rows = PAGES.frame(spark, sf).withColumn("name", F.lower(F.substring_index("title", "/", 1))).join(REGISTRY.frame(spark, sf), "name", "left")
    return rows.select("page_id", F.coalesce("element", F.lit("unknown")).alias("element"), F.coalesce("region", F.lit("unknown")).alias("region"))


@query("""SELECT doc_id, source, CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 1) ELSE text END = '' AS first_empty, length(split_part(text, chr(10), 1)) AS curated, length(text) - length(split_part(text, chr(10), 1)) AS raw,
CASE WHEN contains(text, chr(10)) THEN 'curated+raw' ELSE 'curated' END AS provenance FROM documents""")
def bilingual_split(spark, sf):
    """A text cut at its first marker (here the line end) into the curated part and the raw one, with what it came from."""
    head = F.substring_index("text", "\n", 1)
    n = lambda c: F.length(c).cast("long")
    return table(spark, sf, "documents").select("doc_id", "source", (head == "").alias("first_empty"), n(head).alias("curated"), (n("text") - n(head)).alias("raw"), F.when(F.contains("text", F.lit("\n")), "curated+raw").otherwise("curated").alias("provenance"))


@query("""SELECT doc_id, lag(doc_id) OVER w AS previous, md5(coalesce(right(lag(text) OVER w, 100), '') || text) AS overlapped FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def chunk_overlap(spark, sf):
    """Each chunk begins with the last 100 characters of the chunk before it on its page; only ids and those ends are put in order."""
    docs = table(spark, sf, "documents")
    w = Window.partitionBy("source").orderBy("doc_id")
    before = docs.select("doc_id", F.lag("doc_id").over(w).alias("previous"), F.coalesce(F.lag(F.right("text", F.lit(100))).over(w), F.lit("")).alias("before"))
    return docs.select("doc_id", "text").join(before, "doc_id").select("doc_id", "previous", F.md5(F.concat("before", "text")).alias("overlapped"))


@query()
def prose_children(spark, sf):
    """Paragraphs packed into children of at most 800 characters; pieces under 20 are dropped, and each begins with the tail of the one before."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    rows = table(spark, sf, "documents").select("doc_id", lines.alias("lines"))
    packed = rows.select("doc_id", "lines", F.posexplode(core.greedy_pack(F.col("lines"), F.transform("lines", lambda x: F.length(x).cast("long")), 400, 800)).alias("child", "c"))
    packed = packed.select("doc_id", F.col("child").cast("long").alias("child"), F.array_join(F.slice("lines", F.col("c.first") + 1, F.col("c.last") - F.col("c.first") + 1), "\n").alias("body"))
    before = F.lag("body").over(Window.partitionBy("doc_id").orderBy("child"))
    return packed.withColumn("head", F.coalesce(F.right(before, F.lit(100)), F.lit(""))).where(F.length("body") >= 20).select("doc_id", "child", F.length("body").cast("long").alias("chars"), F.md5(F.concat("head", "body")).alias("digest"))


@query()
def semantic_chunks(spark, sf):
    """Sentences packed by characters: a chunk ends before 3600 would be passed, or once it has between 1600 and 2800."""
    parts = texts.sentences(F.col("text"))
    rows = table(spark, sf, "documents").select("doc_id", parts.alias("parts"))
    packed = rows.select("doc_id", F.posexplode(core.greedy_pack(F.col("parts"), F.transform("parts", lambda x: F.length(x).cast("long")), 1600, 3600, ceiling=2800)).alias("chunk", "c"))
    return packed.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("c.first").alias("first"), F.col("c.last").alias("last"), F.col("c.size").alias("chars"))
