"""Wiki markup: cleaning, infoboxes, tables, sections, parents and chunks.

None of the driver's tables holds wikitext, so these queries run on the pages below. All work is
column expressions and windows by page; a page's lines are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as texts
from ..operators import core
from ..sources.tables import table
from ._catalog import Literal, Register, chain, chain_sql

query = Register()

PAGES = Literal("pages_", "page_id long, title string, categories array<string>, wikitext string", [
    (1, "Mira Vale", ["Playable Characters", "Coastal Union"], "{{Character Infobox\n|name = Mira Vale\n|image = mira.png\n|weapon = [[Long Bow|bow]]\n|home = {{Location|Salt Harbor}}\n|note =\n}}\n'''Mira''' is an ''archer'' of [[Salt Harbor]].<!-- draft --><ref>Tome 2</ref>\n\n== Story ==\nShe left home early .She met {{Resonator|Old Tam}} there.\n\n=== Youth ===\n* born in spring\n* learned the bow\n\n== Gallery ==\n[[File:mira.png|thumb|120px]]\n== Dialogue ==\nMira: Where is the tide?\nTam: Behind the wall.\nIt moved again.\n* (Approach the door)\nMira: I see.\n[[Category:Playable Characters]]"),
    (2, "Salt Harbor", ["Regions"], "'''Salt Harbor''' is a port.\r\n== Districts ==\n{| class=\"wikitable\"\n|-\n! Name !! style=\"width:4em\" | Ward\n|-\n| [[North Pier]] || '''1'''\n|-\n| Old Town\n| 2\n|}\n== Other Languages ==\nport de sel\n== Trivia ==\nThe wall is new.\n{{Navbox|ports}}\n[[fr:Port de sel]]"),
    (3, "List of bows", [], "# Bows\n{{Weapon|Long Bow}} and {{Tooltip|Short Bow|a small one}}.\n<u>Old</u> <b>and</b> <i>new</i><br/>bows\n}}\n__TOC__"),
    (4, "Mira Vale/Backstory", ["Coastal Union", "Stub"], "{{Quote|The tide waits|Tam}}\n== Part 1 ==\nA long road.\n==== Deep ====\nDeeper.\n=== Side ===\n\n== Part 2 ==\nHome."),
    (5, "Empty", None, ""),
], given=("documents", ["1000000 + doc_id", "source", "[lang]", "text"]))

# Markup patterns, each with what it becomes.
HTML = [("(?is)<u[^>]*>(.*?)</u>", "**\\1**"), ("(?is)<b[^>]*>(.*?)</b>", "**\\1**"), ("(?is)<i[^>]*>(.*?)</i>", "*\\1*"), ("(?i)<br\\s*/?>", "\n"), ("<[^>]+>", "")]
HEADER = [("[*_#~`]", ""), ("<[^>]+>", "")]
BRACKETS = [("(?m)^[ \\t]*\\}\\}[ \\t]*$", ""), ("(?m)^[ \\t]*\\{\\{[ \\t]*$", ""), ("\\}\\}\\s*$", ""), ("^\\s*\\}\\}", "")]
NAMED = "Enemy|Item|Resonator|Location|Faction|Echo|Weapon|Character"
NOISE = [
    ("(?s)<!--.*?-->", ""), ("(?i)<ref[^>]*/>", ""), ("(?is)<ref[^>]*>.*?</ref>", ""), ("(?is)<gallery[^>]*>.*?</gallery>", ""),
    ("(?i)\\[\\[Category:[^\\]]*\\]\\]", ""), ("\\[\\[[a-z]{2}:[^\\]]*\\]\\]", ""), ("__[A-Z]+__", ""), ("\r\n?", "\n"),
]
TEMPLATES = [
    ("(?i)\\{\\{Quote\\|([^}|]+)\\|([^}|]+)\\}\\}", "> \\1\n> — \\2"), ("(?i)\\{\\{Tooltip\\|([^}|]+)\\|([^}]+)\\}\\}", "\\1 (\\2)"),
    (f"(?i)\\{{\\{{(?:{NAMED})\\|([^}}|]+)(?:\\|[^}}]+)?\\}}\\}}", "\\1"), ("(?i)\\{\\{(?:Icon|Color|Card|Asset|Navbox)\\|[^}]*\\}\\}", ""),
]
IMAGES = [("(?im)^\\s*\\[\\[(?:File|Image):[^\\]]*\\]\\]\\s*$", "")]
SPACING = [("([.?!\",])([A-Z])", "\\1 \\2"), ("\\s+([,.:;?!])", "\\1"), ("\n{3,}", "\n\n")]
LINKS = [("\\[\\[[^\\]|]*\\|([^\\]]*)\\]\\]", "\\1"), ("\\[\\[([^\\]]*)\\]\\]", "\\1"), ("\\[https?://[^\\s\\]]+\\s+([^\\]]+)\\]", "\\1"), ("\\[https?://[^\\]]+\\]", "")]
EMPHASIS = [("'''''(.+?)'''''", "***\\1***"), ("'''(.+?)'''", "**\\1**"), ("''(.+?)''", "*\\1*")]
HEADINGS = [(f"(?m)^={{{n}}}[ \\t]*([^=\\n]+?)[ \\t]*={{{n}}}[ \\t]*$", "#" * n + " \\1") for n in (6, 5, 4, 3, 2, 1)]
#: A template inside another becomes its last argument, so that the outer one holds no braces.
INNER = [("\\{\\{(?:[^{}|\\n=]*\\|)*([^{}|\\n=]*)\\}\\}", "\\1")]
INFOBOX = "(?is)\\{\\{([^{}|]*infobox[^{}|]*)\\|([^{}]*)\\}\\}"
#: Titles of sections without content of their own, and those that a kind of page keeps.
BOILERPLATE, KEEP = ["gallery", "other languages", "navigation", "references", "see also", "trivia"], {"CHARACTER": ["trivia"]}
STOP, BLACK = ["the", "a", "an", "in", "on", "of"], ["overview", "trivia", "name"]

_CLEAN = NOISE + TEMPLATES + IMAGES + SPACING
_TRIM = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def trimmed(col: Column) -> Column:
    return F.regexp_replace(col, "^\\s+|\\s+$", "")


def sanitized(wikitext: Column) -> Column:
    """Wikitext without comments, references, galleries, categories, links to other wikis and display templates; infoboxes go too."""
    inner = chain(chain(wikitext, NOISE), INNER)
    return trimmed(chain(chain(inner, [(INFOBOX, "")]), TEMPLATES + IMAGES + SPACING))


def markdown(wikitext: Column) -> Column:
    return trimmed(chain(sanitized(wikitext), EMPHASIS + LINKS + HEADINGS + [("\n{3,}", "\n\n")]))


def sanitized_sql(expr: str) -> str:
    return _TRIM.format(chain_sql(chain_sql(expr, NOISE + INNER + [(INFOBOX, "")]), TEMPLATES + IMAGES + SPACING))


def markdown_sql(expr: str) -> str:
    return _TRIM.format(chain_sql(sanitized_sql(expr), EMPHASIS + LINKS + HEADINGS + [("\n{3,}", "\n\n")]))


MD = f"{PAGES.sql}, md AS (SELECT page_id, title, categories, wikitext, {markdown_sql('wikitext')} AS md FROM pages_)"


def _md(spark, sf) -> DataFrame:
    return PAGES.frame(spark, sf).withColumn("md", markdown(F.col("wikitext")))


@query(f"WITH {PAGES.sql} SELECT page_id, {chain_sql('wikitext', HTML)} AS html, {_TRIM.format(chain_sql('wikitext', HEADER))} AS header, {chain_sql('wikitext', BRACKETS)} AS brackets FROM pages_")
def markup_tags(spark, sf):
    """HTML tags as markdown, titles without markup, and orphaned braces removed."""
    w = F.col("wikitext")
    return PAGES.frame(spark, sf).select("page_id", chain(w, HTML).alias("html"), trimmed(chain(w, HEADER)).alias("header"), chain(w, BRACKETS).alias("brackets"))


@query(f"WITH {PAGES.sql} SELECT page_id, {sanitized_sql('wikitext')} AS clean FROM pages_")
def wikitext_sanitized(spark, sf):
    return PAGES.frame(spark, sf).select("page_id", sanitized(F.col("wikitext")).alias("clean"))


@query(f"WITH {MD} SELECT page_id, md FROM md")
def wikitext_markdown(spark, sf):
    return _md(spark, sf).select("page_id", "md")


#: What an infobox is read from: links in its values hold pipes, so they become their text first.
_FLAT = NOISE + INNER + LINKS[:2]
_BOX = {g: f"regexp_extract({chain_sql('wikitext', _FLAT)}, '{INFOBOX}', {g})" for g in (1, 2)}
_PARAMS = f"list_filter(list_transform(string_split({_BOX[2]}, '|'), lambda p: [trim(split_part(p, '=', 1), ' ' || chr(10)), trim(substr(p, strpos(p, '=') + 1), ' ' || chr(10))]), lambda p: p[1] <> '' AND p[2] <> '' AND p[1] <> p[2])"


def infobox(wikitext: Column) -> tuple[Column, Column]:
    """Name and parameters (a map, empty values left out) of a page's infobox; templates in values become their last argument."""
    inner = chain(wikitext, _FLAT)
    trim = lambda c: F.btrim(c, F.lit(" \n"))
    parts = F.split(F.regexp_extract(inner, INFOBOX, 2), "\\|")
    pairs = F.transform(parts, lambda p: F.struct(trim(F.substring_index(p, "=", 1)).alias("k"), trim(F.substring(p, F.instr(p, "=") + 1, F.length(p))).alias("v")))
    kept = F.filter(pairs, lambda p: (p["k"] != "") & (p["v"] != "") & (p["k"] != p["v"]))
    return trim(F.regexp_extract(inner, INFOBOX, 1)), F.map_from_entries(kept)


@query(f"WITH {PAGES.sql} SELECT page_id, trim({_BOX[1]}, ' ' || chr(10)) AS template, array_to_string(list_sort(list_transform({_PARAMS}, lambda p: p[1] || '=' || p[2])), ';') AS params FROM pages_")
def infobox_params(spark, sf):
    name, params = infobox(F.col("wikitext"))
    rows = PAGES.frame(spark, sf).select("page_id", name.alias("template"), F.map_entries(params).alias("p"))
    return rows.select("page_id", "template", F.array_join(F.sort_array(F.transform("p", lambda p: F.concat(p["key"], F.lit("="), p["value"]))), ";").alias("params"))


@query(f"""WITH {PAGES.sql}, b AS (SELECT page_id, title, list_filter({_PARAMS}, lambda p: p[1] NOT IN ('image', 'name')) AS p, map_from_entries(list_transform({_PARAMS}, lambda p: (p[1], p[2]))) AS m FROM pages_)
SELECT page_id, CASE WHEN len(p) = 0 THEN '' ELSE coalesce(m['name'], title) || ' — ' || array_to_string(list_transform(p, lambda x: x[1] || ': ' || x[2]), '; ') || '.' END AS sentence FROM b""")
def infobox_sentence(spark, sf):
    """The infobox as one sentence, image and name fields aside."""
    params = infobox(F.col("wikitext"))[1]
    rows = PAGES.frame(spark, sf).select("page_id", F.coalesce(F.try_element_at(params, F.lit("name")), "title").alias("name"), F.filter(F.map_entries(params), lambda p: ~p["key"].isin("image", "name")).alias("p"))
    said = F.array_join(F.transform("p", lambda p: F.concat(p["key"], F.lit(": "), p["value"])), "; ")
    return rows.select("page_id", F.when(F.size("p") == 0, "").otherwise(F.concat("name", F.lit(" — "), said, F.lit("."))).alias("sentence"))


@query(f"""WITH {PAGES.sql}, t AS (SELECT page_id, unnest(regexp_extract_all(wikitext, '\\{{\\{{([^{{}}]*)\\}}\\}}', 1)) AS body FROM pages_)
SELECT page_id, trim(split_part(body, '|', 1)) AS template, len(string_split(body, '|')) - 1 AS n_args FROM t WHERE NOT contains(lower(split_part(body, '|', 1)), 'infobox')""")
def template_list(spark, sf):
    """The innermost templates besides infoboxes, with their numbers of arguments."""
    rows = PAGES.frame(spark, sf).select("page_id", F.explode(F.regexp_extract_all("wikitext", F.lit("\\{\\{([^{}]*)\\}\\}"), F.lit(1))).alias("body"))
    name = F.substring_index("body", "|", 1)
    return rows.where(~F.contains(F.lower(name), F.lit("infobox"))).select("page_id", F.trim(name).alias("template"), (F.size(F.split("body", "\\|")) - 1).cast("long").alias("n_args"))


@query(f"""WITH {PAGES.sql}, t AS (SELECT lower(unnest(regexp_extract_all(wikitext, '\\{{\\{{([^{{}}|]+)', 1))) AS template FROM pages_) SELECT trim(template, ' ' || chr(10)) AS template, count(*) AS n FROM t GROUP BY 1""")
def unknown_templates(spark, sf):
    """How often each template name occurs."""
    rows = PAGES.frame(spark, sf).select(F.explode(F.regexp_extract_all("wikitext", F.lit("\\{\\{([^{}|]+)"), F.lit(1))).alias("t"))
    return rows.groupBy(F.btrim(F.lower("t"), F.lit(" \n")).alias("template")).agg(F.count("*").alias("n"))


_ENT = f"list_concat(regexp_extract_all(wikitext, '\\[\\[([^\\]|]+)', 1), regexp_extract_all(wikitext, '(?i)\\{{\\{{(?:{NAMED})\\|([^}}|]+)', 1))"
_BARE = "CASE WHEN lower(split_part(trim(e), ' ', 1)) IN ('" + "', '".join(STOP) + "') AND contains(trim(e), ' ') THEN trim(substr(trim(e), strpos(trim(e), ' ') + 1)) ELSE trim(e) END"


def entity_name(e: Column) -> Column:
    """A name without a leading stop word, or the empty string where nothing useful is left."""
    e = F.trim(e)
    first = F.lower(F.substring_index(e, " ", 1))
    bare = F.when(first.isin(STOP) & F.contains(e, F.lit(" ")), F.trim(F.substring(e, F.instr(e, " ") + 1, F.length(e)))).otherwise(e)
    return F.when(F.lower(bare).isin(BLACK) | (F.length(bare) < 2) | F.contains(bare, F.lit(":")), "").otherwise(bare)


@query(f"""WITH {PAGES.sql}, e AS (SELECT page_id, list_transform({_ENT}, lambda e: {_BARE}) AS es FROM pages_)
SELECT page_id, array_to_string(list_sort(list_distinct(list_filter(es, lambda e: lower(e) NOT IN ('{"', '".join(BLACK)}') AND length(e) >= 2 AND NOT contains(e, ':')))), ';') AS entities FROM e""")
def markup_entities(spark, sf):
    """Names from links and entity templates, cleaned, distinct and sorted."""
    links = F.regexp_extract_all("wikitext", F.lit("\\[\\[([^\\]|]+)"), F.lit(1))
    named = F.regexp_extract_all("wikitext", F.lit(f"(?i)\\{{\\{{(?:{NAMED})\\|([^}}|]+)"), F.lit(1))
    names = F.filter(F.transform(F.concat(links, named), entity_name), lambda e: e != "")
    return PAGES.frame(spark, sf).select("page_id", F.array_join(F.sort_array(F.array_distinct(names)), ";").alias("entities"))


@query(f"""WITH {MD}, e AS (SELECT page_id, md, {_ENT} AS es FROM md) SELECT page_id, array_to_string(list_filter(es, lambda e: length(e) BETWEEN 2 AND 40 AND lower(e) NOT IN ('{"', '".join(STOP + BLACK)}') AND contains(lower(md), lower(e)) AND NOT regexp_matches(e, '^[0-9]|:')), ';') AS entities FROM e""")
def entity_list_clean(spark, sf):
    """Entities of 2 to 40 characters that aren't noise and occur in the page's text."""
    links = F.regexp_extract_all("wikitext", F.lit("\\[\\[([^\\]|]+)"), F.lit(1))
    named = F.regexp_extract_all("wikitext", F.lit(f"(?i)\\{{\\{{(?:{NAMED})\\|([^}}|]+)"), F.lit(1))
    good = lambda e: F.length(e).between(2, 40) & ~F.lower(e).isin(STOP + BLACK) & F.contains(F.lower("md"), F.lower(e)) & ~F.regexp_like(e, F.lit("^[0-9]|:"))
    return _md(spark, sf).select("page_id", F.array_join(F.filter(F.concat(links, named), good), ";").alias("entities"))


def _lines(spark, sf) -> DataFrame:
    """A row for each markdown line: ``page_id, seq, line, level, heading``; level 0 where it is no heading."""
    rows = _md(spark, sf).select("page_id", "title", F.posexplode(F.split("md", "\n")).alias("seq", "line"))
    rows = rows.withColumn("seq", F.col("seq").cast("long"))
    return rows.withColumns({"level": F.length(F.regexp_extract("line", "^(#{1,6})\\s", 1)).cast("long"), "heading": F.when(F.regexp_like("line", F.lit("^#{1,6}\\s")), F.trim(F.regexp_replace("line", "^#{1,6}\\s+", "")))})


LINES = f"""{MD}, ln AS (SELECT page_id, title, k - 1 AS seq, ls[k] AS line FROM (SELECT page_id, title, string_split(md, chr(10)) AS ls, unnest(range(1, len(string_split(md, chr(10))) + 1)) AS k FROM md)),
lines AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})\\s', 1)) AS level, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN trim(regexp_replace(line, '^#{{1,6}}\\s+', '')) END AS heading FROM ln)"""


def _so_far() -> Window:
    """A page's lines up to the present one."""
    return Window.partitionBy("page_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)


@query(f"""WITH {LINES}, s AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY seq) AS sec FROM lines),
r AS (SELECT *, lower(coalesce(sec, '')) IN ('{"', '".join(BOILERPLATE)}') AS gone FROM s)
SELECT page_id, coalesce(string_agg(line, chr(10) ORDER BY seq) FILTER (NOT gone), '') AS kept, coalesce(string_agg(heading, ';' ORDER BY seq) FILTER (gone AND heading IS NOT NULL), '') AS removed FROM r GROUP BY page_id""")
def boilerplate_removed(spark, sf):
    """Lines under the last heading are dropped if its title is on the list; the titles dropped are reported."""
    rows = _lines(spark, sf).withColumn("gone", F.lower(F.coalesce(F.last("heading", ignorenulls=True).over(_so_far()), F.lit(""))).isin(BOILERPLATE))
    joined = lambda c, cond, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("seq", c)))), lambda x: x[c]), sep)
    return rows.groupBy("page_id").agg(joined("line", ~F.col("gone"), "\n").alias("kept"), joined("heading", F.col("gone") & F.col("heading").isNotNull(), ";").alias("removed"))


@query(f"""SELECT kind, array_to_string(list_sort(list_filter(['{"', '".join(BOILERPLATE)}'], lambda x: NOT list_contains(keep, x))), ';') AS blocked FROM (VALUES ('CHARACTER', ['trivia']), ('REGION', [])) t(kind, keep)""")
def blocklist_by_kind(spark, sf):
    """The titles dropped on each kind of page: the list without those that the kind keeps."""
    kinds = spark.createDataFrame([("CHARACTER", KEEP["CHARACTER"]), ("REGION", [])], "kind string, keep array<string>")
    return kinds.select("kind", F.array_join(F.sort_array(F.array_except(F.array(*map(F.lit, BOILERPLATE)), "keep")), ";").alias("blocked"))


SECTIONS = f"""{LINES}, n AS (SELECT *, sum((level > 0)::INT) OVER (PARTITION BY page_id ORDER BY seq) AS section FROM lines),
sections AS (SELECT page_id, section, max(title) AS title, coalesce(max(heading), 'Lead') AS heading, max(level) AS level, coalesce(trim(string_agg(line, chr(10) ORDER BY seq) FILTER (level = 0), chr(10) || ' '), '') AS content, min(seq) AS start FROM n GROUP BY page_id, section)"""


def _sections(spark, sf) -> DataFrame:
    """A row for each section, the lead being section 0: ``page_id, section, title, heading, level, content, start``."""
    rows = _lines(spark, sf).withColumn("section", F.sum((F.col("level") > 0).cast("long")).over(_so_far()))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("level") == 0, F.struct("seq", "line")))), lambda x: x["line"]), "\n")
    return rows.groupBy("page_id", "section").agg(F.max("title").alias("title"), F.coalesce(F.max("heading"), F.lit("Lead")).alias("heading"), F.max("level").alias("level"), F.btrim(body, F.lit("\n ")).alias("content"), F.min("seq").alias("start"))


@query(f"WITH {SECTIONS} SELECT page_id, section::BIGINT AS section, heading, level, content FROM sections WHERE content <> '' OR level > 0")
def page_sections(spark, sf):
    return _sections(spark, sf).where("content <> '' or level > 0").select("page_id", "section", "heading", "level", "content")


@query(f"WITH {SECTIONS} SELECT page_id, section::BIGINT AS section, start, coalesce(lead(start) OVER (PARTITION BY page_id ORDER BY section), -1) AS end_ FROM sections")
def section_ends(spark, sf):
    """Where each section ends: the start of the next one, or -1."""
    return _sections(spark, sf).select("page_id", "section", "start", F.coalesce(F.lead("start").over(Window.partitionBy("page_id").orderBy("section")), F.lit(-1)).alias("end_"))


PATHS = f"""{SECTIONS}, h2 AS (SELECT *, sum((level IN (1, 2))::INT) OVER w AS i2 FROM sections WINDOW w AS (PARTITION BY page_id ORDER BY section)),
paths AS (SELECT *, sum((level = 3)::INT) OVER (PARTITION BY page_id, i2 ORDER BY section) AS i3, max(heading) FILTER (level IN (1, 2)) OVER (PARTITION BY page_id, i2) AS t2,
  last_value(CASE WHEN level = 3 THEN heading END IGNORE NULLS) OVER (PARTITION BY page_id, i2 ORDER BY section) AS t3 FROM h2)"""


def _paths(spark, sf) -> DataFrame:
    """Sections with the counters and titles of their h2 and h3; the h3 counter starts anew under each h2."""
    page, under = Window.partitionBy("page_id").orderBy("section"), Window.partitionBy("page_id", "i2").orderBy("section")
    top = F.col("level").isin(1, 2)
    rows = _sections(spark, sf).withColumn("i2", F.sum(top.cast("long")).over(page))
    return rows.withColumns({
        "i3": F.sum((F.col("level") == 3).cast("long")).over(under), "t2": F.max(F.when(top, F.col("heading"))).over(Window.partitionBy("page_id", "i2")),
        "t3": F.last(F.when(F.col("level") == 3, F.col("heading")), ignorenulls=True).over(under),
    })


@query(f"WITH {PATHS} SELECT page_id, section::BIGINT AS section, i2::BIGINT AS i2, i3::BIGINT AS i3, concat_ws(' > ', title, t2, t3) AS path, page_id || ':' || i2 || '.' || i3 AS section_id FROM paths")
def heading_paths(spark, sf):
    path = F.concat_ws(" > ", "title", "t2", "t3")
    return _paths(spark, sf).select("page_id", "section", "i2", "i3", path.alias("path"), F.concat_ws("", F.col("page_id"), F.lit(":"), "i2", F.lit("."), "i3").alias("section_id"))


@query(f"""WITH {PATHS} SELECT page_id, page_id || ':' || i2 || '.' || i3 AS parent_id, max(concat_ws(' > ', title, t2, t3)) AS path,
string_agg(CASE WHEN level > 3 THEN repeat('#', level::BIGINT) || ' ' || heading || chr(10) ELSE '' END || content, chr(10) || chr(10) ORDER BY section) AS body FROM paths WHERE content <> '' GROUP BY page_id, i2, i3""")
def page_parents(spark, sf):
    """One parent for each h2 and each h3 below it; deeper headings are folded into the body."""
    own = F.concat(F.when(F.col("level") > 3, F.concat(F.repeat(F.lit("#"), F.col("level").cast("int")), F.lit(" "), "heading", F.lit("\n"))).otherwise(""), "content")
    rows = _paths(spark, sf).where("content <> ''").select("*", F.struct("section", own.alias("own")).alias("part"))
    grouped = rows.groupBy("page_id", "i2", "i3").agg(F.max(F.concat_ws(" > ", "title", "t2", "t3")).alias("path"), F.sort_array(F.collect_list("part")).alias("parts"))
    return grouped.select("page_id", F.concat_ws("", "page_id", F.lit(":"), "i2", F.lit("."), "i3").alias("parent_id"), "path", F.array_join(F.transform("parts", lambda p: p["own"]), "\n\n").alias("body"))


_TABLE = "(?s)\\{\\|(.*?)\\n\\|\\}"
_CELL = [("'''?(.+?)'''?", "\\1")] + LINKS[:2] + [("(?m)^\\s*\\*+\\s*", "")]
TABLES = f"""{PAGES.sql}, tb AS (SELECT page_id, k - 1 AS table_, ts[k] AS body FROM (SELECT page_id, regexp_extract_all(wikitext, '{_TABLE}', 1) AS ts, unnest(range(1, len(regexp_extract_all(wikitext, '{_TABLE}', 1)) + 1)) AS k FROM pages_)),
rw AS (SELECT page_id, table_, list_filter(list_transform(string_split_regex(body, '\\n\\|-[^\\n]*\\n'), lambda r: trim(r, ' ' || chr(10))), lambda r: r <> '') AS rs FROM tb),
hd AS (SELECT *, list_transform(string_split_regex(regexp_replace(list_filter(rs, lambda r: r[1:1] = '!')[1], '^!\\s*', ''), '\\s*!!\\s*|\\n\\s*!\\s*'), lambda h: {chain_sql("regexp_replace(trim(h), '^[a-z]+=[^|]*\\|\\s*', '')", _CELL)}) AS hs, list_filter(rs, lambda r: r[1:1] = '|') AS ds FROM rw),
ce AS (SELECT page_id, table_, hs, i - 1 AS row_, list_transform(string_split_regex(regexp_replace(ds[i], '^\\|\\s*', ''), '\\s*\\|\\|\\s*|\\n\\s*\\|\\s*'), lambda c: {chain_sql('trim(c)', _CELL)}) AS cs FROM (SELECT *, unnest(range(1, len(ds) + 1)) AS i FROM hd))"""


def _tables(spark, sf) -> DataFrame:
    """A row for each table row: ``page_id, table_, row_, hs, cs``, headers and cells without markup."""
    rows = PAGES.frame(spark, sf).select("page_id", F.posexplode(F.regexp_extract_all("wikitext", F.lit(_TABLE), F.lit(1))).alias("table_", "body"))
    rs = F.filter(F.transform(F.split("body", "\\n\\|-[^\\n]*\\n"), lambda r: F.btrim(r, F.lit(" \n"))), lambda r: r != "")
    rows = rows.select("page_id", F.col("table_").cast("long").alias("table_"), rs.alias("rs"))
    head = F.get(F.filter("rs", lambda r: r.startswith("!")), F.lit(0))
    names = F.transform(F.split(F.regexp_replace(head, "^!\\s*", ""), "\\s*!!\\s*|\\n\\s*!\\s*"), lambda h: chain(F.regexp_replace(F.trim(h), "^[a-z]+=[^|]*\\|\\s*", ""), _CELL))
    rows = rows.select("page_id", "table_", names.alias("hs"), F.posexplode(F.filter("rs", lambda r: r.startswith("|"))).alias("row_", "data"))
    cells = F.transform(F.split(F.regexp_replace("data", "^\\|\\s*", ""), "\\s*\\|\\|\\s*|\\n\\s*\\|\\s*"), lambda c: chain(F.trim(c), _CELL))
    return rows.select("page_id", "table_", F.col("row_").cast("long").alias("row_"), "hs", cells.alias("cs"))


@query(f"WITH {TABLES} SELECT page_id, table_, row_, array_to_string(list_transform(range(1, least(len(hs), len(cs)) + 1), lambda i: hs[i] || ': ' || cs[i] || '.'), ' ') AS inlined FROM ce")
def table_rows(spark, sf):
    """Wikitext tables as sentences: cells zipped with their headers, short rows allowed."""
    said = F.transform(F.arrays_zip("hs", "cs"), lambda p: F.when(p["hs"].isNotNull() & p["cs"].isNotNull(), F.concat(p["hs"], F.lit(": "), p["cs"], F.lit("."))))
    return _tables(spark, sf).select("page_id", "table_", "row_", F.array_join(said, " ").alias("inlined"))


@query(f"WITH {TABLES} SELECT page_id, table_, '| ' || array_to_string(max(hs), ' | ') || ' |' || chr(10) || '|' || repeat(' --- |', len(max(hs))) || chr(10) || string_agg('| ' || array_to_string(cs, ' | ') || ' |', chr(10) ORDER BY row_) AS gfm FROM ce GROUP BY page_id, table_")
def tables_as_markdown(spark, sf):
    line = lambda c: F.concat(F.lit("| "), F.array_join(c, " | "), F.lit(" |"))
    rows = _tables(spark, sf).groupBy("page_id", "table_").agg(F.first("hs").alias("hs"), F.sort_array(F.collect_list(F.struct("row_", line("cs").alias("line")))).alias("rows"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.size("hs")))
    return rows.select("page_id", "table_", F.concat_ws("\n", line("hs"), rule, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("gfm"))


@query(f"""WITH {TABLES}, t AS (SELECT DISTINCT page_id, table_, row_number() OVER (PARTITION BY page_id ORDER BY table_) AS k FROM (SELECT DISTINCT page_id, table_ FROM ce)),
{SECTIONS.replace(PAGES.sql + ', ', '', 1)}, s AS (SELECT page_id, section, row_number() OVER (PARTITION BY page_id ORDER BY section) AS k FROM sections WHERE contains(content, '{{|'))
SELECT page_id, section::BIGINT AS section, table_ FROM s JOIN t USING (page_id, k)""")
def table_sections(spark, sf):
    """The i-th table of a page belongs to the i-th section that holds one."""
    tables = core.ranked(_tables(spark, sf).select("page_id", "table_").distinct(), ["page_id"], ["table_"], "k")
    holders = core.ranked(_sections(spark, sf).where(F.contains("content", F.lit("{|"))), ["page_id"], ["section"], "k")
    return holders.join(tables, ["page_id", "k"]).select("page_id", "section", "table_")


TALK = Literal("talk", "scene long, seq long, line string", [
    (1, 0, "Mira: Where is the tide?"), (1, 1, "It moved."), (1, 2, "Tam: Behind the wall."), (1, 3, "(Approach the door)"), (1, 4, "Narrator: Night falls."), (1, 5, "A bell rings."), (1, 6, "Mira: I see."), (1, 7, "Tam: Go on."),
    (2, 0, "Silence."), (2, 1, "Tam: Who is there?"), (2, 2, "And why?"),
], given=("conversations", ["1000000 + conv_id", "turn", "concat(role, ': ', text)"]))
SPEAKER = "^([\\p{L}][\\p{L} ]{0,30}): "
TURNS = f"""{TALK.sql}, sp AS (SELECT *, CASE WHEN regexp_matches(line, '{SPEAKER}') THEN regexp_extract(line, '{SPEAKER}', 1) WHEN line[1:1] = '(' THEN 'Rule' END AS who FROM talk),
pv AS (SELECT *, last_value(who IGNORE NULLS) OVER (PARTITION BY scene ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sp),
st AS (SELECT *, who IS NOT NULL OR before IS NULL OR before IN ('Narrator', 'Rule') AS starts FROM pv),
tn AS (SELECT *, sum(starts::INT) OVER (PARTITION BY scene ORDER BY seq) AS turn FROM st),
turns AS (SELECT scene, turn, coalesce(max(who), 'Narrator') AS speaker, string_agg(regexp_replace(line, '{SPEAKER}', ''), ' ' ORDER BY seq) AS said FROM tn GROUP BY scene, turn)"""


def turns(rows: DataFrame) -> DataFrame:
    """Lines as turns ``scene, turn, speaker, said``: a line without speaker continues the turn before it, unless that was the narrator's or a rule's."""
    scene = Window.partitionBy("scene").orderBy("seq")
    who = F.when(F.regexp_like("line", F.lit(SPEAKER)), F.regexp_extract("line", SPEAKER, 1)).when(F.col("line").startswith("("), "Rule")
    rows = rows.withColumn("who", who)
    rows = rows.withColumn("before", F.last("who", ignorenulls=True).over(scene.rowsBetween(Window.unboundedPreceding, -1)))
    starts = F.col("who").isNotNull() | F.col("before").isNull() | F.col("before").isin("Narrator", "Rule")
    rows = rows.withColumn("turn", F.sum(starts.cast("long")).over(scene))
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.regexp_replace("line", SPEAKER, "").alias("said")))), lambda x: x["said"]), " ")
    return rows.groupBy("scene", "turn").agg(F.coalesce(F.max("who"), F.lit("Narrator")).alias("speaker"), said.alias("said"))


@query(f"WITH {TURNS} SELECT scene, turn::BIGINT AS turn, speaker, said FROM turns")
def dialogue_turns(spark, sf):
    return turns(TALK.frame(spark, sf))


@query(f"WITH {TURNS} SELECT scene, array_to_string(list_sort(list_distinct(list_concat(list(speaker), ['Mira', 'Harbor']))), ';') AS entities FROM turns GROUP BY scene")
def scene_entities(spark, sf):
    """A scene's speakers together with the entities of its section, sorted."""
    return turns(TALK.frame(spark, sf)).groupBy("scene").agg(F.array_join(F.sort_array(F.array_union(F.collect_set("speaker"), F.array(F.lit("Mira"), F.lit("Harbor")))), ";").alias("entities"))


@query()
def dialogue_chunks(spark, sf):
    """Turns of each conversation packed in order: a chunk ends before 512 tokens would be passed, or once it has 256 tokens and three turns."""
    said = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
    packed = said.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]).alias("lines"))
    sizes = F.transform("lines", lambda x: texts.chunk_token_estimate(x))
    chunks = packed.select("conv_id", "lines", F.posexplode(core.greedy_pack(F.col("lines"), sizes, 256, 512, least=3)).alias("chunk", "c"))
    body = F.array_join(F.slice("lines", F.col("c.first") + 1, F.col("c.last") - F.col("c.first") + 1), "\n")
    return chunks.select("conv_id", F.col("chunk").cast("long").alias("chunk"), F.md5(body).alias("body"), F.col("c.size").alias("tokens"))


@query()
def table_chunks(spark, sf):
    """A supplier's lines as a table whose rows are inlined and packed under its name: 256 tokens end a chunk, 512 are the most."""
    inlined = F.concat(F.lit("- order: "), "l_orderkey", F.lit("; line: "), "l_linenumber", F.lit("; part: "), "l_partkey", F.lit("; flag: "), "l_returnflag")
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", inlined.alias("row")))), lambda x: x["row"]).alias("rows"))
    rows = rows.join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    packed = rows.select("l_suppkey", "s_name", "rows", F.posexplode(core.greedy_pack(F.col("rows"), F.transform("rows", lambda r: texts.chunk_token_estimate(r)), 256, 512)).alias("chunk", "c"))
    body = F.concat_ws("\n", F.concat(F.lit("["), "s_name", F.lit("]")), F.array_join(F.slice("rows", F.col("c.first") + 1, F.col("c.last") - F.col("c.first") + 1), "\n"))
    return packed.select("l_suppkey", F.col("chunk").cast("long").alias("chunk"), F.md5(body).alias("body"))
