"""Text expressions: sizes, keys, tokens and markup, all evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of object identifiers for name-based UUIDs (fixed value).
OID_NAMESPACE = "6ba7b8129dad11d180b400c04fd430c8"


def token_estimate(text: Column) -> Column:
    """Half the characters, rounded down."""
    return F.floor(F.length(text) / 2).cast("long")


def chunk_token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 1.3)).cast("long")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit("[^ \\t\\n]+"), F.lit(0))).cast("long")


def slug(text: Column, default: str = "untitled") -> Column:
    """Lower case, word characters only, runs of blanks and dashes as one underscore."""
    kept = F.regexp_replace(F.trim(F.lower(text)), "[^\\p{L}\\p{N}_ -]", "")
    return F.coalesce(F.nullif(F.regexp_replace(kept, "[ -]+", "_"), F.lit("")), F.lit(default))


def normal_name(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), "[^\\p{L}\\p{N} ]", "")


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def uuid5(name: Column, namespace: str = OID_NAMESPACE) -> Column:
    """The name-based UUID, version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    variant = F.substring(F.lit("89ab" * 4), digit + 1, F.lit(1))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def words(text: Column, least: int = 2) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"[\\p{{L}}\\p{{N}}_]{{{least},}}"), F.lit(0))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n neighbouring tokens joined by a blank."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))


def query_tokens(text: Column) -> Column:
    """Words, pairs and triples, with repeats."""
    w = words(text)
    return F.concat(w, ngrams(w, 2), ngrams(w, 3))


def keyword_words(text: Column) -> Column:
    """The text in lower case and its words, as ``keyword_share`` needs them."""
    return F.struct(F.lower(text).alias("body"), words(text, 1).alias("bag"))


def keyword_content(query: Column, stop: list[str]) -> Column:
    return F.filter(query_tokens(query), lambda t: ~t.isin(stop))


def keyword_score(query: Column, text: Column, stop: list[str], high: list[str], synonyms: dict[str, list[str]] | None = None) -> Column:
    """``keyword_share`` of a query's and a text's own words."""
    # an array of one struct, so that the text is lower-cased and cut into words once and not for every token
    both = F.array(F.struct(keyword_words(text).alias("held"), keyword_content(query, stop).alias("content")))
    return F.get(F.transform(both, lambda b: keyword_share(b["content"], b["held"], high, synonyms)), F.lit(0))


def keyword_share(content: Column, held: Column, high: list[str], synonyms: dict[str, list[str]] | None = None) -> Column:
    """Weighted share of the query's tokens that the text holds itself or by a synonym, at most 1.

    Words of the high-value list weigh 2, phrases 1.5, others 1. A short word counts only as a whole word. A word with a high-value
    synonym is expected to weigh 2, and does if that synonym is there.
    """
    synonyms = synonyms or {}
    rich = [w for w, others in synonyms.items() if set(others) & set(high)]
    plain = lambda t: F.when(t.isin(high), 2.0).when(F.instr(t, " ") > 0, 1.5).otherwise(1.0)
    expected = lambda t: F.when(t.isin(rich), 2.0).otherwise(plain(t))
    total = lambda a, weight: F.aggregate(a, F.lit(0.0), lambda s, t: s + weight(t))

    there = lambda t: F.contains(held["body"], t) & ((F.instr(t, " ") > 0) | (F.length(t) > 3) | F.array_contains(held["bag"], t))

    def any_there(t: Column, pick) -> Column:
        out = F.lit(False)
        for word, others in synonyms.items():
            for other in filter(pick, others):
                out = out | ((t == word) & there(F.lit(other)))
        return out

    given = lambda t: F.when(any_there(t, lambda o: o in high), 2.0).otherwise(plain(t))
    found = F.filter(content, lambda t: there(t) | any_there(t, lambda o: True))
    return F.least(F.lit(1.0), total(found, given) / F.greatest(F.lit(2.0), total(content, expected)))


def sentences(text: Column) -> Column:
    """Cut after ``.``, ``!`` or ``?`` before an upper-case letter or digit."""
    return F.split(F.regexp_replace(text, "([.!?])[ \\n]+([\\p{Lu}\\p{N}])", "$1\u0001$2"), "\u0001")


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "<title>([^<]*)</title>", 1))


def html_text(html: Column) -> Column:
    """Text without scripts, styles, comments, tags and runs of blanks."""
    bare = html
    for pattern in ("(?s)<script[^>]*>.*?</script>", "(?s)<style[^>]*>.*?</style>", "(?s)<!--.*?-->", "<[^>]*>"):
        bare = F.regexp_replace(bare, pattern, " ")
    return F.trim(F.regexp_replace(bare, "[ \\t\\n\\r]+", " "))


def content_type(text: Column) -> Column:
    """``empty``, ``table``, ``dialogue``, ``list``, ``mixed`` or ``prose`` by the shape of the lines."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    share = lambda p: F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(p)))) / F.greatest(F.lit(1), F.size(lines))
    spoken = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit("^[\\p{L} ]{1,30}: "))))
    listed = share("^ *[*-] ")
    return (
        F.when(F.size(lines) == 0, "empty").when(F.contains(text, F.lit(" | ")), "table").when(spoken >= 2, "dialogue")
        .when(listed >= 0.5, "list").when(listed > 0, "mixed").otherwise("prose")
    )
