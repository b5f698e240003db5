"""Quality rules: text counts plus distribution divergence from a language reference.

All work is DataFrame expressions. A first pass turns each text into counts, a character-class
histogram and a histogram over its language's common words; the histograms of all other documents of
a language are summed into its reference, and a document is kept if both of its
Jensen-Shannon distances (base 2) stay within limits. Guards: a histogram of fewer than
``MIN_CHARS`` characters or ``MIN_WORDS`` words isn't judged, and none against a reference that isn't ten times as large.

Nulls: a null text counts as empty (no words, so ``base_failed``); a null language forms a
group of its own with no common words. Repeated rows are judged alike. An empty table gives no rows.
Input columns named like an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SEPARATOR_RUN, WORD_SEPARATORS, group_key, staged, without

# Frequent function words by language.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for", "was", "on", "with", "as", "be", "by"),
    "fr": ("de", "la", "le", "et", "les", "en", "des", "un", "du", "une", "que", "est", "pour", "par", "dans", "qui"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "sich", "mit", "des", "auf", "für", "ist", "im", "nicht"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "las", "se", "del", "un", "por", "con", "no", "una", "su"),
}
N_COMMON = 16
#: Character classes, each removed in turn from what is left of the text.
CLASSES = (("lower", "\\p{Ll}+"), ("space", SEPARATOR_RUN), ("upper", "\\p{Lu}+"), ("stop", "[.,;:!?'\"()-]+"), ("digit", "\\p{Nd}+"))
WINDOW = 8
MIN_CHARS, MIN_WORDS, MIN_REFERENCE = 200, 50, 10
MAX_CLASS_DISTANCE, MAX_WORD_DISTANCE = 0.22, 0.3
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
OUTPUT = (*BASE, "class_distance", "word_distance", "kept")
SCRATCH = ("text_", "words_", "windows_", "sorted_", "marked_", "class_hist", "word_hist", *[f"left_{n}" for n, _ in CLASSES])


def text_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Adds the base columns, ``class_hist`` and ``word_hist`` (arrays of long)."""
    df = without(docs, (*OUTPUT, *SCRATCH)).withColumn("text_", F.coalesce(F.col(text_col), F.lit("")))
    left = "text_"
    for name, pattern in CLASSES:
        df = df.withColumn(f"left_{name}", F.regexp_replace(left, pattern, ""))
        left = f"left_{name}"
    trimmed = F.btrim("text_", F.lit(WORD_SEPARATORS))
    df = df.withColumn("words_", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SEPARATOR_RUN, -1)))
    hashes = F.transform("words_", lambda w: F.xxhash64(w))
    df = df.withColumn("n_words", F.size("words_").cast("long")).withColumn("windows_", hashes)
    starts = F.sequence(F.lit(1), F.size("windows_") - (WINDOW - 1))
    df = df.withColumn(
        "windows_",
        F.when(F.col("n_words") > WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("windows_", i, WINDOW)))),
    )
    repeats = F.size(F.array_distinct("windows_")) < F.size("windows_")
    df = df.withColumn("sorted_", F.when(repeats, F.sort_array(F.transform("windows_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda s, j: (F.get("sorted_", j - 1)["h"] == s["h"]) | (F.get("sorted_", j + 1)["h"] == s["h"])
    df = df.withColumn("marked_", F.sort_array(F.transform(F.filter("sorted_", lambda s, j: F.coalesce(twin(s, j), F.lit(False))), lambda s: s["i"])))
    covered = F.aggregate(
        "marked_",
        F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split("text_", "\n", -1), lambda x: F.btrim(x, F.lit(WORD_SEPARATORS)) != "")
    size = lambda a, b: (F.length(a) - F.length(b)).cast("long")
    common = sorted({w for words in COMMON_WORDS.values() for w in words})
    own = F.lit(None).cast("array<string>")
    for lang, words in COMMON_WORDS.items():
        own = F.when(F.col(lang_col) == lang, F.array(*[F.lit(w) for w in words])).otherwise(own)
    before = dict(zip((n for n, _ in CLASSES), ("text_", *[f"left_{n}" for n, _ in CLASSES])))
    df = df.withColumns(
        {
            "word_chars": size("text_", "left_lower") + F.length("left_space"),
            "n_symbols": F.length(F.regexp_replace("left_digit", "[^#*$%&|<>]+", "")).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
            "class_hist": F.array(*[size(before[n], f"left_{n}") for n, _ in CLASSES], F.length("left_digit").cast("long")),
            "sorted_": F.filter("words_", lambda w: w.isin(common)),
            "marked_": own,
        }
    )
    counts = F.transform("marked_", lambda c: F.size(F.filter("sorted_", lambda w: w == c)).cast("long"))
    df = df.withColumn("word_hist", counts)
    total = F.aggregate("word_hist", F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("word_hist", F.concat("word_hist", F.array(F.col("n_words") - total)))
    df = df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
    return df.drop(*[c for c in SCRATCH if c not in ("class_hist", "word_hist")])


def references(counted: DataFrame, lang_col: str = "lang") -> DataFrame:
    """Summed histograms by language: ``lang_key, class_ref, word_ref``."""
    sums = lambda col, n: F.array(*[F.sum(F.get(col, F.lit(i))).cast("double") for i in range(n)])
    return counted.groupBy(group_key(lang_col).alias("lang_key")).agg(
        sums("class_hist", len(CLASSES) + 1).alias("class_ref"), sums("word_hist", N_COMMON + 1).alias("word_ref")
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two count arrays; null if either is null or sums to 0."""
    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    scaled = lambda a: F.transform(a, lambda x: x / F.nullif(add(a), F.lit(0.0)))
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    parts = F.zip_with(scaled(p), scaled(q), lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
    total = add(parts)
    return F.sqrt(F.when(total < 0, F.lit(0.0)).otherwise(total))


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", keep_text: bool = True) -> DataFrame:
    """``docs`` with the base columns, both distances and ``kept``.

    The counts of pass one are staged in the shared folder (with the text only if asked
    for); the references are one row a language, joined by Spark's choice.
    """
    counted = text_counts(docs, text_col, lang_col)
    counted = staged(counted if keep_text else counted.drop(text_col), "quality")
    refs = staged(references(counted, lang_col), "references")
    joined = counted.withColumn("lang_key", group_key(lang_col)).join(refs, "lang_key", "left")
    doubles = lambda c: F.transform(c, lambda x: x.cast("double"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)

    def distance(hist: str, ref: str, least: int) -> Column:
        own = doubles(hist)
        others = F.zip_with(ref, own, lambda a, x: a - x)
        fits = F.get(hist, F.lit(0)).isNotNull() & (total(own) >= least) & (total(others) >= MIN_REFERENCE * least)
        return F.when(fits, F.round(js_distance(own, others), 6))

    judged = joined.withColumns({"class_distance": distance("class_hist", "class_ref", MIN_CHARS), "word_distance": distance("word_hist", "word_ref", MIN_WORDS)})
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("class_distance") > MAX_CLASS_DISTANCE, F.lit(False)) & ~F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    return judged.withColumn("kept", kept).drop("lang_key", "class_ref", "word_ref", "class_hist", "word_hist")


def op4_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return quality_rules(docs, keep_text=False).select("doc_id", *OUTPUT)


def _oracle() -> str:
    words = "regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')"
    before, steps = "t", []
    for name, pattern in CLASSES:
        steps.append(f"r_{name} AS (SELECT *, regexp_replace({before}, '{pattern.replace(chr(39), chr(39) * 2)}', '', 'g') AS left_{name} FROM {'w' if before == 't' else 'r_' + before[5:]})")
        before = f"left_{name}"
    froms = ["t", *[f"left_{n}" for n, _ in CLASSES]]
    hist = ", ".join([f"length({a}) - length({b})" for a, b in zip(froms, froms[1:])] + [f"length({before})"])
    common = " ".join(f"WHEN '{lang}' THEN [{', '.join(repr(x) for x in found)}]" for lang, found in COMMON_WORDS.items())
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i + 1}])" for i in range(n)) + "]"

    def distance(own: str, ref: str, least: int) -> str:
        p, q = f"x / list_sum({own})", f"({ref}[i] - x) / (list_sum({ref}) - list_sum({own}))"
        term = lambda a: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({p} + {q}) / 2)) ELSE 0.0 END"
        total = f"list_sum(list_transform({own}, lambda x, i: ({term(p)} + {term(q)}) / 2))"
        return f"CASE WHEN list_sum({own}) >= {least} AND list_sum({ref}) - list_sum({own}) >= {MIN_REFERENCE * least} THEN round(sqrt(greatest(0.0, {total})), 6) END"

    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents), w AS (SELECT *, {words} AS w FROM d),
{', '.join(steps)},
c AS (SELECT *, len(w) AS n_words, [{hist}] AS class_hist, CASE lang {common} END AS common FROM r_{CLASSES[-1][0]}),
h AS (SELECT *, list_transform(common, lambda c: len(list_filter(w, lambda x: x = c))) AS found FROM c),
g AS (SELECT *, list_append(found, n_words - list_sum(found)) AS word_hist, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM h),
v AS (SELECT rid, s, md5(array_to_string(w[s:s + {WINDOW - 1}], ' ')) AS m FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS s FROM w WHERE len(w) > {WINDOW})),
r AS (SELECT rid, s FROM (SELECT rid, s, count(*) OVER (PARTITION BY rid, m) AS n FROM v) WHERE n > 1),
p AS (SELECT rid, sum(least({WINDOW}, s - before)) AS n FROM (SELECT rid, s, coalesce(lag(s) OVER (PARTITION BY rid ORDER BY s), -{WINDOW}) AS before FROM r) GROUP BY rid),
f AS (SELECT coalesce('=' || lang, 'null') AS k, {sums('class_hist', len(CLASSES) + 1)} AS class_ref, {sums('word_hist', N_COMMON + 1)} AS word_ref FROM g GROUP BY 1),
b AS (SELECT doc_id, n_words::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words,
  {distance('class_hist', 'class_ref', MIN_CHARS)}::DOUBLE AS class_distance, {distance('word_hist', 'word_ref', MIN_WORDS)}::DOUBLE AS word_distance
  FROM g JOIN f ON coalesce('=' || lang, 'null') = k LEFT JOIN p USING (rid)),
e AS (SELECT * REPLACE (coalesce(word_chars, 0) AS word_chars), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT *, NOT base_failed AND NOT coalesce(class_distance > {MAX_CLASS_DISTANCE}, false) AND NOT coalesce(word_distance > {MAX_WORD_DISTANCE}, false) AS kept FROM e"""


ORACLE_SQL = {"op4_quality_rules": _oracle()}
