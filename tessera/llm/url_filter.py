"""URL filter: prefix rules first, then an empirical-Bayes reputation of the host.

Labelled page outcomes (good or bad) are summed by host, registered domain and suffix.
Each level is a beta-binomial. A group's prior mean is its parent's posterior mean without the group's own outcomes, and the
prior strength of a level is fitted by moments about those means: where hosts are like their domains, sparse hosts take their domain's
word. A page whose host is unseen takes its domain's posterior, then its suffix's, then the global one. A page is allowed if the lower posterior bound
(mean minus ``z`` standard deviations) reaches ``threshold``.

Nulls: a null url, or one without ``://``, has empty host and path and the empty suffix; null
outcomes are not counted. Repeated pages are judged alike. Several outcomes for
one page all count. Empty pages give no rows; with no outcomes the prior is 1 good of 2.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import staged, without

#: The contract's rules, as (verdict, rule).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Z, THRESHOLD = 1.6448536, 0.5
LEVELS = ("suffix", "domain", "host")
#: Second labels that belong to the suffix before a country's two letters, as in ``co.uk``.
SHARED_SUFFIX = "(^|[.])(ac|co|com|edu|gov|net|org)[.][a-z][a-z]$"
#: Strength where no group has two outcomes, and its bounds, in outcomes.
STRENGTH, WEAKEST, STRONGEST = 20.0, 2.0, 200.0


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract reads them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def with_site(df: DataFrame) -> DataFrame:
    """Adds ``suffix`` (the last label, or two as in ``co.uk``) of ``host`` and ``domain``, the suffix with the label before it."""
    shared = F.regexp_like("host", F.lit(SHARED_SUFFIX))
    last = lambda n: F.substring_index("host", ".", -n)
    return df.withColumn("domain", F.when(shared, last(3)).otherwise(last(2))).withColumn("suffix", F.when(shared, last(2)).otherwise(last(1)))


def reputation(sites: DataFrame) -> dict[str, DataFrame]:
    """Posteriors ``keys, a, b, mean`` by level from ``sites(host, domain, suffix, good long, seen long)``. One row of sums a level reaches the driver."""
    total = sites.agg(F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("seen"), F.lit(0)).alias("seen")).first()
    tables: dict[str, DataFrame] = {}
    good, seen = F.col("good"), F.col("seen")
    for k, level in enumerate(LEVELS):
        keys = [*LEVELS[: k + 1]]
        sums = sites.groupBy(*keys).agg(F.sum("good").alias("good"), F.sum("seen").alias("seen"))
        if k:
            joined = sums.join(tables[LEVELS[k - 1]].select(*keys[:-1], F.col("a").alias("pa"), F.col("b").alias("pb")), keys[:-1])
        else:
            joined = sums.withColumns({"pa": F.lit(total["good"] + 1.0), "pb": F.lit(total["seen"] - total["good"] + 1.0)})
        joined = joined.withColumn("prior", (F.col("pa") - good) / (F.col("pa") + F.col("pb") - seen)).drop("pa", "pb")
        noise = F.col("prior") * (1 - F.col("prior"))
        away = seen * F.pow(good / seen - F.col("prior"), F.lit(2.0))
        spread = joined.where("seen > 0").agg(F.sum(away).alias("squares"), F.sum(noise).alias("noise"), F.sum(noise * (seen - 1)).alias("room")).first()
        strength = STRENGTH
        if spread["room"]:
            excess = (spread["squares"] - spread["noise"]) / spread["room"]  # 1 / (strength + 1) in a beta-binomial
            strength = min(STRONGEST, max(WEAKEST, 1 / excess - 1)) if excess > 0 else STRONGEST
        a = F.col("prior") * F.lit(strength) + good
        b = (1 - F.col("prior")) * F.lit(strength) + seen - good
        tables[level] = joined.withColumn("a", a).withColumn("b", b).withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))).select(*keys, "a", "b", "mean")
    return tables


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, z: float = Z, threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with ``host, path, rule, verdict`` and the reputation's ``good_mean, good_bound``.

    ``outcomes(page_id, good int)`` may hold any number of rows for a page. A host row exists for
    every host of ``pages``, so the last join is by host alone; the host table is joined by
    Spark's choice of strategy and a hot host is split by AQE.
    """
    host, path = url_parts(F.col("url"))
    base = with_site(
        without(pages, ("host", "path", "rule", "verdict", "domain", "suffix", "good_mean", "good_bound", "good", "seen"))
        .withColumn("host", host)
        .withColumn("path", path)
    )
    judged = (
        base.select("page_id", *LEVELS)
        .join(outcomes.where("good is not null").select("page_id", F.col("good").cast("long").alias("good")), "page_id")
        .groupBy(*LEVELS)
        .agg(F.sum("good").alias("good"), F.count("*").alias("seen"))
    )
    unseen = base.select(*LEVELS).distinct().withColumns({"good": F.lit(0).cast("long"), "seen": F.lit(0).cast("long")})
    sites = staged(judged.unionByName(unseen).groupBy(*LEVELS).agg(F.sum("good").alias("good"), F.sum("seen").alias("seen")), "sites")
    hosts = reputation(sites)["host"]
    total = F.col("a") + F.col("b")
    bound = F.col("mean") - F.lit(z) * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    hosts = hosts.select("host", F.col("mean").alias("good_mean"), bound.alias("good_bound"))
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    return (
        base.join(hosts, "host", "left")
        .withColumn("rule", rule)
        .withColumn("verdict", F.coalesce(verdict, F.when(F.col("good_bound") >= threshold, "allow").otherwise("block")))
        .drop("domain", "suffix")
    )


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    """Outcomes: a page whose id is labelled in ``labels`` is good if quality is 1 and toxic 0."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    return filter_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def _level_sql(name: str, keys: list[str], above: str | None) -> str:
    on = " AND ".join(f"s.{k} = p.{k}" for k in keys[:-1])
    cols = ", ".join(keys)
    return f"""
{name}_s AS (SELECT {cols}, sum(good)::DOUBLE AS good, sum(seen)::DOUBLE AS seen FROM sites GROUP BY {cols}),
{name}_m AS (SELECT s.*, (p.a - s.good) / (p.a + p.b - s.seen) AS prior FROM {name}_s s {f"JOIN {above}_p p ON {on}" if above else "CROSS JOIN g p"}),
{name}_v AS (SELECT sum(seen * pow(good / seen - prior, 2)) AS squares, sum(prior * (1 - prior)) AS noise, sum(prior * (1 - prior) * (seen - 1)) AS room FROM {name}_m WHERE seen > 0),
{name}_k AS (SELECT CASE WHEN room > 0 THEN CASE WHEN squares > noise THEN least({STRONGEST}, greatest({WEAKEST}, room / (squares - noise) - 1)) ELSE {STRONGEST} END ELSE {STRENGTH} END AS k FROM {name}_v),
{name}_t AS (SELECT {cols}, prior * k + good AS a, (1 - prior) * k + seen - good AS b FROM {name}_m, {name}_k),
{name}_p AS (SELECT *, a / (a + b) AS mean FROM {name}_t)"""


def _oracle() -> str:
    when = "".join(
        f"\n  WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{{{i}}}'"
        for i, (_, t) in enumerate(sorted(RULES, key=lambda r: -len(r[1])))
    )
    ordered = sorted(RULES, key=lambda r: -len(r[1]))
    rule = when.format(*[t for _, t in ordered])
    verdict = when.format(*[v for v, _ in ordered])
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
base AS (SELECT page_id, host, path, array_to_string(p[-n - 1:], '.') AS domain, array_to_string(p[-n:], '.') AS suffix
  FROM (SELECT *, string_split(host, '.') AS p, CASE WHEN regexp_matches(host, '{SHARED_SUFFIX}') THEN 2 ELSE 1 END AS n FROM h)),
sites AS (SELECT host, domain, suffix, coalesce(sum(CASE WHEN quality IS NULL OR toxic IS NULL THEN NULL WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END), 0) AS good,
  count(CASE WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 1 END) AS seen FROM base LEFT JOIN labels ON page_id = doc_id GROUP BY ALL),
g AS (SELECT coalesce(sum(good), 0)::DOUBLE + 1 AS a, coalesce(sum(seen) - sum(good), 0)::DOUBLE + 1 AS b FROM sites),
{_level_sql("suffix", ["suffix"], None)},
{_level_sql("domain", ["suffix", "domain"], "suffix")},
{_level_sql("host", ["suffix", "domain", "host"], "domain")}
SELECT page_id, base.host, path, CASE {rule} ELSE NULL END AS rule,
  CASE {verdict} WHEN mean - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) >= {THRESHOLD} THEN 'allow' ELSE 'block' END AS verdict
FROM base JOIN host_p USING (host)"""


ORACLE_SQL = {"op7_url_filter": _oracle().replace("WHEN (host =", "WHEN (base.host =").replace("ends_with(host,", "ends_with(base.host,")}
