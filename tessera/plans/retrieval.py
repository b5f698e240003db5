"""Vector search, ranking, fusion, hydration, memory scoring and evaluation queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import core, text_index, vector_index
from ..sources import sinks
from ..sources.tables import table
from ._catalog import Register

query = Register()

#: Vectors in a block of the search and queries in a pack; partitions of the vectors (each meets every partition of the packs).
BLOCK, PACK, VECTOR_PARTS = 2048, 1024, 4


def _blocks(rows, size: int):
    """Vectors packed into blocks of at most ``size`` of one length, their norms divided out; a null vector has the length -1."""

    def pack(batches):
        for pdf in batches:
            dims = np.array([-1 if x is None else len(x) for x in pdf["embedding"]], dtype=np.int64)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for part in (at[k : k + size] for k in range(0, len(at), size)):
                    x = np.array([pdf["embedding"].iat[i] for i in part], dtype=np.float64) if dim > 0 else np.zeros((len(part), 0))
                    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
                    x = np.divide(x, norm, out=np.zeros_like(x), where=(norm > 0) & np.isfinite(norm))
                    labels = [None if v is None or v != v else int(v) for v in pdf["label"].iloc[part]]
                    yield pd.DataFrame({"dim": [int(dim)], "ids": [pdf["vec_id"].iloc[part].tolist()], "labels": [labels], "data": [x.tobytes()]})

    return sinks.kept(rows.select("vec_id", "label", "embedding").mapInPandas(pack, "dim int, ids array<long>, labels array<int>, data binary"), "blocks")


def _searched(spark, sf, k: int | None = None, by_label: bool = False, scoped: bool = False, least: float | None = None, itself: bool = True, among=None):
    """``q_id, label, vec_id, sim`` of the query set, every vector whose id is divisible by 20, against all vectors.

    Both sides meet block by block, so no task holds more than a block of each, and neither side is broadcast whole.
    With ``k`` a task keeps the best k of each of its queries, or of each query and label, over all blocks that it reads, and gives
    only those; the first k of all are among them, with labels only ``by_label``. ``scoped`` compares within a label, ``least`` is a threshold, ``itself`` keeps a query's own row, and
    ``among`` are the vectors searched if not all.
    """
    v = table(spark, sf, "embeddings")
    q = _blocks(v.where("vec_id % 20 = 0"), PACK).toDF("q_dim", "q_ids", "q_labels", "q_data").withColumn("pack", F.monotonically_increasing_id())

    def search(batches):
        best: dict[int, dict] = {}
        asked: dict[int, np.ndarray] = {}
        held = 0

        def rows(q_ids, label, ids, sims):
            at = sims >= (-np.inf if least is None else least)
            return pd.DataFrame({"q_id": q_ids[at], "label": pd.array(np.broadcast_to(label, len(ids))[at], dtype="Int32"), "vec_id": ids[at], "sim": sims[at]})

        def done():
            for pack, groups in best.items():
                for label, found in groups.items():
                    at, ids, sims = found.found()
                    yield rows(asked[pack][at], np.nan if label is None else float(label), ids, sims)
            best.clear()
            asked.clear()

        for pdf in batches:
            for dim, ids, labels, data, q_dim, q_ids, q_labels, q_data, pack in pdf.itertuples(index=False):
                ids, q_ids = np.asarray(ids, dtype=np.int64), np.asarray(q_ids, dtype=np.int64)
                labels, q_labels = (np.array([np.nan if x is None else x for x in a], dtype=np.float64) for a in (labels, q_labels))
                sims = np.zeros((len(q_ids), len(ids)))
                if dim == q_dim and dim > 0:
                    sims = np.frombuffer(q_data).reshape(len(q_ids), dim) @ np.frombuffer(data).reshape(len(ids), dim).T
                if scoped:
                    sims[q_labels[:, None] != labels] = -np.inf
                if not itself:
                    sims[q_ids[:, None] == ids] = -np.inf
                if k is None:
                    r, c = np.nonzero(sims > -np.inf if least is None else sims >= least - vector_index.SLACK)
                    yield rows(q_ids[r], labels[c], ids[c], np.round(sims[r, c], 6) + 0.0)
                    continue
                if held > vector_index.HELD:
                    yield from done()
                    held = 0
                groups, asked[pack] = best.setdefault(pack, {}), q_ids
                for label in np.unique(labels):  # one NaN for all nulls
                    at = np.flatnonzero(np.isnan(labels) if np.isnan(label) else labels == label) if by_label else np.arange(len(ids))
                    key = None if np.isnan(label) or not by_label else int(label)
                    if key not in groups:
                        groups[key] = vector_index.Best(np.full(len(q_ids), -np.inf), k)
                        held += 2 * k * len(q_ids)
                    groups[key].add(sims[:, at], ids[at])
                    if not by_label:
                        break
        yield from done()

    return _blocks(v if among is None else among, BLOCK).coalesce(VECTOR_PARTS).crossJoin(q).mapInPandas(search, "q_id long, label int, vec_id long, sim double")


SIM = "round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6)"
PAIRS = f"s AS (SELECT q.vec_id AS q_id, q.label AS q_label, v.vec_id, v.label, {SIM} AS sim FROM embeddings v, embeddings q WHERE q.vec_id % 20 = 0)"


def _top(by: str, k: int) -> str:
    return f"(SELECT q_id, label, vec_id, sim, row_number() OVER (PARTITION BY {by} ORDER BY sim DESC, vec_id) AS rank FROM s) WHERE rank <= {k}"



@query(f"WITH {PAIRS} SELECT q_id, vec_id, sim, rank FROM {_top('q_id', 15)}")
def knn_topk(spark, sf):
    near = _searched(spark, sf, 15).select("q_id", "vec_id", "sim")
    return core.top_k(near, ["q_id"], [F.desc("sim"), "vec_id"], 15)


@query(f"WITH {PAIRS} SELECT * FROM {_top('q_id, label', 5)}")
def knn_per_collection(spark, sf):
    return core.top_k(_searched(spark, sf, 5, by_label=True), ["q_id", "label"], [F.desc("sim"), "vec_id"], 5)


@query(f"WITH {PAIRS} SELECT q_id, vec_id, sim FROM s WHERE label = q_label AND sim >= 0.05")
def knn_threshold_scoped(spark, sf):
    return _searched(spark, sf, scoped=True, least=0.05).select("q_id", "vec_id", "sim")


@query(f"""WITH a AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY label), q AS (SELECT a.label AS anchor, e.embedding FROM a JOIN embeddings e USING (vec_id)),
s AS (SELECT v.vec_id, anchor, {SIM} AS sim FROM embeddings v, q), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, anchor) AS k FROM s)
SELECT vec_id, CASE WHEN sim >= 0.2 THEN anchor END AS tool, sim FROM r WHERE k = 1""")
def anchor_argmax(spark, sf):
    """Each vector's most similar anchor (one a label) if it reaches the threshold."""
    v = table(spark, sf, "embeddings")
    first = v.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    anchors = first.join(v.drop("label"), "vec_id").select(F.col("label").alias("anchor"), F.col("embedding").alias("q"))
    sims = v.crossJoin(anchors).withColumn("sim", F.round(scores.cosine(F.col("embedding"), F.col("q")), 6))
    best = sims.groupBy("vec_id").agg(F.max(F.struct("sim", (-F.col("anchor")).alias("a"))).alias("b"))
    return best.select("vec_id", F.when(F.col("b.sim") >= 0.2, -F.col("b.a")).cast("int").alias("tool"), F.col("b.sim").alias("sim"))


@query(f"""SELECT * FROM (SELECT q.vec_id AS fact_id, v.vec_id AS memory_id, {SIM} AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY {SIM} DESC, v.vec_id) AS rank
FROM embeddings q JOIN embeddings v ON q.label = v.label AND v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 AND {SIM} >= 0.1) WHERE rank <= 3""")
def fact_memory_join(spark, sf):
    """New facts against the memories of their scope: threshold and top 3; a fact isn't its own memory."""
    near = _searched(spark, sf, 3, scoped=True, least=0.1, itself=False)
    return core.top_k(near.select(F.col("q_id").alias("fact_id"), F.col("vec_id").alias("memory_id"), "sim"), ["fact_id"], [F.desc("sim"), "memory_id"], 3)


def _index(spark, sf) -> vector_index.VectorIndex:
    path = sinks.scratch(spark, "vectors")
    vector_index.build(table(spark, sf, "embeddings"), path, cell_rows=64)
    return vector_index.VectorIndex(spark, path)


@query(f"""SELECT * FROM (SELECT q.vec_id AS q_id, v.vec_id, {SIM} AS sim, row_number() OVER (PARTITION BY q.vec_id ORDER BY {SIM} DESC, v.vec_id) AS rank
FROM embeddings q JOIN embeddings v ON q.label = v.label WHERE q.vec_id % 20 = 0) WHERE rank <= 15""")
def indexed_knn(spark, sf):
    """The 15 nearest of each query within its label, through a stored index; the same rows as a search of everything."""
    found = _index(spark, sf).search(table(spark, sf, "embeddings").where("vec_id % 20 = 0"), 15)
    return found.select("q_id", F.col("id").alias("vec_id"), "sim", "rank")


@query(f"""WITH q AS (SELECT vec_id AS q_id, CASE WHEN vec_id % 40 = 0 THEN label + 1000 ELSE label END AS wanted, embedding FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q.q_id, v.vec_id, v.label = q.wanted AS fits, {SIM} AS sim, bool_or(v.label = q.wanted) OVER (PARTITION BY q.q_id) AS passed FROM q, embeddings v)
SELECT q_id, vec_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, vec_id) AS rank FROM s WHERE fits OR NOT passed) WHERE rank <= 5""")
def filtered_knn(spark, sf):
    """The 5 nearest that pass a query's filter; a filter that nothing passes, as that of every second query here, is dropped."""
    wanted = F.when(F.col("vec_id") % 40 == 0, F.col("label") + 1000).otherwise(F.col("label"))
    asked = table(spark, sf, "embeddings").where("vec_id % 20 = 0").withColumn("label", wanted)
    found = _index(spark, sf).search(asked, 5, relax=True)
    return found.select("q_id", F.col("id").alias("vec_id"), "sim", "rank")


@query("SELECT label AS collection, count(*) AS points, min(len(embedding))::BIGINT AS dim_low, max(len(embedding))::BIGINT AS dim_high FROM embeddings GROUP BY label")
def collection_status(spark, sf):
    v = table(spark, sf, "embeddings").withColumn("dim", F.size("embedding").cast("long"))
    return v.groupBy(F.col("label").alias("collection")).agg(F.count("*").alias("points"), F.min("dim").alias("dim_low"), F.max("dim").alias("dim_high"))


#: ``found(item_id, doc_id, score, rank)``: all documents for each benchmark text by the rarity and frequency of its words.
WORDS_SQL = """t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
wt AS (SELECT term, length(bin((SELECT count(DISTINCT doc_id) FROM documents) // count(*))) AS rarity FROM tf GROUP BY term),
qt AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM benchmark)),
sc AS (SELECT item_id, doc_id, sum(rarity * (10 * tf // (tf + 1)))::BIGINT AS score FROM qt JOIN tf USING (term) JOIN wt USING (term) GROUP BY ALL),
found AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM sc)"""


def by_words(spark, sf, k: int):
    """``item_id, doc_id, score, rank``: the k best documents for each benchmark text by its words, through a stored index."""
    path = sinks.scratch(spark, "words")
    text_index.build(table(spark, sf, "documents"), path, "doc_id", text.words(F.col("text")))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("q_id"), text.words(F.col("text")).alias("terms"))
    found = text_index.TextIndex(spark, path).search(asked, k)
    return found.select(F.col("q_id").alias("item_id"), F.col("id").alias("doc_id"), "score", "rank")


@query(f"WITH {WORDS_SQL} SELECT item_id, doc_id, score, rank FROM found WHERE rank <= 10")
def keyword_search(spark, sf):
    return by_words(spark, sf, 10)


# Words without weight and words of high value for the keyword score.
STOP = ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was"]
HIGH = ["license", "version"]
#: Words that count for others.
SYNONYMS = {"license": ["lizenz", "licence"], "tion": ["version", "sion"]}


def _keyword_sql(name: str, held: str) -> str:
    """``name(item_id, doc_id, kw)``: the keyword score of an expression over the documents in ``scored(item_id, doc_id)``."""
    there = lambda t: f"(contains(body, {t}) AND (contains({t}, ' ') OR length({t}) > 3 OR list_contains(bag, {t})))"
    pairs = [(w, o) for w, others in SYNONYMS.items() for o in others]
    some = " OR ".join(f"(t = '{w}' AND {there(chr(39) + o + chr(39))})" for w, o in pairs)
    high = " OR ".join(f"(t = '{w}' AND {there(chr(39) + o + chr(39))})" for w, o in pairs if o in HIGH) or "false"
    return f"""{name} AS (SELECT s.item_id, doc_id, round(least(1.0, coalesce(sum(CASE WHEN {there("t")} OR {some} THEN CASE WHEN {high} THEN 2.0 ELSE plain END ELSE 0 END), 0) / greatest(2.0, coalesce(sum(wt), 0))), 6)::DOUBLE AS kw
  FROM (SELECT item_id, doc_id, lower({held}) AS body, regexp_extract_all(lower({held}), '[\\p{{L}}\\p{{N}}_]+') AS bag FROM scored JOIN documents USING (doc_id)) s LEFT JOIN con USING (item_id) GROUP BY s.item_id, doc_id)"""


_RICH = [w for w, others in SYNONYMS.items() if set(others) & set(HIGH)]
_HEADING = "source || ' ' || lang || ' version'"
_GRAMS = f"""tok AS (SELECT item_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS t
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS w FROM benchmark)),
con AS (SELECT item_id, t, CASE WHEN t IN ('{"', '".join(HIGH)}') THEN 2.0 WHEN contains(t, ' ') THEN 1.5 ELSE 1.0 END AS plain, CASE WHEN t IN ('{"', '".join(HIGH + _RICH)}') THEN 2.0 WHEN contains(t, ' ') THEN 1.5 ELSE 1.0 END AS wt FROM tok WHERE t NOT IN ('{"', '".join(STOP)}'))"""


def _asked(gold):
    """``item_id, asked``: what each benchmark text asks for; a few texts, which every task gets."""
    return gold.select("item_id", text.keyword_content(F.col("text"), STOP).alias("asked"))


def _keywords(asked, held):
    return F.round(text.keyword_share(F.coalesce(asked, F.array().cast("array<string>")), held, HIGH, SYNONYMS), 6)


@query(f"WITH {WORDS_SQL}, scored AS (SELECT item_id, doc_id FROM found WHERE rank <= 15), {_GRAMS}, {_keyword_sql('kw', 'text')} SELECT item_id, doc_id, kw FROM kw")
def keyword_overlap(spark, sf):
    """The keyword score of the fifteen candidates of each benchmark text."""
    found = sinks.kept(by_words(spark, sf, 15).select("item_id", "doc_id"), "found")  # so that its size is known before texts are dealt
    docs = table(spark, sf, "documents").select("doc_id", "text").join(found, "doc_id").repartition(_parts(spark, sf), "item_id", "doc_id")
    rows = docs.select("item_id", "doc_id", text.keyword_words(F.col("text")).alias("held")).join(F.broadcast(_asked(table(spark, sf, "benchmark"))), "item_id")
    return rows.select("item_id", "doc_id", _keywords(F.col("asked"), F.col("held")).alias("kw"))


#: The text of a query vector: the benchmark texts in turn.
_HYBRID = f"""{_GRAMS}, {PAIRS}, asks AS (SELECT vec_id AS q_id, (vec_id // 20) % (SELECT max(item_id) + 1 FROM benchmark) AS item_id FROM embeddings WHERE vec_id % 20 = 0),
cand AS (SELECT * FROM {_top("q_id, label", 15)}), scored AS (SELECT DISTINCT item_id, vec_id AS doc_id FROM cand JOIN asks USING (q_id)), {_keyword_sql("kw", "text")}, {_keyword_sql("hd", _HEADING)},
hyb AS (SELECT q_id, vec_id AS doc_id, label, round(0.8 * sim + 0.1 * coalesce(kw.kw, 0) + 0.1 * (0.5 * coalesce(hd.kw, 0) + 0.5 * (d.lang = 'en')::INT) + 1e-9, 6) AS hybrid_score
  FROM cand JOIN asks USING (q_id) JOIN documents d ON d.doc_id = vec_id LEFT JOIN kw ON vec_id = kw.doc_id AND kw.item_id = asks.item_id LEFT JOIN hd ON vec_id = hd.doc_id AND hd.item_id = asks.item_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY q_id, label ORDER BY hybrid_score DESC, doc_id) AS rank FROM hyb)"""


def _parts(spark, sf) -> int:
    """Partitions of costly rows: by number, as by size they may be joined to one."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _hybrid(spark, sf):
    """Each query's candidates ranked within their label, by its own text; only candidates are scored."""
    near = core.top_k(_searched(spark, sf, 15, by_label=True), ["q_id", "label"], [F.desc("sim"), "vec_id"], 15, "k").withColumnRenamed("vec_id", "doc_id")
    gold = table(spark, sf, "benchmark")
    n = gold.agg((F.max("item_id") + 1).alias("n_items"))
    near = near.crossJoin(F.broadcast(n)).withColumn("item_id", F.floor(F.col("q_id") / 20) % F.col("n_items"))
    near = sinks.kept(near.select("doc_id", "item_id", "q_id", "label", "sim"), "near")
    low, high = near.agg(F.min("doc_id"), F.max("doc_id")).first()
    docs = table(spark, sf, "documents").where(F.col("doc_id").between(low, high)).select("doc_id", "text", "source", "lang")
    # a text is dealt and cut into words once for all that ask for it; rows go on without it
    asks = near.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "q_id", "label", "sim")).alias("asks")).repartition(_parts(spark, sf), "doc_id")
    docs = docs.repartition(_parts(spark, sf), "doc_id").join(asks, "doc_id")
    docs = docs.select("doc_id", "lang", F.md5("text").alias("text_key"), text.keyword_words(F.col("text")).alias("body"), text.keyword_words(F.concat("source", F.lit(" "), "lang", F.lit(" version"))).alias("head"), F.explode("asks").alias("ask"))
    rows = docs.select("doc_id", "lang", "text_key", "body", "head", "ask.*").join(F.broadcast(_asked(gold)), "item_id", "left")
    score = lambda c: F.coalesce(_keywords(F.col("asked"), F.col(c)), F.lit(0.0))
    hybrid = scores.lore_score(F.col("sim"), score("body"), score("head"), (F.col("lang") == "en").cast("int"))
    rows = rows.select("q_id", "doc_id", "label", "text_key", F.round(hybrid + 1e-9, 6).alias("hybrid_score"))  # exact halves go up in any order of summation
    return core.ranked(rows, ["q_id", "label"], [F.desc("hybrid_score"), "doc_id"])


@query(f"WITH {_HYBRID} SELECT q_id, doc_id, label, rank, hybrid_score FROM rk WHERE rank <= 5")
def hybrid_rerank(spark, sf):
    return _hybrid(spark, sf).where("rank <= 5").select("q_id", "doc_id", "label", "rank", "hybrid_score")


_FUSED = f"""{_HYBRID}, fus AS (SELECT q_id, min(r.doc_id) AS doc_id, round(sum(10.0 / (60 + rank) + hybrid_score), 6) AS rrf_score FROM rk r JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 5 GROUP BY q_id, md5(text)),
o AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rrf_score DESC, doc_id) AS rank FROM fus)"""


def _fused(spark, sf):
    rows = _hybrid(spark, sf).where("rank <= 5")
    return rows.groupBy("q_id", "text_key").agg(F.min("doc_id").alias("doc_id"), F.round(F.sum(scores.rrf_term(F.col("rank"), F.col("hybrid_score"))), 6).alias("rrf_score"))


@query(f"WITH {_FUSED} SELECT q_id, doc_id, rrf_score, rank FROM o WHERE rank <= 5")
def rrf_fusion(spark, sf):
    return core.top_k(_fused(spark, sf).select("q_id", "doc_id", "rrf_score"), ["q_id"], [F.desc("rrf_score"), "doc_id"], 5)


@query(f"""WITH {_FUSED}, c AS (SELECT q_id, rank, o.doc_id, rrf_score, length(text) // 2 AS tokens, sum(length(text) // 2) OVER (PARTITION BY q_id ORDER BY rank) AS cum FROM o JOIN documents d ON d.doc_id = o.doc_id WHERE rank <= 20)
SELECT q_id, rank, doc_id, rrf_score, tokens::BIGINT AS tokens, cum::BIGINT AS cum_tokens FROM c WHERE cum <= 3500 OR rank = 1""")
def retrieve_pack(spark, sf):
    """Search, hybrid rank, fusion, hydration and budget packing in one plan."""
    best = core.top_k(_fused(spark, sf).select("q_id", "doc_id", "rrf_score"), ["q_id"], [F.desc("rrf_score"), "doc_id"], 20)
    docs = table(spark, sf, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))
    packed = core.prefix_pack(docs.join(best, "doc_id"), ["q_id"], ["rank"], "tokens", 3500, first_exempt=True)
    return packed.select("q_id", "rank", "doc_id", "rrf_score", "tokens", F.col("cum").alias("cum_tokens"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
k AS (SELECT *, CASE WHEN n <= 2 OR rn % 2 = 1 THEN rn ELSE 2 * n + 2 - rn END AS key FROM r)
SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY key) AS place FROM k""")
def u_curve_order(spark, sf):
    return core.u_curve(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])


@query("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank = 1")
def first_child_per_parent(spark, sf):
    return core.top_k(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 1).select("o_custkey", "o_orderkey", "rank")


_MEMORY = """m AS (SELECT o_custkey AS user_id, o_orderkey AS memory_id, least(1.0, CASE WHEN o_orderpriority LIKE '1%' THEN 0.6 + 0.2 WHEN o_orderpriority LIKE '2%' THEN 0.6 + 0.1 ELSE 0.4 END)::DOUBLE AS importance,
  epoch((SELECT max(o_orderdate) FROM orders)) - epoch(o_orderdate) AS age, (o_orderkey % 100) / 100.0::DOUBLE AS sim FROM orders),
s AS (SELECT user_id, memory_id, round(0.60 * sim + 0.20 * greatest(0.01, least(1.0, exp(-(CASE WHEN importance >= 0.8 THEN 0.005 WHEN importance >= 0.5 THEN 0.025 ELSE 0.10 END) * age / 86400.0))) + 0.15 * importance + 0.05 * 0.5, 6) AS score FROM m)"""


@query(f"WITH {_MEMORY} SELECT user_id, memory_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, memory_id) AS rank FROM s) WHERE rank <= 5")
def memory_decay_topk(spark, sf):
    """Orders as memories: tier boost, recency decay, weighted score, top 5 a user."""
    o = table(spark, sf, "orders")
    now = o.agg(F.max("o_orderdate").alias("now"))
    tier = F.when(F.col("o_orderpriority").startswith("1"), "critical").when(F.col("o_orderpriority").startswith("2"), "personal").otherwise("other")
    base = F.when(tier == "other", 0.4).otherwise(0.6)
    rows = o.crossJoin(F.broadcast(now)).withColumn("importance", scores.boosted(base, tier))
    age = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    sim = (F.col("o_orderkey") % 100) / 100.0
    score = scores.memory_score(sim, scores.recency(F.col("importance"), age), F.col("importance"), F.lit(0.5))
    rows = rows.select(F.col("o_custkey").alias("user_id"), F.col("o_orderkey").alias("memory_id"), F.round(score, 6).alias("score"))
    return core.top_k(rows, ["user_id"], [F.desc("score"), "memory_id"], 5)


@query("""SELECT o_orderkey AS memory_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority LIKE '1%' ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
WHERE n > 10 AND NOT o_orderpriority LIKE '1%' AND rn <= n - 10""")
def prune_cap(spark, sf):
    """The least important non-critical memories of users over the cap of 10."""
    o = table(spark, sf, "orders").withColumn("critical", F.col("o_orderpriority").startswith("1"))
    sizes = o.groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 10")
    rows = core.ranked(o.join(sizes, "o_custkey").where("not critical"), ["o_custkey"], ["o_totalprice", "o_orderkey"], "rn")
    return rows.where("rn <= n - 10").select(F.col("o_orderkey").alias("memory_id"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT coalesce(l_shipdate + INTERVAL 1 YEAR < (SELECT max(l_shipdate) FROM lineitem), false)")
def expired_filter(spark, sf):
    """Rows whose expiry isn't before now; a null expiry passes."""
    li = table(spark, sf, "lineitem")
    now = li.agg(F.max("l_shipdate").alias("now"))
    gone = F.expr("l_shipdate + interval 1 year") < F.col("now")
    return li.crossJoin(F.broadcast(now)).where(~F.coalesce(gone, F.lit(False))).select("l_orderkey", "l_linenumber")


#: Words of a passage that make its question, and how many results count.
ASKED, RESULTS = 8, 5
_W = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')"
_PAIRS = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
_GOLD = f"""g AS (SELECT item_id, text AS gold, {_W}[1:{ASKED}] AS w FROM benchmark), gk AS (SELECT item_id, unnest({_PAIRS}) AS k FROM g),
dw AS (SELECT doc_id, {_W} AS w FROM documents), dk AS (SELECT doc_id, unnest({_PAIRS}) AS k FROM dw),
cand AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY count(*) DESC, doc_id) AS rank FROM gk JOIN dk USING (k) GROUP BY item_id, doc_id),
hit AS (SELECT g.item_id, min(CASE WHEN contains(d.text, g.gold) THEN rank END) AS first_rank FROM g LEFT JOIN (SELECT * FROM cand WHERE rank <= {RESULTS}) c USING (item_id) LEFT JOIN documents d USING (doc_id) GROUP BY g.item_id)"""


def gold_candidates(gold, docs):
    """``item_id, doc_id, score, rank``: the documents that come back for a passage's first words.

    The retriever knows nothing of the rest of the passage: it ranks by how many of the question's word pairs a document has. Both
    sides are exploded into word pairs once and meet in an equi-join.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))
    pairs = lambda w: F.explode(F.array_distinct(text.ngrams(w, 2))).alias("k")
    asked = gold.select("item_id", F.slice(words("gold"), 1, ASKED).alias("w")).select("item_id", pairs(F.col("w")))
    held = docs.select("doc_id", words("text").alias("w")).select("doc_id", pairs(F.col("w")))
    score = held.join(asked, "k").groupBy("item_id", "doc_id").agg(F.count("*").alias("score"))
    return core.top_k(score, ["item_id"], [F.desc("score"), "doc_id"], RESULTS)


def gold_ranks(gold, docs):
    """``item_id, first_rank``: the rank at which a document that holds the passage comes back, null beyond the results.

    The text is read only of the documents that are returned.
    """
    best = gold_candidates(gold, docs)
    shown = docs.select("doc_id", "text").join(best, "doc_id").join(gold, "item_id")
    first = shown.groupBy("item_id").agg(F.min(F.when(F.contains("text", "gold"), F.col("rank"))).alias("first_rank"))
    return gold.select("item_id").join(first, "item_id", "left")


def _gold_hits(spark, sf):
    return gold_ranks(table(spark, sf, "benchmark").select("item_id", F.col("text").alias("gold")), table(spark, sf, "documents"))


@query(f"""WITH {_GOLD} SELECT count(*) AS n, round(avg((coalesce(first_rank <= 1, false))::INT), 6) AS hit_1, round(avg((coalesce(first_rank <= 5, false))::INT), 6) AS hit_5,
round(avg(coalesce(1.0 / first_rank, 0)), 6)::DOUBLE AS mrr FROM hit""")
def hit_at_k_mrr(spark, sf):
    hit = lambda k: F.round(F.avg(F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("int")), 6)
    return _gold_hits(spark, sf).agg(F.count("*").alias("n"), hit(1).alias("hit_1"), hit(5).alias("hit_5"), F.round(F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))), 6).alias("mrr"))


@query(f"WITH {_GOLD} SELECT item_id % 4 AS category, count(*) AS n, round(avg((coalesce(first_rank <= 5, false))::INT), 6) AS recall_5, avg((coalesce(first_rank <= 5, false))::INT) >= 0.95 AS passed FROM hit GROUP BY 1")
def recall_by_category(spark, sf):
    share = F.avg(F.coalesce(F.col("first_rank") <= 5, F.lit(False)).cast("int"))
    return _gold_hits(spark, sf).groupBy((F.col("item_id") % 4).alias("category")).agg(F.count("*").alias("n"), F.round(share, 6).alias("recall_5"), (share >= 0.95).alias("passed"))


@query("""WITH w(cfg, a, b) AS (VALUES (1, 0.8, 0.2), (2, 0.6, 0.4), (3, 0.5, 0.5)), t(th) AS (VALUES (100000.0), (150000.0), (200000.0), (250000.0)),
s AS (SELECT cfg, th, avg((a * o_totalprice + b * o_custkey >= th)::INT) AS hit FROM orders, w, t GROUP BY cfg, th)
SELECT cfg, th::DOUBLE AS th, round(0.5 * hit + 0.5 * hit * hit, 6) AS score FROM s ORDER BY round(0.5 * hit + 0.5 * hit * hit, 6) DESC, cfg, th LIMIT 3""")
def grid_search(spark, sf):
    """Composite score of each weight set and threshold over all rows; both grids are literal tables."""
    grid = spark.createDataFrame([(1, 0.8, 0.2), (2, 0.6, 0.4), (3, 0.5, 0.5)], "cfg int, a double, b double").crossJoin(spark.createDataFrame([(float(x),) for x in (100_000, 150_000, 200_000, 250_000)], "th double"))
    rows = table(spark, sf, "orders").crossJoin(F.broadcast(grid))
    hit = rows.groupBy("cfg", "th").agg(F.avg((F.col("a") * F.col("o_totalprice") + F.col("b") * F.col("o_custkey") >= F.col("th")).cast("int")).alias("hit"))
    return hit.select("cfg", "th", F.round(0.5 * F.col("hit") + 0.5 * F.col("hit") ** 2, 6).alias("score")).orderBy(F.desc("score"), "cfg", "th").limit(3)
