"""A stored inverted index with impact-ordered postings, and a top-k search that leaves most postings of common terms unread.

An impact is a whole number: the term's rarity times its saturated frequency in the document; a document's score is the sum over the
query's terms. The search first takes each query's rarest terms; the full scores of their best documents bound the k-th best from below.
Then the bounds of the terms decide: common terms that even together can't reach that score bring in no new document, and
of the others only postings with enough impact can belong to one that reaches it. What is left are the candidates; they
alone are looked up in the forward table for the common terms. Every row of the full join's top k comes back.

Postings of one term lie in as many rows, files and partitions as they fill, so a hot term is no hot group; at most
``FIRST`` postings a query and result are read in the first step besides those of the rarest term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import sinks

#: Folders of postings; postings for each result that the first step may read.
BUCKETS, FIRST = 16, 20
#: Documents for each result whose full score is taken after the first step.
LIKELY = 3
#: Documents of one step that are sent to every task at most.
NAMED = 1_000_000


def rarity(n_docs: int, df: Column) -> Column:
    """1 for a term of over half of the documents, one more each time it is half as common: the binary digits of n / df."""
    return F.length(F.bin(F.call_function("div", F.lit(n_docs).cast("long"), df)))


def saturated(tf: Column) -> Column:
    return F.call_function("div", 10 * tf, tf + 1)


def build(docs: DataFrame, path: str, id_col: str, terms: Column) -> None:
    """Write the index of ``docs`` by an array of terms with repeats. Null ids, arrays and terms are left out; a repeated id is one document."""
    spark = docs.sparkSession
    # dealt by id before terms are counted, so that neither counts nor the forward table need another exchange
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), terms.alias("terms")).where("id is not null and terms is not null").repartition("id")
    tf = dealt.select("id", F.explode("terms").alias("term")).where("term is not null").groupBy("id", "term").agg(F.count("*").cast("int").alias("tf"))
    tf.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "tf"))).alias("counts")).write.parquet(f"{path}/forward")
    tf = spark.read.parquet(f"{path}/forward").select("id", F.explode("counts").alias("term", "tf"))
    n = docs.select(id_col).dropna().distinct().count()
    counts = tf.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("most"))
    weights = counts.select("term", "df", rarity(n, F.col("df")).alias("rarity"), (rarity(n, F.col("df")) * saturated(F.col("most"))).alias("bound"))
    weights = weights.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    weights.sortWithinPartitions("term").write.parquet(f"{path}/terms")
    weights = spark.read.parquet(f"{path}/terms")
    postings = tf.join(weights.select("term", "rarity", "bucket"), "term").select("bucket", "term", (F.col("rarity") * saturated(F.col("tf"))).cast("int").alias("impact"), "id")
    postings.sortWithinPartitions("bucket", "term", F.desc("impact"), "id").write.partitionBy("bucket").parquet(f"{path}/postings")


class TextIndex:
    """An index that ``build`` has written."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def pairs_of_all(self, queries: DataFrame) -> int:
        """Pairs of query and posting that a full join would make."""
        return self._asked(queries).agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]

    def _asked(self, queries: DataFrame) -> DataFrame:
        """``q_id, term, df, rarity, bound, bucket`` of the distinct terms of ``queries(q_id, terms)`` that some document has."""
        terms = queries.select("q_id", F.explode(F.array_distinct("terms")).alias("term"))
        return terms.join(self.read("terms").select("term", "df", "rarity", "bound", "bucket"), "term")

    def steps(self, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Each query's terms with what the first step decides, the postings that step read, and those of the second."""
        query = Window.partitionBy("q_id")
        rarest = query.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0)
        asked = self._asked(queries).withColumns({"rank": F.row_number().over(query.orderBy("df", "term")), "read": F.sum("df").over(rarest)})
        asked = sinks.kept(asked.withColumn("early", (F.col("rank") == 1) | (F.col("read") <= FIRST * k)), "asked")
        stored = self.read("postings")
        first = stored.join(asked.where("early").select("q_id", "term", "bucket"), ["bucket", "term"]).select("q_id", "id", "impact")
        partial = first.groupBy("q_id", "id").agg(F.sum("impact").alias("score"))
        best = query.orderBy(F.desc("score"), "id")
        # the full scores of the best of them, so that the bound is not one of rare terms alone
        likely = partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= LIKELY * k)
        wanted = asked.groupBy("q_id").agg(F.collect_list(F.struct("term", "rarity")).alias("terms"))
        full = self._scored(likely.join(wanted, "q_id").select("q_id", "id", F.lit(0).cast("long").alias("score"), "terms"), "terms")
        kth = full.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("q_id", F.col("score").alias("least"))
        # the longest run of terms, weakest and then most common first, whose bounds together stay below the k-th best
        weakest = query.orderBy("bound", F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
        terms = asked.join(kth, "q_id", "left").withColumn("least", F.coalesce("least", F.lit(0)))
        terms = terms.withColumns({"reach": F.sum("bound").over(weakest), "all": F.sum("bound").over(query)})
        terms = sinks.kept(terms.withColumns({"minor": F.col("reach") < F.col("least"), "need": F.col("least") - (F.col("all") - F.col("bound"))}), "terms")
        main = terms.where("not minor").select("q_id", "term", "bucket", "need")
        second = stored.join(main, ["bucket", "term"]).where("impact >= need").select("q_id", "id", "impact")
        return terms, first, second

    def _scored(self, found: DataFrame, terms: str) -> DataFrame:
        """``q_id, id, score`` with the impacts of ``terms``, an array of terms and rarities, added from the forward table.

        While the documents are few enough, only their rows of that table are dealt.
        """
        found, forward = sinks.kept(found, "candidates"), self.read("forward")
        ids = found.select("id").distinct()
        if ids.limit(NAMED + 1).count() <= NAMED:
            forward = forward.join(F.broadcast(ids), "id", "left_semi")
        score = F.aggregate(terms, F.col("score"), lambda a, t: a + F.coalesce(t["rarity"] * saturated(F.try_element_at("counts", t["term"])), F.lit(0)))
        return found.join(forward, "id").select("q_id", "id", score.alias("score"))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """``q_id, id, score, rank``: the k best documents of each of ``queries(q_id, terms)`` with a positive score, ties by id."""
        terms, _, second = self.steps(queries, k)
        minor = F.collect_list(F.when(F.col("minor"), F.struct("term", "rarity")))
        rest = terms.groupBy("q_id").agg(F.max("least").alias("least"), minor.alias("minor"), F.sum(F.when(F.col("minor"), F.col("bound")).otherwise(0)).alias("more"))
        found = second.groupBy("q_id", "id").agg(F.sum("impact").alias("score")).join(rest, "q_id").where("score + more >= least")
        full = self._scored(found, "minor")
        best = Window.partitionBy("q_id").orderBy(F.desc("score"), "id")
        return full.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
