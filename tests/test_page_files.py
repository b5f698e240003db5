"""Page files written, read back, filtered, resumed and streamed."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import page_files, sinks, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tree(spark):
    page_files.register(spark)
    rows = spark.read.parquet(f"{SF}/pages.parquet").select((F.col("page_id") % 3).cast("string").alias("category"), F.format_string("p%06d", "page_id").alias("stem"), "page_id", F.lit(None).cast("string").alias("title"), F.col("html").alias("text"))
    odd = [("a/b é", "x:y.z", None, "T", "text"), ("", "%41;", 5, None, ""), ("0", "zz/..", None, None, "up")]
    rows = rows.union(spark.createDataFrame(odd, page_files.SCHEMA))
    root = sinks.scratch(spark, "pages")
    rows.repartition(4).write.format("page_files").mode("append").save(root)
    return rows, root


def load(spark, root, **options):
    return spark.read.format("page_files").options(**options).load(root)


def test_pages_come_back_equal(spark, tree):
    rows, root = tree
    want = {(r.category, r.stem, r.page_id if r.page_id is not None else page_files.path_id(r.category, r.stem), r.title, r.text) for r in rows.collect()}
    for splits in (1, 3):
        have = load(spark, root, splits=splits)
        assert {tuple(r) for r in have.collect()} == want and have.count() == len(want)
        assert have.rdd.getNumPartitions() == 5 * splits
    assert len({page_files.path_id("c", str(k)) for k in range(100_000)}) == 100_000


def test_filters_choose_partitions_and_resume(spark, tree):
    rows, root = tree
    some = load(spark, root).where("category = '1'")
    assert some.rdd.getNumPartitions() == 1 and some.count() == rows.where("category = '1'").count() > 0
    assert load(spark, root).where("category in ('1', '2') and length(text) > 100").rdd.getNumPartitions() == 2
    stems = sorted(r.stem for r in rows.where("category = '1'").collect())
    first = stems[: len(stems) // 2]
    rest = load(spark, root, after=first[-1]).where("category = '1'")
    assert sorted(r.stem for r in rest.collect()) == stems[len(first) :]
    assert sorted(r.stem for r in load(spark, root).where(f"category = '1' and stem > '{first[-1]}'").collect()) == stems[len(first) :]


def test_stream_gives_each_page_once(spark, tree):
    _, first = tree
    root = sinks.scratch(spark, "pages")
    check = sinks.scratch(spark, "cursor")
    part = lambda k: spark.createDataFrame([("c", f"s{j}", j, None, f"t{j}") for j in range(k, k + 3)], page_files.SCHEMA)

    def run(name):
        source = spark.readStream.format("page_files").load(root)
        query = source.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{check}/{name}").outputMode("append").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted(r.stem for r in spark.table(name).collect())

    seen = []
    out = f"{check}/out"
    for k in (0, 3):
        part(k).write.format("page_files").mode("append").save(root)
        source = spark.readStream.format("page_files").load(root)
        query = source.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{check}/c").trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        seen.append(sorted(r.stem for r in spark.read.parquet(out).collect()))
    assert seen == [["s0", "s1", "s2"], ["s0", "s1", "s2", "s3", "s4", "s5"]]


def test_a_failed_write_leaves_nothing(spark, tree):
    root = sinks.scratch(spark, "pages")
    rows = spark.createDataFrame([("c", "a", 1, None, "x"), ("c", "b", 2, None, "y")], page_files.SCHEMA)
    bad = rows.withColumn("text", F.when(F.col("stem") == "b", F.raise_error(F.lit("no")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception):
        bad.write.format("page_files").mode("append").save(root)
    assert load(spark, root).count() == 0
    with pytest.raises(Exception):
        rows.write.format("page_files").mode("overwrite").save(root)


def test_names_are_reversible():
    for name in ("", "a", "%", "%41;", "a/b", "é:;", "..", "%25;x"):
        assert page_files.read_name(page_files.name_of(name)) == name


def test_ids_of_page_trees_are_wide(spark, tmp_path):
    (tmp_path / "One.wikitext").write_text("x")
    (row,) = tables.read_pages(spark, str(tmp_path)).collect()
    assert row.page_id >= 0 and row.page_id.bit_length() <= 60
