"""Queries over every row that they are asked about, against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import core
from tessera.plans import catalog, retrieval

from . import oracle

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_ngram_tokens_of_all_documents(spark, con):
    want = {}
    for doc_id, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        w = re.findall(r"\w{2,}", text.lower())
        first = hashlib.md5(" ".join(w[:2]).encode()).hexdigest() if len(w) > 1 else ""
        want[doc_id] = (len(w), max(len(w) - 1, 0), max(len(w) - 2, 0), first)
    have = catalog.queries()["ngram_tokens"](spark, SF).collect()
    assert {r.doc_id: (r.n1, r.n2, r.n3, r.first_pair) for r in have} == want and len(have) == len(want)


def test_transcript_lines_hold_the_whole_text(spark, con):
    shown = catalog.queries()["transcript_lines"](spark, SF).collect()
    sent = dict(((c, t), x) for c, t, x in con.execute("SELECT conv_id, turn, text FROM conversations").fetchall())
    assert all(r.line.endswith(sent[r.conv_id, r.turn]) for r in shown)


def test_search_of_short_empty_and_null_vectors(spark, tmp_path):
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 1.0], 1), (2, [1.0], 1), (3, [], 2), (4, None, None), (20, None, 2), (40, [0.0, 0.0], 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = {(r.q_id, r.vec_id): r.sim for r in retrieval._searched(spark, str(tmp_path)).collect()}
    assert found == {(q, v[0]): 0.0 for q in (0, 20, 40) for v in rows} | {(0, 0): 1.0, (0, 1): 0.707107}
    near = core.top_k(retrieval._searched(spark, str(tmp_path), 2, by_label=True), ["q_id", "label"], [F.desc("sim"), "vec_id"], 2).where("q_id = 0").collect()
    assert {(r.label, r.vec_id) for r in near} == {(1, 0), (1, 1), (2, 3), (2, 20), (None, 4)} and len(near) == 5


def test_search_gives_the_best_of_a_task_and_not_of_each_block(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    near = retrieval._searched(spark, SF, 4, by_label=True)
    n_queries, n_labels, parts = 25, 10, 4
    assert n_queries * n_labels * 4 <= near.count() <= n_queries * n_labels * 4 * parts
    best = lambda rows: {tuple(r) for r in core.top_k(rows, ["q_id", "label"], [F.desc("sim"), "vec_id"], 4).collect()}
    monkeypatch.setattr(retrieval.vector_index, "HELD", 100)  # given again and again
    assert best(retrieval._searched(spark, SF, 4, by_label=True)) == best(near)


def dealt(df) -> list[tuple[str, str]]:
    """Columns and arguments of each exchange of the plan."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: (.*)\n", plan)


@pytest.mark.parametrize("name", ["hybrid_rerank", "rrf_fusion", "retrieve_pack"])
def test_texts_are_dealt_once_by_document(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of size
    try:
        found = dealt(catalog.queries()[name](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert found and all("hashpartitioning(doc_id" in how for columns, how in found if re.search(r"\b(text|body)#", columns))
