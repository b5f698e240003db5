"""Longest matches and rules against a plain search of the text."""

import json
import random
import re
import tempfile

import pytest
from pyspark.sql import functions as F

from tessera.operators import phrases, rules


def plain(text, aliases):
    """Leftmost, then longest, without overlap; no word character on either side."""
    best = {}
    for alias, name in aliases:
        if alias and name is not None:
            best[alias.lower()] = min(best.get(alias.lower(), name), name)
    if not best:
        return []
    pattern = "(?<!\\w)(?:" + "|".join(re.escape(a) for a in sorted(best, key=len, reverse=True)) + ")(?!\\w)"
    return [(m.start(), m.end(), best[m.group().lower()]) for m in re.finditer(pattern, text, re.IGNORECASE)]


WORDS = ["new", "york", "city", "É", "a", "b-c", "x_1", "ß", "+", "日本"]


def sample(seed, n=60):
    r = random.Random(seed)
    say = lambda k: "".join(r.choice(WORDS) + r.choice([" ", " ", "  ", "-", ".", "\n", ""]) for _ in range(k))
    aliases = [(say(r.randint(1, 4)).strip(" \n"), f"n{r.randint(0, 9)}") for _ in range(40)] + [("New York", "ny"), ("new york city", "nyc"), ("york", "y"), ("", "none"), (None, "none"), ("city", None)]
    texts = [say(r.randint(0, 40)).upper() if k % 5 == 0 else say(r.randint(0, 40)) for k in range(n)] + [None, "", "a " * 3000, "newyork New York cityx new york CITY"]
    return aliases, texts


@pytest.mark.parametrize("most", [200_000, 0])
def test_mentions_equal_a_plain_search(spark, monkeypatch, most):
    """Both ways: the trie in every task, and the join of more phrases than are sent."""
    monkeypatch.setattr(phrases, "MAX_PHRASES", most)
    aliases, texts = sample(most)
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string").withColumn("start", F.lit(1)).repartition(3)
    have = phrases.mentions(docs, spark.createDataFrame(aliases, "alias string, canonical string"))
    want = sorted((k // 2, *m) for k, t in enumerate(texts) if t for m in plain(t, aliases))
    assert sorted(map(tuple, have.collect())) == want and len(want) > 50
    assert phrases.mentions(docs.limit(0), spark.createDataFrame(aliases, "alias string, canonical string")).count() == 0
    assert phrases.mentions(docs, spark.createDataFrame([], "alias string, canonical string")).count() == 0


def loop(text, table):
    """One rule after another over the places that no earlier find has taken: leftmost and longest, then priority and id."""
    finds = plain(text, [(p, (pr, i, a, v)) for i, p, a, v, pr in table])
    out, at, labels, rejects = "", 0, [], []
    for start, stop, (pr, i, a, v) in finds:
        if a in ("strip", "replace"):
            out += text[at:start] + (v if a == "replace" else "")
            at = stop
        (labels if a == "label" else rejects if a == "reject" else []).append((pr, i, v))
    return out + text[at:], min(labels)[2] if labels else None, min(rejects)[1] if rejects else None, len(finds)


def test_ten_thousand_rules_in_one_pass(spark):
    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(400)]
    table = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 3))), r.choice(rules.ACTIONS), f"<{k}>", r.randint(0, 5)) for k in range(10_000)]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 80))) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (98, None), (99, "")], "doc_id long, text string").withColumn("label", F.lit("old")).repartition(3)
    done = rules.apply_rules(docs, spark.createDataFrame(table, rules.SCHEMA))
    have = {x.doc_id: (x.text, x.label, x.rejected_by, x.n_rules) for x in done.collect()}
    assert have == {**{k: loop(t, table) for k, t in enumerate(texts)}, 98: (None, None, None, 0), 99: ("", None, None, 0)}
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan


def test_rules_change_while_the_stream_runs(spark):
    folder = tempfile.mkdtemp()
    rule_file, docs_path = f"{folder}/rules.jsonl", f"{folder}/docs"
    write_rules = lambda v: open(rule_file, "w").write(json.dumps({"rule_id": 1, "phrase": "bad word", "action": "replace", "value": v, "priority": 1}) + "\n")
    write_rules("one")
    for k in range(2):
        spark.createDataFrame([(k, "a Bad Word here")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(docs_path)
    seen = []

    def keep(batch, batch_id):
        seen.extend(x.text for x in batch.collect())
        write_rules("two")

    source = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(docs_path)
    query = rules.apply_to_stream(source, rule_file, keep).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert seen == ["a one here", "a two here"]


def test_unknown_actions_are_errors(spark):
    path = tempfile.mkdtemp() + "/rules.jsonl"
    open(path, "w").write('{"rule_id": 1, "phrase": "x", "action": "explode"}\n')
    with pytest.raises(Exception, match="unknown action"):
        rules.read_rules(spark, path).collect()
