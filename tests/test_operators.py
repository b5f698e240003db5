"""Expressions and operators against literal values, plain Python, and streaming twins."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import scores, text
from tessera.operators import core
from tessera.sources import tables
from tessera.streaming import emotions, state

SF = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_uuid5(spark):
    assert value(spark, text.uuid5(F.lit("54321::A > B::0"))) == "b8e5baed-5ec3-512d-b4b9-662b106b48fa"
    names = [f"n{i}é" for i in range(40)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.uuid5(F.col("n")).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.NAMESPACE_OID, r.n)) for r in rows)


def test_recency_and_boost(spark):
    for importance, days, want in ((0.9, 0, 1.0), (0.9, 138.63, 0.5), (0.7, 27.73, 0.5), (0.3, 6.93, 0.5), (0.3, 9999, 0.01)):
        assert math.isclose(value(spark, scores.recency(F.lit(importance), F.lit(days * 86400.0))), want, abs_tol=1e-3)
    assert value(spark, scores.boosted(F.lit(0.9), F.lit("critical"))) == 1.0
    assert round(value(spark, scores.rrf_term(F.lit(1), F.lit(0.8))), 6) == 0.963934
    assert value(spark, scores.decay_to_baseline(F.lit(1.0), F.lit(0.4), F.lit(1800), 1800.0)) == 0.7


def test_cosine_of_unequal_lengths(spark):
    a = F.array(F.lit(1.0), F.lit(0.0))
    assert value(spark, scores.cosine(a, F.array(F.lit(1.0)))) == 0.0
    assert value(spark, scores.cosine(a, F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_ngrams(spark):
    found = value(spark, text.query_tokens(F.lit("hãy kể về vòng cổ")))
    assert {"vòng", "cổ", "vòng cổ", "kể về", "về vòng"} <= set(found)


def test_keyword_score(spark):
    stop, high = ["the"], ["magic ring"]
    assert value(spark, text.keyword_score(F.lit("magic ring"), F.lit("nothing"), stop, high)) == 0.0
    assert value(spark, text.keyword_score(F.lit("magic ring"), F.lit("A Magic Ring!"), stop, high)) > 0.5


def test_u_curve(spark):
    rows = core.u_curve(spark.range(1, 6).withColumn("g", F.lit(1)), ["g"], ["id"]).orderBy("place").collect()
    assert [r.id for r in rows] == [1, 3, 5, 4, 2]


def pack(sizes, target, most):
    out, first, size = [], 0, 0
    for i, s in enumerate(sizes):
        if size and size + s > most:
            out.append((first, i - 1, size))
            first, size = i, 0
        size += s
        if size >= target:
            out.append((first, i, size))
            first, size = i + 1, 0
    return out + ([(first, len(sizes) - 1, size)] if size else [])


def test_greedy_pack(spark):
    import random

    r = random.Random(4)
    cases = [[r.randint(1, 300) for _ in range(r.randint(0, 40))] for _ in range(30)]
    df = spark.createDataFrame([(c,) for c in cases], "s array<long>")
    for row in df.select("s", core.greedy_pack(F.col("s"), F.col("s"), 256, 512).alias("c")).collect():
        assert [tuple(c) for c in row.c] == pack(row.s, 256, 512)


def test_islands_take_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a"), (4, None)], "t int, s string").withColumn("g", F.lit(1))
    assert [r.island for r in core.islands(df, ["g"], ["t"], ["s"]).orderBy("t").collect()] == [1, 1, 2, 3]


def test_orphans_and_merge(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "page_id int")
    assert [r.page_id for r in core.orphans(ids(101, 102, 103), ids(101, 102), ["page_id"]).collect()] == [103]
    merged = core.key_merge(ids(1, 2).withColumn("v", F.lit("old")), ids(2, 3).withColumn("v", F.lit("new")), ["page_id"])
    assert {(r.page_id, r.v) for r in merged.collect()} == {(1, "old"), (2, "new"), (3, "new")}


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/One.wikitext").write_text("hello\nworld")
    (tmp_path / "a/Two.wikitext").write_text("#REDIRECT [[One]]")
    (tmp_path / "a/One.meta.json").write_text('{"page_id": 7,\n "title": "One"}')
    pages = tables.read_pages(spark, str(tmp_path))
    rows = tables.with_sidecars(pages.drop("page_id"), spark, str(tmp_path), "page_id long, title string").collect()
    assert [(r.stem, r.page_id, r.text) for r in rows] == [("One", 7, "hello\nworld")]
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    assert sorted(r.a for r in tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), "a int").collect()) == [1, 2]
    df = spark.createDataFrame([(1, "APPROVED"), (2, "QUARANTINED")], "id int, status string")
    assert [r.id for r in tables.quarantine(df, "status", str(tmp_path / "q")).collect()] == [1]


def stream(spark, build, name, events, batches=4, mode="append"):
    """Run a streaming operator over files of events that arrive in order."""
    import tempfile

    path = tempfile.mkdtemp() + "/events"
    n = events.count()
    for k in range(batches):
        events.where((F.col("event_id") * batches >= k * n) & (F.col("event_id") * batches < (k + 1) * n)).coalesce(1).write.mode("append").parquet(path)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = build(source).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


@pytest.fixture(scope="module")
def events(spark):
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").limit(600)
    return spark.createDataFrame(
        [(i, r.ts, r.user_id, r.event_type, r.value) for i, r in enumerate(rows.collect())], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    ).cache()


def test_streaming_twins(spark, events):
    want = {tuple(r) for r in state.anchored_limit(events, 36000, 1).collect()}
    got = {tuple(r) for r in stream(spark, lambda s: state.stream_anchored_limit(s, 36000, 1), "anchored", events).collect()}
    assert got == want and any(not ok for _, ok in want)
    fired = stream(spark, lambda s: state.stream_running_counts(s, 3), "fired", events).collect()
    assert len(fired) == sum(r.n // 3 for r in events.groupBy("user_id").agg(F.count("*").alias("n")).collect())


def test_anchored_limit_by_definition(events):
    """A window opens at the first event after the last one's end; within it only so many are allowed."""
    seen, want = {}, set()
    for r in events.orderBy("ts", "event_id").collect():
        opened, used = seen.get(r.user_id, (None, 0))
        if opened is None or (r.ts - opened).total_seconds() >= 36000:
            opened, used = r.ts, 0
        want.add((r.event_id, used < 2))
        seen[r.user_id] = opened, used + (used < 2)
    assert {tuple(r) for r in state.anchored_limit(events, 36000, 2).collect()} == want


def test_breaker_and_emotion_twins(spark, events):
    want = {tuple(r) for r in state.breaker(events, 2, 90000.0).collect()}
    got = {tuple(r) for r in stream(spark, lambda s: state.stream_breaker(s, 2, 90000.0), "breaker", events).collect()}
    assert got == want
    last = {r.user_id: r for r in sorted(stream(spark, emotions.stream_emotions, "moods", events, mode="update").collect(), key=lambda r: r.n)}
    assert {tuple(r) for r in last.values()} == {tuple(r) for r in emotions.emotion_states(events).collect()}


def test_cache_buffer_barrier_and_trace_twins(spark, events):
    seen, want = {}, set()
    for r in events.orderBy("ts", "event_id").collect():
        before = seen.get((r.user_id, r.event_type))
        want.add((r.event_id, before is not None and (r.ts - before).total_seconds() < 86400))
        seen[r.user_id, r.event_type] = r.ts
    assert {tuple(r) for r in stream(spark, state.stream_cache_hits, "hits", events).collect()} == want
    first = {}
    for r in events.collect():
        key = (r.event_type, r.user_id, r.ts)
        first[key] = min(first.get(key, r.event_id), r.event_id)
    newest = {}
    for (kind, _, ts), i in first.items():
        newest.setdefault(kind, []).append((ts, i))
    want = {(kind, i) for kind, rows in newest.items() for _, i in sorted(rows, reverse=True)[:20]}
    n = events.count()
    parts = stream(spark, lambda s: state.stream_rolling_buffer(s, 20), "buffer", events, batches=1, mode="update").collect()
    assert {tuple(r) for r in parts} == want
    grown = stream(spark, lambda s: state.stream_rolling_buffer(s, n), "grown", events, batches=3, mode="update")
    assert {tuple(r) for r in grown.collect()} == {(kind, i) for (kind, _, _), i in first.items()}
    cutoffs = events.where("user_id % 2 = 0").groupBy("user_id").agg(F.min("ts").alias("cutoff"))
    kept = stream(spark, lambda s: state.stream_clear_barrier(s, cutoffs, "user_id", "cutoff"), "kept", events)
    low = {r.user_id: r.cutoff for r in cutoffs.collect()}
    assert {r.event_id for r in kept.collect()} == {r.event_id for r in events.collect() if r.user_id not in low or r.ts > low[r.user_id]}
    traces = stream(spark, state.stream_traces, "traces", events, mode="complete")
    assert {tuple(r) for r in traces.collect()} == {tuple(r) for r in state.stream_traces(events).collect()}


def test_tumbling_counts_twin(spark, events):
    got = stream(spark, lambda s: state.stream_tumbling_counts(s, "1 hour", 2, "0 seconds"), "tumbling", events)
    want = {tuple(r) for r in state.tumbling_counts(events, "1 hour", 2).collect()}
    found = {tuple(r) for r in got.collect()}
    assert found and found <= want  # windows that the watermark hasn't passed are still open


def step(now, seconds, reaction, stance, power, swing):
    """One user's turn, by names of channels."""
    power, swing = 0.5 if power is None else power, 0.0 if swing is None else swing
    reaction = reaction if reaction in emotions.REACTION else "calm_warmth"
    stance = stance or emotions.implied(reaction, swing)
    row = np.array([[now[c] for c in state.CHANNELS]])
    after = emotions.turn(row, np.array([seconds]), np.array([emotions.REACTION[reaction]]), np.array([emotions.STANCE[stance]]), np.array([power]), np.array([swing]))
    return dict(zip(state.CHANNELS, after[0].tolist()))


def test_emotion_steps_by_hand():
    rest = dict(state.RESTING)
    assert step({c: 1.0 for c in state.CHANNELS}, 0.0, "neutral", "neutral", 0.0, 0.0)["trust"] == 1.0
    # decay alone: intensity 0 leaves half of the distance to rest after one half-life
    far = rest | {"irritation": 0.2, "curiosity": 0.5}
    assert abs(step(far, 900.0, "neutral", "neutral", 0.0, 0.0)["irritation"] - 0.1) < 1e-9
    assert abs(step(far, 1800.0, "neutral", "neutral", 0.0, 0.0)["curiosity"] - 0.3) < 1e-9
    assert step(rest | {"attachment": 0.4}, 1e9, "neutral", "playful", 0.0, 0.0)["attachment"] >= 0.4
    # a cheerful turn of full power from rest: 0.55 on joy, open 1.0, room 0.85
    joyful = step(rest, 0.0, "cheerful_joy", "loving", 1.0, 0.0)
    assert abs(joyful["joy"] - (0.15 + 0.55 * 0.85)) < 1e-9 and abs(joyful["trust"] - (0.5 + 0.04 * 0.5)) < 1e-9
    warmth = 0.015 * joyful["shyness"] + 0.010 * joyful["comfort"] + 0.005 * joyful["joy"]
    assert abs(joyful["attachment"] - min(0.03, 0.03 + warmth)) < 1e-9
    # a hostile one: irritation 0.5 * 1.8 * wary 1.0, trust loses 0.2 * 1.8 * 0.5
    hurt = step(rest, 0.0, "guarded_cold", "hostile", 1.0, 0.0)
    assert abs(hurt["irritation"] - 0.9) < 1e-9 and abs(hurt["trust"] - (0.5 - 0.2 * 1.8 * 1.0 * 0.5)) < 1e-9
    assert hurt["shyness"] == 0.0 and hurt["attachment"] == 0.0 and hurt["comfort"] < 0.1
    # a pout among friends is shielded: no withdrawal
    close = rest | {"trust": 0.8, "attachment": 0.5}
    assert step(close, 0.0, "playful_pout", "playful", 1.0, 0.0)["attachment"] > 0.5
    for kind in ("none", None):
        assert all(0 <= v <= 1 for v in step(rest, 10.0, kind, None, None, None).values())


def test_gold_ranks_follow_the_retriever(spark):
    """The passage's own document comes second, behind one that has all of the question's words."""
    from tessera.plans.retrieval import gold_ranks

    passage = "one two three four five six seven eight nine ten"
    docs = [(1, "one two three four five six seven eight then something else"), (2, "and " + passage), (3, "nothing of it"), (4, "one two")]
    gold = spark.createDataFrame([(7, passage), (8, "absent words here")], "item_id long, gold string")
    out = {r.item_id: r.first_rank for r in gold_ranks(gold, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {7: 2, 8: None}


def test_tables_change_in_whole_versions(spark):
    from tessera.sources import sinks

    path = sinks.create(spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string"), "t")
    before = {tuple(r) for r in sinks.read(spark, path).collect()}
    with pytest.raises(Exception):
        sinks.change(spark, path, lambda old: old.withColumn("v", F.raise_error(F.lit("no")).cast("string")))
    assert {tuple(r) for r in sinks.read(spark, path).collect()} == before
    assert {tuple(r) for r in sinks.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "id long, v string"), path, ["id"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {r.id for r in sinks.delete_where(spark, path, F.col("v") == "c").collect()} == {1, 3}


def test_sequential_chunks_by_plain_python(spark):
    """Chunkers whose greedy order SQL can't express, against loops."""
    from tessera.plans import catalog

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    found = {}
    for r in catalog.queries()["chunk_pack"](spark, SF).collect():
        found.setdefault(r.doc_id, []).append((r.first_line, r.last_line, r.tokens))
    for i, text in docs.items():
        sizes = [max(1, int(len(x) / 1.3)) for x in text.split("\n")]
        assert sorted(found[i]) == pack(sizes, 256, 512)
    ends = {}
    for r in catalog.queries()["message_split"](spark, SF).collect():
        ends.setdefault(r.doc_id, []).append((r.start, r.end_))
    for i, text in docs.items():
        at, want = 0, []
        while at < len(text):
            part, end = text[at : at + 1900], len(text)
            if len(text) - at > 1900:
                cut = part.rfind("\n") + 1
                cut = cut if cut >= 1140 else part.rfind(" ") + 1
                end = at + (cut if cut >= 1140 else 1900)
            want.append((at, end))
            at = end
        assert sorted(ends[i]) == want
    for r in catalog.queries()["semantic_chunks"](spark, SF).collect():
        assert 0 < r.chars and r.first <= r.last
