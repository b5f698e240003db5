"""The JSON automaton against a parser, for every cut and in any order of arrival."""

import json
import random
import tempfile
import time

from pyspark.sql import functions as F

from tessera.streaming import json_field
from tessera.streaming.json_field import FieldReader

from .test_expiring import ROCKS

TEXTS = ["", "plain", 'q " \\ / \n\t\r\b\f', "é 日本 \U0001f600 ퟿", "\\u0041 \\n", '"response": "x"', "\U0001f600\U0001f601" * 3, "}{][,:", "  \x01"]


def objects(r):
    for text in TEXTS:
        for ascii_ in (True, False):
            first = r.choice([{"a": 'x "response": "no" '}, {"response ": "no", "n": [{"response": "no"}, ["response", 1]]}, {"o": {"response": "no"}, "b": None}, {}])
            yield text, json.dumps({**first, "response": text, "later": {"response": "no"}, "role": "z"}, ensure_ascii=ascii_, indent=r.choice([None, 2]))


def test_every_single_cut_and_random_cuts():
    r = random.Random(2)
    for text, whole in objects(r):
        for k in range(len(whole) + 1):
            reader = FieldReader("response")
            first = reader.feed(whole[:k])
            assert first + FieldReader("response", reader.state).feed(whole[k:]) == text
        state, out, at = None, "", 0
        while at < len(whole):
            n = r.randint(1, 5)
            reader = FieldReader("response", state)
            out, at, state = out + reader.feed(whole[at : at + n]), at + n, reader.state
        assert out == text and state[-1]


def test_odd_input():
    read = lambda s: FieldReader("response").feed(s)
    assert read('{"response": "cut off') == "cut off"
    assert read('{"response": null, "x": "y"}') == read('["response", "x"]') == read('{"response"') == read("") == read("not json") == ""
    assert read(r'{"response": "\ud83d lone \ude00 \ud83d😀 \uzzzz"}') == "� lone � �\U0001f600 �"
    assert read('{"response": 5, "response": "first string"}') == "first string"


def test_stream_in_any_order_equals_the_table(spark):
    r = random.Random(3)
    rows = [(str(k), whole) for k, (_, whole) in enumerate(objects(r))]
    parts = json_field.cut(spark.createDataFrame(rows, "key string, json string"), "json", ["key"]).cache()
    want = {(x.key, x.seq, x.piece) for x in json_field.field_table(parts, "response", ["key"], "seq", "fragment").collect()}
    texts = dict(zip((k for k, _ in rows), (t for t, _ in objects(random.Random(3)))))
    told = {}
    for key, _, piece in sorted(want, key=lambda x: x[:2]):
        told[key] = told.get(key, "") + piece
    assert told == texts
    path = tempfile.mkdtemp() + "/in"
    for k in range(3):
        parts.where(F.pmod(F.xxhash64("seq", "key"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(path)
    parts.where("seq < 5").coalesce(1).write.mode("append").parquet(path)  # sent again
    sent = spark.read.parquet(path).count()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        source = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(path)
        query = json_field.field_stream(source, "response", "key", "seq", "fragment").writeStream.format("memory").queryName("pieces").outputMode("append").start()
        ends = time.time() + 90  # with timers of processing time it runs until it is stopped
        while sum(p["numInputRows"] for p in query.recentProgress) < sent and time.time() < ends:
            time.sleep(0.5)
        query.stop()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = [(x.key, x.seq, x.piece) for x in spark.table("pieces").collect()]
    assert len(got) == len(set(got))
    assert {x for x in got if x[2]} == {x for x in want if x[2]}
