"""Chunkers whose greedy order SQL can't express, against plain loops over the whole tables."""

import hashlib

import pytest
import regex

from tessera.plans import catalog

SF = "/root/testdata/sf0.01"


def pack(sizes, target, most, least=1, ceiling=None):
    out, first, size = [], 0, 0
    for i, s in enumerate(sizes):
        if size and size + s > most:
            out.append((first, i - 1, size))
            first, size = i, 0
        size += s
        if size >= target and i - first + 1 >= least and (ceiling is None or size <= ceiling):
            out.append((first, i, size))
            first, size = i + 1, 0
    return out + ([(first, len(sizes) - 1, size)] if size else [])


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def tokens(text):
    return max(1, int(len(text) / 1.3))


def read(spark, name):
    return spark.read.parquet(f"{SF}/{name}.parquet").collect()


def have(spark, name):
    return sorted(map(tuple, catalog.queries()[name](spark, SF).collect()))


def test_dialogue_chunks(spark):
    by = {}
    for r in read(spark, "conversations"):
        by.setdefault(r.conv_id, []).append((r.turn, f"{r.role or ''}: {r.text or ''}"))
    want = []
    for conv, turns in by.items():
        lines = [line for _, line in sorted(turns)]
        want += [(conv, k, md5("\n".join(lines[a : b + 1])), n) for k, (a, b, n) in enumerate(pack([tokens(x) for x in lines], 256, 512, 3))]
    assert have(spark, "dialogue_chunks") == sorted(want)


def test_table_chunks(spark):
    names, by = {r.s_suppkey: r.s_name for r in read(spark, "supplier")}, {}
    for r in read(spark, "lineitem"):
        by.setdefault(r.l_suppkey, []).append((r.l_orderkey, r.l_linenumber, f"- order: {r.l_orderkey}; line: {r.l_linenumber}; part: {r.l_partkey}; flag: {r.l_returnflag}"))
    want = []
    for key, rows in by.items():
        lines = [x[2] for x in sorted(rows)]
        want += [(key, k, md5("\n".join([f"[{names[key]}]", *lines[a : b + 1]]))) for k, (a, b, _) in enumerate(pack([tokens(x) for x in lines], 256, 512)) if key in names]
    assert have(spark, "table_chunks") == sorted(want)


def test_prose_children(spark):
    want = []
    for r in read(spark, "documents"):
        lines, before = [x for x in (r.text or "").split("\n") if x.strip(" ")], ""
        for k, (a, b, _) in enumerate(pack([len(x) for x in lines], 400, 800)):
            body = "\n".join(lines[a : b + 1])
            if len(body) >= 20:
                want.append((r.doc_id, k, len(body), md5(before[-100:] + body)))
            before = body
    assert have(spark, "prose_children") == sorted(want)


def test_semantic_chunks(spark):
    want = []
    for r in read(spark, "documents"):
        parts = regex.sub(r"([.!?])[ \n]+([\p{Lu}\p{N}])", "\\1\x01\\2", r.text or "").split("\x01")
        want += [(r.doc_id, k, a, b, n) for k, (a, b, n) in enumerate(pack([len(x) for x in parts], 1600, 3600, ceiling=2800))]
    assert have(spark, "semantic_chunks") == sorted(want)


@pytest.mark.parametrize("sizes", [[], [0], [0, 5, 0], [513], [512, 1], [100] * 30])
def test_packing_at_its_limits(spark, sizes):
    from pyspark.sql import functions as F

    from tessera.operators import core

    df = spark.createDataFrame([(sizes,)], "s array<long>")
    assert [tuple(c) for c in df.select(core.greedy_pack(F.col("s"), F.col("s"), 256, 512, least=3).alias("c")).first().c] == pack(sizes, 256, 512, 3)
