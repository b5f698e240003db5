"""Operators that judge or rewrite one row at a time, against plain Python."""

import gzip
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import _common, bpe, quality_classifier, quality_rules, sharding, url_filter, warc

from .conftest import EDGE, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n)


@pytest.mark.parametrize("name", ["edge", "documents"])
def test_quality_counts(request, name):
    docs = request.getfixturevalue(name)
    texts = {(r.doc_id, r.text) for r in docs.collect()}
    rows = quality_rules.quality_rules(docs.withColumn("KEPT", F.lit("clash"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.doc_id, r.text) in texts
        assert tuple(r[c] for c in quality_rules.BASE) == base(r.text), r.doc_id
        assert not (r.base_failed and r.kept)


def test_quality_rejects_symbols_and_keeps_clean(documents, spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality_rules.quality_rules(documents).join(labels, "doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert any(not r.kept and not r.base_failed for r in rows if r.quality == 0)


def test_js_distance(spark):
    row = spark.range(1).select(
        quality_rules.js_distance(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))).alias("far"),
        quality_rules.js_distance(F.array(F.lit(1.0), F.lit(3.0)), F.array(F.lit(2.0), F.lit(6.0))).alias("same"),
        quality_rules.js_distance(F.array(F.lit(0.0)), F.array(F.lit(2.0))).alias("none"),
    ).first()
    assert (row.far, row.same, row.none) == (1.0, 0.0, None)


def test_empty_tables(empty, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_rules(empty).count() == 0
    assert quality_classifier.classify(empty, labels).count() == 0
    assert sharding.shard(empty).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert url_filter.filter_urls(pages, spark.createDataFrame([], "page_id long, good int")).count() == 0
    path = warc.new_path(spark, "warc")
    warc.write_warc(pages, path)
    assert warc.read_warc(spark, path).count() == 0


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_classifier.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    toxic = [r for r in rows if r.toxic]
    low = [r for r in rows if not r.quality]
    clean = [r for r in rows if r.quality and not r.toxic]
    insults = {"moron", "scum", "loser", "clown", "stupid", "worthless", "disgusting", "idiot", "pathetic", "trash"}
    marked = [r for r in toxic if insults & quality_classifier.features(r.text)]
    assert len(marked) > 0.5 * len(toxic)  # others have words of their own language, or a label that is noise
    assert sum(not r.kept for r in toxic) >= 0.75 * len(toxic)
    assert all(not r.kept for r in marked)
    assert sum(not r.kept for r in low) >= 0.95 * len(low)
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="needs check_s")
def test_classifier_keeps_clean_documents_under_many_labels(spark):
    """Many labels give many weak features, whose sum over a long clean text must not reject it."""
    sf = "/root/testdata/check_s"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    judged = quality_classifier.classify(docs, labels.where("doc_id % 2 = 0"), keep_text=False).join(labels.where("doc_id % 2 = 1"), "doc_id")
    rates = {(r.quality, r.toxic): r.kept for r in judged.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rates[1, 0] >= 0.99
    assert max(rate for key, rate in rates.items() if key != (1, 0)) <= 0.05


def test_classifier_edges(edge, spark):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    out = quality_classifier.classify(edge.withColumn("P_LOW", F.lit(1)), labels)
    assert out.count() == len(EDGE) and out.where("kept is null").count() == 0


def test_posterior_equals_the_definition(spark):
    """Shrunk means, prior strengths and the document left out of its own site, in plain Python."""
    rng = random.Random(2)
    rows = []
    for i in range(400):
        host = rng.choice("aaab")
        path = rng.choice("xyz")
        rows.append((i, host, path, rng.gauss(-2 + (host == "b") + (path == "x"), 1), rng.gauss(-3, 1)))
    scored = spark.createDataFrame(rows, "doc_id long, host_ string, path_ string, odds_toxic double, odds_low double")
    have = {r.doc_id: (r.p_toxic, r.p_low) for r in quality_classifier.with_posteriors(scored).collect()}
    sigma = lambda x: 1 / (1 + math.exp(-x))
    logit = lambda x: math.log(x / (1 - x))
    for k in (0, 1):
        p = [sigma(r[3 + k]) for r in rows]
        rate = sum(p) / len(p)

        def prior(key):
            groups = defaultdict(list)
            for r, x in zip(rows, p):
                groups[key(r)].append(x)
            n = len(p)
            within = sum((x - sum(g) / len(g)) ** 2 for g in groups.values() for x in g) / (n - len(groups))
            spread = sum(len(g) * (sum(g) / len(g) - rate) ** 2 for g in groups.values())
            true = (spread - (len(groups) - 1) * within) / (n - sum(len(g) ** 2 for g in groups.values()) / n)
            return groups, min(1e6, max(1.0, within / true)) if true > 0 else 1e6

        hosts, k_host = prior(lambda r: r[1])
        paths, k_path = prior(lambda r: r[1:3])
        for r, x in zip(rows, p):
            host = (sum(hosts[r[1]]) - x + k_host * rate) / (len(hosts[r[1]]) - 1 + k_host)
            path = (sum(paths[r[1:3]]) - x + k_path * host) / (len(paths[r[1:3]]) - 1 + k_path)
            assert abs(have[r[0]][k] - sigma(r[3 + k] + logit(path) - logit(rate))) < 1e-9


def test_sparse_site_shrinks_to_prior(spark):
    """One bad document says little about its site; many do."""
    rows = [(i, "good", "x", -3.0 + (i % 3) / 2, -9.0) for i in range(300)] + [(1000 + i, "bad", "x", 1.0 + (i % 3) / 2, -9.0) for i in range(300)]
    rows += [(5000, "tiny", "x", -1.0, -9.0), (5001, "tiny", "x", 2.0, -9.0), (6000, "bad", "x", -1.0, -9.0), (7000, "good", "x", -1.0, -9.0)]
    out = {r.doc_id: r.p_toxic for r in quality_classifier.with_posteriors(spark.createDataFrame(rows, "doc_id long, host_ string, path_ string, odds_toxic double, odds_low double")).collect()}
    assert out[7000] < out[5000] < out[6000]


def test_bpe_equals_tiktoken(edge, documents):
    import base64

    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert bpe.digests(edge.limit(1), "byte_bpe_50k.tiktoken", P.PATTERN).count() == 1  # a name is looked up by the worker
    for docs in (edge, documents.limit(80)):
        texts = {(r.doc_id, r.text) for r in docs.collect()}
        want = set()
        for doc_id, text in texts:
            ids = known.encode_ordinary(text or "")
            want.add((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
        assert {tuple(r) for r in bpe.digests(docs, path, P.PATTERN).collect()} == want
    own = bpe.codec(path, P.PATTERN)
    for text in ("a \nb  c", "a\n b \n", "\n \n x", "don't  I'LL 'S", "\u00a0 \u2003a \x1c\x1d b", "aaaa" * 5000, "ab" * 3000 + "é" * 999, "  ", "<|endoftext|>", "x\r\n\r\n y"):
        assert own.encode(text) == known.encode_ordinary(text), text[:20]
        assert own.decode(own.encode(text)) == text.encode()


def test_bpe_runs_the_pattern_once_for_all_words_of_a_portion(documents, monkeypatch):
    """Not once a word; cuts of the portion, turns of the cache and the way of long texts leave the result."""
    import public_tokenizers as P
    import pyarrow as pa

    path = P.path("byte_bpe_50k.tiktoken")
    own = bpe.Codec(path, P.PATTERN)
    plain, seen = bpe.Codec(path, P.PATTERN), []
    find = own.find
    own.find = lambda text: seen.append(text) or find(text)
    text = "the " + " ".join(f"qu{chr(97 + k % 26)}x{'yz' * (k % 7)}, (zor{chr(97 + k % 11)}). don't" for k in range(500))
    assert own.encode(text) == plain.piece(text)
    assert len(seen) <= 2
    own.find = find
    texts = [r.text or "" for r in documents.limit(12).collect()] + ["", " a b", "\n x", "a \n b", "x" * 90 + " " + "é" * 90, text, text, "b\n\n c\x1c d"]
    want = [(len(i), " ".join(map(str, i)).encode(), t.encode()) for t in texts for i in [plain.piece(t)]]
    monkeypatch.setattr(bpe, "CACHE", 1000)
    for portion, together, bulk in ((1 << 24, 1 << 21, 1 << 27), (1, 1, 1 << 27), (5000, 300, 1 << 27), (1 << 24, 1 << 21, 0)):
        monkeypatch.setattr(bpe, "PORTION", portion), monkeypatch.setattr(bpe, "TOGETHER", together), monkeypatch.setattr(bpe, "BULK", bulk)
        batch = pa.record_batch([pa.array(texts, pa.string())], names=["text"])
        parts = list(bpe.portions(batch))
        assert [row for part in parts for row in own.written(part.column("text"))] == want
        assert portion > 1 or len(parts) >= sum(map(bool, texts))


def test_bpe_merge_on_any_rank_table():
    """Against the definition, also where a longer token ranks below its parts."""
    r = random.Random(1)
    for _ in range(300):
        more = list({bytes(r.choices(b"abc", k=r.randint(2, 6))) for _ in range(r.randint(1, 40))})
        r.shuffle(more)
        ranks = {t: i for i, t in enumerate([bytes([b]) for b in range(256)] + more)}
        piece = bytes(r.choices(b"abc", k=60))
        parts = [piece[i : i + 1] for i in range(60)]
        while best := min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None):
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        assert bpe.merge(piece, ranks, bpe.pair_ranks(ranks), list(range(256))) == [ranks[x] for x in parts]
        pieces = [piece, b"", piece[:7], piece[3:30], b"a", piece[::-1]]
        alone = [bpe.merge(p, {}, bpe.pair_ranks(ranks), list(range(256))) for p in pieces]
        assert bpe.merge_many(pieces, bpe.Pairs(bpe.pair_ranks(ranks)), np.arange(256)) == alone


def test_sharding(edge, spark):
    docs = edge.withColumn("Slot", F.lit(1)).unionByName(edge.limit(0).withColumn("Slot", F.lit(1)))
    rows = sharding.shard(docs, n_shards=5, bucket_bytes=4000).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((x[0], x[1]) for x in EDGE)
    for r in rows:
        data = (r.text or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(data) + 8, zlib.crc32(data), "rows")
    counts = Counter(r.shard for r in rows)
    assert max(counts.values()) - min(counts.values()) <= 1
    for s, n in counts.items():
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n))


def test_sharding_writes_and_repeats(documents, spark):
    first = sharding.shard(documents, bucket_bytes=30_000)
    again = sharding.shard(documents, bucket_bytes=30_000)
    assert {(r.doc_id, r.shard, r.slot) for r in first.collect()} == {(r.doc_id, r.shard, r.slot) for r in again.collect()}
    path = warc.new_path(spark, "shards")
    sharding.write_shards(first, path)
    assert spark.read.parquet(path).count() == documents.count()


def test_url_parts_and_rules(spark):
    urls = ["http://EX.org/a?b", "https://a.example.org/es/x", "http://example.org/en/12#z", "x://de.com/de/", "nothing", None, "a://b://c/d", "http://org", "http://org/", "http://borg/", "http://x.com?/fr/", "ftp://com/fr/x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("HOST", F.lit(0))
    out = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.filter_urls(pages, spark.createDataFrame([(0, 1), (1, None)], "page_id long, good int")).collect()}
    assert out == {
        0: ("ex.org", "/a", "org/"), 1: ("a.example.org", "/es/x", "example.org/es/"), 2: ("example.org", "/en/12", "example.org/en/1"), 3: ("de.com", "/de/", "com/de/"),
        4: ("", "", None), 5: ("", "", None), 6: ("b:", "//c/d", None), 7: ("org", "", None), 8: ("org", "/", "org/"), 9: ("borg", "/", None), 10: ("x.com", "", None), 11: ("com", "/fr/x", "com/fr/"),
    }


def test_reputation_blocks_bad_hosts(spark):
    pages = [(i, f"http://{'bad' if i < 40 else 'good'}.net/p{i}") for i in range(80)] + [(99, "http://new.net/")]
    outcomes = [(i, int(i >= 40)) for i in range(80)]
    out = {r.page_id: r.verdict for r in url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int")).collect()}
    assert out[3] == "block" and out[50] == "allow" and out[99] in ("allow", "block")


def test_warc_round_trip(spark):
    long = "é\r\n\r\nWARC/1.1\r\n" * 9000
    rows = [(1, "http://a/", "x"), (2, "http://b/ \r\nc", "x"), (3, None, None), (4, "http://d/", ""), (5, "http://e/", long), (6, "http://f/", long), (None, "http://g/", "x"), (7, "http://h/", "alone"), (7, "http://h/", "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("extra", F.lit(1)).repartition(3)
    path = warc.new_path(spark, "warc")
    warc.write_warc(pages, path)
    out = warc.read_warc(spark, path).collect()
    best = {}
    for i, _, html in rows:
        best[html or ""] = max(best.get(html or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, html in rows:
        data = (html or "").encode()
        alone = sum((h or "") == (html or "") for _, _, h in rows) == 1
        kind = "response" if alone or best[html or ""] == i else "revisit"
        want[(i, len(data), warc.digest(data), kind, best[html or ""] if kind == "revisit" else None)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out) == want
    assert all(bytes(r.payload) == long.encode() for r in out if r.page_id == 6)
    parts = warc.read_parts(spark, path)
    assert parts.where("kind = 'continuation'").count() > 3


def test_foreign_archives_are_read_and_cut_ones_refused(spark, tmp_path):
    """A member for each record, no private fields, no chunked coding, a revisit that refers to a digest."""
    body = b"<p>hello</p>" * 300
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"
    make = lambda kind, block, *more: b"WARC/1.0\r\n" + b"".join(x.encode() + b"\r\n" for x in (f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:{kind}>", *more, f"Content-Length: {len(block)}")) + b"\r\n" + block + b"\r\n\r\n"
    sha = f"WARC-Payload-Digest: sha1:{warc.digest(body)}"
    rows = [make("warcinfo", b"software: x"), make("response", http + body), make("revisit", http, sha)]
    whole = b"".join(gzip.compress(r) for r in rows)
    (tmp_path / "a.warc.gz").write_bytes(whole)
    out = {r.record_type: r for r in warc.read_warc(spark, f"file://{tmp_path}").collect()}
    assert bytes(out["response"].payload) == body and out["response"].payload_digest == warc.digest(body) and out["response"].page_id is None
    assert (out["revisit"].payload_bytes, out["revisit"].payload_digest) == (len(body), warc.digest(body))
    assert [f["warc-type"] for f, _ in warc.parse(warc.inflate(whole))] == ["warcinfo", "response", "revisit"]
    assert [b for _, b in warc.parse(b"".join(rows)[i : i + 7] for i in range(0, len(b"".join(rows)), 7))] == [b"software: x", http + body, http]
    for cut in (whole[:-3], whole[:-20], whole[: len(whole) // 2]):
        with pytest.raises(ValueError):
            list(warc.parse(warc.inflate(cut)))
    for cut in (b"".join(rows)[:-1], rows[1][:40], rows[1][:-300], b"x" + rows[1]):
        with pytest.raises(ValueError):
            list(warc.parse([cut]))
    wrong = gzip.compress(make("response", http + body, f"WARC-Payload-Digest: sha1:{warc.digest(b'x')}"))
    (tmp_path / "a.warc.gz").write_bytes(wrong)
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, f"file://{tmp_path}").collect()


def test_segments_are_verified():
    assert warc.join_segments([2, 1], [b"b", b"a"], 2) == b"ab"
    for numbers, total in (([1, 3], 2), ([1, 1], 2), ([1, 2], 3), ([1, 2], None)):
        with pytest.raises(ValueError):
            warc.join_segments(numbers, [b"a", b"b"], total)
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab\r\n0\r\n\r\n")


def test_null_and_empty_are_groups_of_their_own(spark):
    """In op1 a null host isn't the empty one; in op4 a null language has its own reference."""
    text = "word after word of plain prose that goes on for a while and says nothing much at all today " * 8
    odd = "q7 $ 9 & zz 8 # x% 1 0 5 9 4 " * 20
    rows = [(k, text, None if k < 40 else "", "s", 0) for k in range(40)] + [(40 + k, odd, "", "s", 0) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    counted = quality_rules.text_counts(docs)
    refs = {r.lang_key: list(r.class_ref) for r in quality_rules.references(counted).collect()}
    assert len(refs) == 2 and refs["null"] != refs["="]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)], "doc_id long, quality int, toxic int")
    sites = docs.withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.lit("")))
    assert quality_classifier.classify(sites, labels).count() == 80
    keys = {r[0] for r in sites.select(_common.group_key("source")).collect()}
    assert keys == {"=", "null"}
