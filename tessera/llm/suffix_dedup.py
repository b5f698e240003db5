"""Removal of every byte covered by a 400-byte string that starts anywhere else too.

The difference-cover idea, made cheap enough for a corpus: only a sample of the suffixes is named,
and the sample is such that any two equal 400-byte strings hold a sample at the same offset.
The sample here depends on content (the smallest hash of a 200-byte substring inside each
400-byte window) instead of on positions modulo a number, so it has one place in about a
hundred bytes and one owner for each window, where a position-based cover of that reach needs one place in about twenty and
gives a window as many owners as the cover has residues (``difference_cover`` builds that one in full).

1. Sample: name each window by its smallest 200-byte substring; substrings that occur once
   drop out, since no window they own can repeat.
2. Name what is left: each sample owns a run of window starts. The union of the run's windows
   gets a 122-bit name; where a name occurs twice, all windows of the run repeat.
3. Recurse on the rest: runs are cut into blocks of 16 starts at fixed offsets from the sample, then
   into single windows, one representative of every distinct union taking part, as the
   remaining suffixes are merged with the sampled ones.
4. Equal neighbours after grouping by name are the repeats; their bytes are removed.

Several rulers (strings of bytes, runs of words) are applied in one pass over the texts.
Names are counted with map-side partial sums and looked up by joins that AQE can split, so neither a passage in a
third of all documents nor a group of thousands of copies lands in one task, and no pair is listed.

Nulls: a null text is empty (0 bytes, nothing removed, the hash of the empty string); a
null id keeps its row. Repeated rows repeat each other, so both lose every window. Texts under 400
bytes lose nothing. An empty table gives no rows. Extra columns are left out unless they are carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, flagged, released, staged, unflagged
from .hashing import Hashes, WordHashes, mixed

LENGTH, GRAM, BLOCK = 400, 200, 16
WORD_GRAM = 25
OUTPUT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "text")
NAMED = "did long, th long, k int, a int, lo int, hi int, inner_name long, name1 long, name2 long"


class Ruler(NamedTuple):
    """What repeats are measured in, the shortest repeat that goes, and the substring it is sampled by."""

    units: type[Hashes]
    length: int
    gram: int


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours, in a constant number of passes."""
    n = len(x)
    rows = np.concatenate([x, np.full(-n % w, np.iinfo(x.dtype).max, dtype=x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def samples(hashes: Hashes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places, hashes and owned window starts (first, last) of the samples of one text."""
    x = hashes.grams(gram)
    w = length - gram + 1
    least = window_min(x, w)
    edge = np.zeros(w - 1, dtype=np.uint64)
    most = ~window_min(~np.concatenate([edge, least, edge]), w)
    at = np.flatnonzero(most == x)
    h = x[at]
    first = np.empty(len(at), dtype=np.int64)
    first[0] = 0
    first[1:] = np.where(h[:-1] <= h[1:], at[:-1] + 1, np.maximum(at[1:] - (w - 1), 0))
    last = np.append(first[1:] - 1, len(least) - 1)
    last = np.minimum(np.minimum(last, at), len(least) - 1)
    owns = first <= last
    return at[owns], h[owns], first[owns], last[owns]


def _ints(**columns: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({k: np.ascontiguousarray(v).view(np.int64) if v.dtype == np.uint64 else v for k, v in columns.items()})


def _joined(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    if parts:
        yield pd.concat(parts, ignore_index=True)


def _names(hashes: Hashes, did: int, th: int, k: int, a: np.ndarray, lo: np.ndarray, hi: np.ndarray, inner: np.ndarray, length: int) -> pd.DataFrame:
    n = len(a)
    return _ints(
        did=np.full(n, did, dtype=np.int64), th=np.full(n, th, dtype=np.int64), k=np.full(n, k, dtype=np.int32), a=a.astype(np.int32), lo=lo.astype(np.int32), hi=hi.astype(np.int32),
        inner_name=inner, name1=hashes.of(lo, hi + length), name2=hashes.of(lo, hi + length, 1),
    )


def _blocks(a: np.ndarray, lo: np.ndarray, hi: np.ndarray, block: int) -> tuple[np.ndarray, ...]:
    """Runs cut at offsets from the sample that are multiples of ``block``: sample, block number, first, last."""
    near, far = (a - hi) // block, (a - lo) // block
    count = far - near + 1
    which = np.repeat(np.arange(len(a)), count)
    j = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + near[which]
    return a[which], j, np.maximum(lo[which], a[which] - j * block - block + 1), np.minimum(hi[which], a[which] - j * block)


def repeats(docs: DataFrame, id_col: str, text_col: str, rulers: tuple[Ruler, ...], block: int, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """The staged documents (``did, th, doc_id, n_bytes, data, hs, extra``; hs where a sample repeats) and the repeated window
    starts as ``did, th, k, lo, hi``, counted in the units of ruler k. A text has no more units than bytes."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    extra = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("struct<none:int>")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.cast("binary").alias("data"), extra.alias("extra")).withColumns({"did": F.coalesce("doc_id", F.lit(-1)), "th": F.xxhash64("data")})
    rows = rows.withColumn("rk", F.xxhash64("did", "th"))

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for rk, data in zip(pdf["rk"], pdf["data"]):
                for k, ruler in enumerate(rulers):
                    hashes = ruler.units(data)
                    if len(hashes.data) >= ruler.length:
                        h = samples(hashes, ruler.length, ruler.gram)[1]
                        parts.append(_ints(k=np.full(len(h), k, dtype=np.int32), h=h, rk=np.full(len(h), rk, dtype=np.int64)))
            yield from _joined(parts)

    least = min(r.length if r.units is Hashes else 2 * r.length - 1 for r in rulers)
    sampled = staged(rows.where(F.length("data") >= least).select("rk", "data").mapInPandas(sample, "k int, h long, rk long"), "samples")
    often = staged(sampled.groupBy("k", "h").agg(F.count("*").alias("n")).where("n > 1").select("k", "h"), "often")
    # a set of samples is no longer than its text
    wanted = sampled.join(often, ["k", "h"], "left_semi").groupBy("rk").agg(F.collect_set(F.struct("k", "h")).alias("hs"))
    kept = staged(rows.join(wanted, "rk", "left").select("doc_id", "did", "th", F.length("data").cast("long").alias("n_bytes"), "data", "hs", "extra"), "texts")
    discard(sampled, often)
    del sampled, wanted
    released(docs.sparkSession)
    texts = kept.where("hs is not null").select("did", "th", "data", "hs")

    def level0(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for did, th, data, hs in zip(pdf["did"], pdf["th"], pdf["data"], pdf["hs"]):
                for k, ruler in enumerate(rulers):
                    own = np.array([x["h"] for x in hs if x["k"] == k], dtype=np.int64).view(np.uint64)
                    if len(own):
                        hashes = ruler.units(data)
                        a, h, lo, hi = samples(hashes, ruler.length, ruler.gram)
                        live = np.isin(h, own)
                        parts.append(_names(hashes, did, th, k, a[live], lo[live], hi[live], h[live], ruler.length))
            yield from _joined(parts)

    def finer(step: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                parts = []
                for did, th, data, runs in zip(pdf["did"], pdf["th"], pdf["data"], pdf["runs"]):
                    for k, ruler in enumerate(rulers):
                        own = np.array([(r["a"], r["lo"], r["hi"]) for r in runs if r["k"] == k], dtype=np.int64)
                        if len(own):
                            hashes = ruler.units(data)
                            a, j, lo, hi = _blocks(*own.T, step)
                            # what every window of the whole block holds
                            inner = hashes.of(a - j * step, a - j * step - step + 1 + ruler.length)
                            parts.append(_names(hashes, did, th, k, a, lo, hi, inner ^ mixed(j.astype(np.uint64)), ruler.length))
                yield from _joined(parts)

        return run

    out, named = None, staged(texts.mapInPandas(level0, NAMED), "names0")
    for step in (block, 1, 0):
        classes = staged(
            named.groupBy("k", "inner_name", "name1", "name2").agg(F.count("*").alias("n"), F.min(F.struct("did", "th", "a", "lo", "hi")).alias("one")), "classes"
        )
        released(docs.sparkSession)
        again = staged(classes.where("n > 1").select("k", "name1", "name2").distinct(), "again")
        found = staged(named.join(again, ["k", "name1", "name2"], "left_semi").select("did", "th", "k", "lo", "hi"), "found")
        out = out.union(found) if out else found
        discard(named, again)
        if step:
            mixed_up = classes.groupBy("k", "inner_name").agg(F.sum("n").alias("total"), F.min("n").alias("least")).where("total > 1 and least = 1")
            mixed_up = staged(mixed_up.select("k", "inner_name"), "open")
            runs = classes.join(mixed_up, ["k", "inner_name"], "left_semi").select("k", "one.*")
            runs = runs.groupBy("did", "th").agg(F.collect_set(F.struct("k", "a", "lo", "hi")).alias("runs"))
            named = staged(texts.drop("hs").join(runs, ["did", "th"]).mapInPandas(finer(step), NAMED), f"names{step}")
            discard(mixed_up)
        discard(classes)
    return kept, out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, carry: tuple[str, ...] = (), words: int = 0) -> DataFrame:
    """Per document ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, text``, and the columns to be carried.

    ``spans`` are the maximal removed runs as (start, end) bytes; ``text`` is what remains, without the rest of
    characters that were cut in two (the digest is of all bytes that remain). With ``words``, every run of so many
    words that starts anywhere else too, in the same text or another, goes as well, with what separates the words.
    """
    rulers = (Ruler(Hashes, length, gram),) + ((Ruler(WordHashes, words, min(WORD_GRAM, words // 2)),) if words else ())
    kept, found = repeats(docs, id_col, text_col, rulers, block, carry)
    runs = found.groupBy("did", "th").agg(F.collect_set(F.struct("k", "lo", "hi")).alias("runs"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for id_, no_id, data, runs, extra in zip(pdf["id_"], pdf["no_id"], pdf["data"], pdf["runs"], pdf["extra"]):
                data = bytes(data)
                edge = np.zeros(len(data) + 1, dtype=np.int64)
                for k, ruler in enumerate(rulers):
                    own = [(r["lo"], r["hi"]) for r in runs if r["k"] == k] if runs is not None else ()
                    hashes = ruler.units(data) if own else None
                    for lo, hi in own:
                        start, end = hashes.place(lo, hi + ruler.length)
                        edge[start] += 1
                        edge[end] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(turns[::2], turns[1::2])]
                pieces = [data[a:b] for a, b in zip([0, *turns[1::2]], [*turns[::2], len(data)])]
                rest = "".join(p.decode(errors="ignore") for p in pieces)
                rows.append((id_, no_id, len(data), int(gone.sum()), len(spans), hashlib.sha256(b"".join(pieces)).hexdigest(), spans, rest, extra))
            yield pd.DataFrame(rows, columns=["id_", "no_id", *OUTPUT[1:], "extra"])

    kind = kept.schema["extra"].dataType.simpleString()
    schema = f"id_ long, no_id boolean, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>, text string, extra {kind}"
    touched = kept.where("hs is not null").join(runs, ["did", "th"], "left").select(*flagged("doc_id"), "data", "runs", "extra").mapInPandas(cut, schema)
    touched = touched.select(unflagged("doc_id"), *OUTPUT[1:], "extra")
    none = {"n_removed": "0L", "n_spans": "0L", "kept_sha256": "sha2(data, 256)", "spans": "cast(array() as array<struct<start:int,end:int>>)", "text": "cast(data as string)"}
    untouched = kept.where("hs is null").withColumn("doc_id", F.col("doc_id").cast("long")).withColumns({k: F.expr(v) for k, v in none.items()})
    out = touched.unionByName(untouched.select(touched.columns))
    return out.select("*", "extra.*").drop("extra") if carry else out.drop("extra")


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The contract's columns, and the remaining text that they describe."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).drop("spans")


ORACLE_SQL = {
    "op2_suffix_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents),
n AS (SELECT *, length(h) // 2 AS n_bytes FROM d),
w AS (SELECT rid, s, md5(substr(h, 2 * s + 1, 2 * {LENGTH})) AS m FROM (SELECT rid, h, unnest(range(0, n_bytes - {LENGTH - 1})) AS s FROM n WHERE n_bytes >= {LENGTH})),
r AS (SELECT rid, s FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)),
i AS (SELECT rid, s, sum(CASE WHEN s - before <= {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY rid ORDER BY s) AS island
  FROM (SELECT rid, s, coalesce(lag(s) OVER (PARTITION BY rid ORDER BY s), -{2 * LENGTH}) AS before FROM r)),
x AS (SELECT rid, min(s) AS lo, max(s) + {LENGTH} AS hi FROM i GROUP BY rid, island),
g AS (SELECT rid, hi AS from_, coalesce(lead(lo) OVER (PARTITION BY rid ORDER BY lo), 1000000000) AS to_ FROM x UNION ALL SELECT rid, 0, min(lo) FROM x GROUP BY rid),
q AS (SELECT rid, from_, substr(h, 2 * from_ + 1, 2 * (least(to_, n_bytes) - from_)) AS piece FROM g JOIN n USING (rid)),
k AS (SELECT rid, string_agg(piece, '' ORDER BY from_) AS rest,
  string_agg(regexp_replace(regexp_replace(piece, '^([89AB].)+', ''), '([CD].|E.([89AB].)?|F.([89AB].){{0,2}})$', ''), '' ORDER BY from_) AS whole FROM q GROUP BY rid),
t AS (SELECT rid, count(*) AS n_spans, sum(hi - lo) AS gone FROM x GROUP BY rid)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(rest, h))) AS kept_sha256, CASE WHEN whole IS NULL THEN text ELSE decode(unhex(whole)) END AS text FROM n LEFT JOIN t USING (rid) LEFT JOIN k USING (rid)"""
}
