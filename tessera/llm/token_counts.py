"""Token counts of whole texts without their ids.

A sentencepiece BPE model whose pieces hold white space only in front never merges across the end of a word, so a text's
tokens are those of its pre-tokens: runs of spaces with the word behind them. Pieces are therefore counted once for each distinct
pre-token and joined to how often each document holds it:

1. a bounded sample of documents gives the pre-tokens that are asked for most often; they are counted first and sent to
   every task (``HEAD`` entries of at most ``HEAD_CHARS`` characters, whatever the input's size);
2. one pass over the texts makes each document's pre-token frequencies, prices the frequent ones on the spot and emits the rest;
3. the rest is dealt by pre-token, counted once for each, joined to its rows where it was counted, and summed by document.

The sample decides only which way a pre-token goes, never a count. The most frequent pre-tokens stay where they are; should another
turn out hot, Spark splits its partition, and it is counted once in each part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What sentencepiece writes for a space.
SPACE = "▁"
PRE_TOKEN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Documents read to find frequent pre-tokens, about; how many of those are sent to every task, and their longest.
SAMPLE_ROWS, HEAD, HEAD_CHARS = 20_000, 1 << 18, 32
LIMIT = 4096
_MODELS: dict[bytes, object] = {}


def loaded(model: bytes):
    """The processor of a serialised model, one a worker. Refuses models for which words can't be counted apart."""
    if model not in _MODELS:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        apart = sp.normalize("  ﬁ b ") == f"{SPACE * 3}ﬁ{SPACE}b{SPACE}"
        if not apart or any(SPACE in sp.id_to_piece(k).lstrip(SPACE) for k in range(sp.vocab_size())):
            raise ValueError("pieces must hold white space only in front, and texts must be taken as they are behind one space")
        _MODELS[model] = sp
    return _MODELS[model]


def pre_tokens(text: str) -> list[str]:
    """Runs of spaces with what follows them, behind the space that the model puts before a text; none of an empty text."""
    return PRE_TOKEN.findall(SPACE + text.replace(" ", SPACE)) if text else []


def pieces_of(model: bytes, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token. The model adds the first space itself; a lone space is one piece and has nothing to add it to."""
    encoded = loaded(model).encode([t[1:] for t in tokens], num_threads=1)
    return [len(ids) or 1 for ids in encoded]


def frequent(docs: DataFrame, model: bytes, text_col: str, sample_rows: int, head: int) -> dict[str, int]:
    """Pieces of the most frequent pre-tokens of about ``sample_rows`` documents: at most ``head`` short strings reach the driver."""
    n = docs.count()
    if not n or not head:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(t for t in pre_tokens(text or "") if len(t) <= HEAD_CHARS)
        names = list(seen)
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([seen[t] for t in names], pa.int64())], names=["token", "n"])

    sample = docs.select(F.col(text_col).cast("string")).sample(fraction=min(1.0, sample_rows / n), seed=1)
    sums = sample.mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    tokens = [r["token"] for r in sums.orderBy(F.desc("n"), "token").limit(head).select("token").collect()]
    return dict(zip(tokens, pieces_of(model, tokens)))


def token_counts(
    docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, sample_rows: int = SAMPLE_ROWS, head: int = HEAD
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``, one row for each row of ``docs``.

    ``model`` is a serialised sentencepiece model. A null text is empty and has no tokens; null and repeated ids keep a row each;
    other columns are left out whatever their names. Text of special tokens is text, as the model's encoder takes it.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(frequent(docs, model, text_col, sample_rows, head))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with what the head gives, and one for each pre-token outside it."""
        have = known.value
        for batch in batches:
            row, ids, token, n, size, found = [], [], [], [], [], []
            for r, i, t in zip(*(c.to_pylist() for c in batch.columns)):
                total = 0
                for word, times in Counter(pre_tokens(t)).items():
                    if pieces := have.get(word):
                        total += pieces * times
                    else:
                        row.append(r), ids.append(None), token.append(word), n.append(times), size.append(None), found.append(None)
                row.append(r), ids.append(i), token.append(None), n.append(None), size.append(len(t.encode())), found.append(total)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            names = ["row", "doc_id", "token", "n", "n_bytes", "found"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip((row, ids, token, n, size, found), kinds)], names=names)

    priced = rows.mapInArrow(frequencies, "row long, doc_id long, token string, n long, n_bytes long, found long")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """``row, doc_id, n_bytes, n_tokens`` of sorted rows: equal pre-tokens follow each other and are counted once."""
        last, known_last = None, 0
        for batch in batches:
            row, ids, token, n, size, found = (batch.column(k) for k in range(6))
            codes = token.dictionary_encode()
            names = codes.dictionary.to_pylist()
            again = bool(names) and names[0] == last
            counted = [known_last] * again + pieces_of(model, names[again:])
            if names:
                last, known_last = names[-1], counted[-1]
            each = pc.multiply(pa.array(counted, pa.int64()).take(codes.indices), n)
            yield pa.record_batch([row, ids, size, pc.coalesce(each, found)], names=["row", "doc_id", "n_bytes", "n_tokens"])

    key = F.coalesce("token", F.col("row").cast("string"))  # spreads the documents' own rows
    dealt = priced.withColumn("key", key).hint("rebalance", "key").sortWithinPartitions("key").drop("key")
    counted = dealt.mapInArrow(pieces, "row long, doc_id long, n_bytes long, n_tokens long")
    out = counted.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"))
    return out.drop("row").withColumn("over_limit", F.col("n_tokens") > limit)


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)
