"""Token counts against the library on whole texts."""

import random
from pathlib import Path

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm import token_counts as tc

from .conftest import SF

MODEL = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


@pytest.fixture(scope="module")
def sp():
    return sentencepiece.SentencePieceProcessor(model_proto=MODEL)


def texts():
    r = random.Random(3)
    letters = ["a", "e", "the", "▁", " ", "  ", "\n", "\t", "\x00", "é", "日本", "\U0001f600", "<s>", "</s>", "<unk>", "<0x41>", "ﬁ", "　", " ", ".", "ing", "9"]
    return ["", " ", "  ", "a", " a", "a ", "a  ", "▁", "▁▁a▁", *("".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(400)), "x" * 5000, " " * 3000, "ab " * 6000]


def test_pre_tokens_add_up(sp):
    for text in texts():
        assert sum(tc.pieces_of(MODEL, tc.pre_tokens(text))) == len(sp.encode(text)), repr(text)


@pytest.mark.parametrize("head", [0, 50, 1 << 18])
def test_counts_equal_the_library(spark, sp, head):
    rows = [(k % 390 if k % 50 else None, t) for k, t in enumerate([*texts(), None, *texts()[:30]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ROW", F.lit(1)).withColumn("token", F.lit("x")).repartition(5)
    have = sorted(map(tuple, tc.token_counts(docs, MODEL, head=head).collect()), key=repr)
    size = lambda t: len(sp.encode(t or ""))
    assert have == sorted(((i, len((t or "").encode()), size(t), size(t) > 4096) for i, t in rows), key=repr)
    assert any(r[3] for r in have) and tc.token_counts(docs.limit(0), MODEL, head=head).count() == 0


def test_query_counts_every_document(spark, sp, documents):
    have = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tc.op13_token_counts(spark, SF).collect()}
    assert have == {r.doc_id: (len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in documents.collect()}


def test_other_models_are_refused(monkeypatch):
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", lambda model_proto: type("Other", (), {"normalize": lambda self, t: t.strip()})())
    with pytest.raises(ValueError):
        tc.loaded(b"another")
