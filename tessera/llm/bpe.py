"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's tokens form a linked list; every adjacent pair that has a merge rank waits in
that rank's bucket of positions. A two-level bitmap marks the ranks whose bucket isn't empty,
so the next rank is two find-first-set steps away however long the pre-token is.
Entries whose pair has changed since are skipped when they come up. Short pre-tokens share one queue, thousands at a time: a
bucket then holds positions in many of them, which are joined together, the leftmost of each.

Texts are cut at single spaces before the pattern runs, which leaves the pre-tokens
unchanged (a match takes a space only at its start), and the pattern runs over each distinct word of a portion of
the documents once; texts with a space before other white space go through the pattern whole. A worker keeps the ids of the
pre-tokens it met last, up to a fixed size. The ids as text and the decoded bytes are made for each distinct word, so a
document joins words instead of ids.

Nulls and empty texts have no tokens: ``n_tokens`` 0 and the hash of the empty string. Repeated rows are
encoded alike; an empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a rank within its span, of a token in a pair.
SPAN, WIDTH = 8, 24
MASK = (1 << SPAN) - 1
#: Single bits; as many spans of ranks at most.
BIT = [1 << k for k in range(1 << 12)]
#: A space before other white space or the end may belong to a longer match.
UNSAFE = re.compile(r" (?:\s|\Z)")
#: Pre-tokens in each of the two generations of a worker's cache, and the longest one kept.
CACHE, LONGEST = 600_000, 64
#: Bytes of new pre-tokens that are merged together.
TOGETHER = 1 << 21
#: Bytes of the texts that share their words, and of those that are encoded text by text, as Arrow's strings end at 2 GB.
PORTION, BULK = 1 << 24, 1 << 27
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def pair_ranks(ranks: dict[bytes, int]) -> dict[int, int]:
    """Rank of every pair of tokens that joins to a token, by ``left << WIDTH | right``."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            left = ranks.get(token[:cut])
            if left is not None and (right := ranks.get(token[cut:])) is not None:
                out[left << WIDTH | right] = rank
    return out


def merge(piece: bytes, ranks: dict[bytes, int], pairs: dict[int, int], single: list[int]) -> list[int]:
    """Token ids of one pre-token.

    The queue's parts are plain locals, as a call for each push and pop would cost more than the step itself:
    ``buckets`` by rank, ``low`` with the bits of each span of ranks, ``top`` with a bit for each span in use.
    A bucket is drained in order of position. No merge can push into the bucket being drained, since
    what it forms is longer; where it pushes a lower rank, the rest of the bucket waits again.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n, rank_of = len(piece), pairs.get
    ids = [single[b] for b in piece]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    waiting = [rank_of(a << WIDTH | b, -1) for a, b in zip(ids, ids[1:])]  # the rank of the pair that starts here now
    waiting.append(-1)
    buckets: dict[int, int | list[int]] = {}  # a position, or several
    low: dict[int, int] = {}
    top = 0
    for i, rank in enumerate(waiting):
        if rank >= 0:
            held = buckets.get(rank)
            if held is None:
                buckets[rank] = i
                word = rank >> SPAN
                low[word] = (low[word] if word in low else 0) | BIT[rank & MASK]
                top |= BIT[word]
            elif held.__class__ is int:
                buckets[rank] = [held, i]
            else:
                held.append(i)
    while top:
        word = (top & -top).bit_length() - 1
        bits = low[word]
        rest = bits & (bits - 1)
        rank = word << SPAN | (bits ^ rest).bit_length() - 1
        if rest:
            low[word] = rest
        else:
            del low[word]
            top &= top - 1
        bucket = buckets.pop(rank)
        if bucket.__class__ is int:
            bucket = (bucket,)
        else:
            bucket.sort()
        for k, i in enumerate(bucket):
            if waiting[i] != rank:
                continue
            gone = after[i]
            after[i] = end = after[gone]
            ids[i] = rank
            waiting[gone] = waiting[i] = -1
            lowest = rank
            if end < n:
                before[end] = i
                new = rank_of(rank << WIDTH | ids[end])
                if new is not None:
                    waiting[i] = new
                    if new < lowest:
                        lowest = new
                    held = buckets.get(new)
                    if held is None:
                        buckets[new] = i
                        word = new >> SPAN
                        low[word] = (low[word] if word in low else 0) | BIT[new & MASK]
                        top |= BIT[word]
                    elif held.__class__ is int:
                        buckets[new] = [held, i]
                    else:
                        held.append(i)
            at = before[i]
            if at >= 0:
                new = rank_of(ids[at] << WIDTH | rank)
                if new is None:
                    waiting[at] = -1
                else:
                    waiting[at] = new
                    if new < lowest:
                        lowest = new
                    held = buckets.get(new)
                    if held is None:
                        buckets[new] = at
                        word = new >> SPAN
                        low[word] = (low[word] if word in low else 0) | BIT[new & MASK]
                        top |= BIT[word]
                    elif held.__class__ is int:
                        buckets[new] = [held, at]
                    else:
                        held.append(at)
            if lowest < rank and k + 1 < len(bucket):
                buckets[rank] = list(bucket[k + 1 :])
                low[rank >> SPAN] = low.get(rank >> SPAN, 0) | BIT[rank & MASK]
                top |= BIT[rank >> SPAN]
                break
    out, i = [], 0
    while i < n:
        out.append(ids[i])
        i = after[i]
    return out


class Pairs:
    """Ranks of pairs of tokens, looked up by the array."""

    def __init__(self, pairs: dict[int, int]) -> None:
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it has none."""
        wanted = left.astype(np.int64) << WIDTH | right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        found = self.ranks[at]
        found[self.keys[at] != wanted] = -1
        return found


def merge_many(pieces: list[bytes], pairs: Pairs, single: np.ndarray) -> list[list[int]]:
    """Token ids of many pre-tokens."""
    ids, stops = merged(pieces, pairs, single)
    flat, stops = ids.tolist(), stops.tolist()
    return [flat[s:e] for s, e in zip([0, *stops[:-1]], stops)]


def merged(pieces: list[bytes], pairs: Pairs, single: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of many pre-tokens and where each one's end, by one queue of the same kind over all their bytes."""
    lengths = np.array([len(p) for p in pieces])
    if not lengths.sum() or not len(pairs.keys):
        return single[np.frombuffer(b"".join(pieces), dtype=np.uint8)], np.cumsum(lengths)
    n, owner = int(lengths.sum()), np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    ids = single.astype(np.int32)[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    ends = np.cumsum(lengths)[lengths > 0]
    after[ends - 1] = n
    before[(ends - lengths[lengths > 0])] = -1
    waiting = np.full(n, -1, dtype=np.int32)
    inner = np.flatnonzero(after < n).astype(np.int32)
    waiting[inner] = pairs.of(ids[inner], ids[inner + 1])
    buckets: dict[int, list[np.ndarray]] = {}
    low: dict[int, int] = {}
    top = 0

    def push(places: np.ndarray) -> None:
        """Let places wait in the buckets of their ranks."""
        nonlocal top
        places = places[waiting[places] >= 0]
        ranks = waiting[places]
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, start, end in zip(ranks[np.append(0, cuts)].tolist() if len(ranks) else (), [0, *cuts.tolist()], [*cuts.tolist(), len(ranks)]):
            held = buckets.get(rank)
            if held is None:
                buckets[rank] = [places[start:end]]
                word = rank >> SPAN
                low[word] = low.get(word, 0) | BIT[rank & MASK]
                top |= BIT[word]
            else:
                held.append(places[start:end])

    push(inner)
    while top:
        word = (top & -top).bit_length() - 1
        bits = low[word]
        rank = word << SPAN | (bits & -bits).bit_length() - 1
        if bits & (bits - 1):
            low[word] = bits & (bits - 1)
        else:
            del low[word]
            top &= top - 1
        held = buckets.pop(rank)
        places = held[0] if len(held) == 1 else np.concatenate(held)
        places = places[waiting[places] == rank]  # the others are stale
        if len(places) > 1:
            places = np.sort(places)
            of = owner[places]
            first = of[1:] != of[:-1]
            later, places = places[1:][~first & (places[1:] != places[:-1])], np.append(places[:1], places[1:][first])
        else:
            later = places[:0]
        if not len(places):
            continue
        gone = after[places]
        end = after[gone]
        after[places], ids[places], ids[gone] = end, rank, -1
        waiting[gone] = waiting[places] = -1
        right = end < n
        a, b = places[right], end[right]
        before[b] = a
        waiting[a] = pairs.of(ids[a], ids[b])
        at = before[places]
        at = at[at >= 0]
        waiting[at] = pairs.of(ids[at], np.full(len(at), rank))
        push(np.concatenate([a, at, later]))
    kept = np.flatnonzero(ids >= 0)
    return ids[kept], np.searchsorted(owner[kept], np.arange(len(pieces)), side="right")


class Segments(NamedTuple):
    """The distinct segments of some texts: segment k has ``ids[starts[k] : starts[k + 1]]``, text i the segments ``codes[texts[i] : texts[i + 1]]``."""

    texts: np.ndarray
    codes: np.ndarray
    starts: np.ndarray
    ids: np.ndarray


def runs(sizes: list[int] | np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut things of some sizes into runs that exceed ``most`` by one thing at most."""
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    return ((start, end) for start, end in zip(cuts, cuts[1:]) if start < end)


def joined(values: pa.Array, at: np.ndarray, starts: np.ndarray, between: str | bytes) -> pa.Array:
    """The values at some places, joined from each start to the next."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values.take(pa.array(at))), between)


class Codec:
    """Encoder and decoder over one rank table."""

    def __init__(self, path: str, pattern: str) -> None:
        import regex

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {v: k for k, v in self.ranks.items()}
        self.pairs = pair_ranks(self.ranks)
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.table, self.bytes = Pairs(self.pairs), np.array(self.single, dtype=np.int64)
        self.find = regex.compile(pattern).findall
        #: By id.
        every = range(max(self.tokens) + 1)
        self.names = pa.array(map(str, every), pa.string())
        self.data = pa.array(map(self.tokens.get, every), pa.binary())
        #: Ids of pre-tokens, as the bytes of 32-bit integers.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids_of(self, tokens: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens; those that are new are merged together, long ones alone."""
        found = list(map(self.young.get, tokens))
        new, pieces = [], []
        for k, known in enumerate(found):
            if known is None:
                token = tokens[k]
                known = self.old.get(token)
                if known is None:
                    piece = token.encode()
                    rank = self.ranks.get(piece)
                    if rank is None and len(token) <= LONGEST:
                        new.append(k), pieces.append(piece)
                        continue
                    known = np.array(merge(piece, self.ranks, self.pairs, self.single) if rank is None else [rank], dtype=np.int32).tobytes()
                found[k] = known
                self._keep(token, known)
        for start, end in runs(list(map(len, pieces)), TOGETHER):
            ids, stops = merged(pieces[start:end], self.table, self.bytes)
            raw, at = ids.astype(np.int32).tobytes(), 0
            for k, stop in zip(new[start:end], (4 * stops).tolist()):
                found[k] = raw[at:stop]
                self._keep(tokens[k], found[k])
                at = stop
        return found

    def _keep(self, token: str, ids: bytes) -> None:
        if len(token) <= LONGEST:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[token] = ids

    def segments(self, texts: pa.Array) -> Segments:
        """The segments of texts without nulls, at most 2 GB: words with the space before them, and for each text what comes
        before its first space or, where it can't be cut at spaces, all of it."""
        plain = texts.to_pylist()
        whole = np.array([UNSAFE.search(t) is not None for t in plain], dtype=bool)
        cut = pc.split_pattern(pc.if_else(pa.array(whole), pa.scalar("", texts.type), texts), " ")
        starts, parts = cut.offsets.to_numpy(), cut.flatten()
        inner = np.ones(len(parts), dtype=bool)
        inner[starts[:-1]] = False
        words = parts.filter(pa.array(inner)).dictionary_encode()
        names = words.dictionary.to_numpy(zero_copy_only=False)
        codes = np.empty(len(parts), dtype=np.int64)
        codes[inner] = words.indices.to_numpy()
        codes[starts[:-1]] = len(names) + np.arange(len(plain))
        tokens = self.find(" " + " ".join(names)) if len(names) else []
        begins = np.flatnonzero(pc.starts_with(pa.array(tokens, pa.string()), " ").to_numpy(zero_copy_only=False)).tolist()
        for text, all_, first in zip(plain, whole.tolist(), parts.take(pa.array(starts[:-1])).to_pylist()):
            begins.append(len(tokens))
            tokens += self.find(text if all_ else first)
        begins.append(len(tokens))
        distinct = pa.array(tokens, pa.string()).dictionary_encode()
        raw = self.ids_of(distinct.dictionary.to_numpy(zero_copy_only=False).tolist())
        ends = np.cumsum([0, *map(len, raw)]) // 4
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(raw), dtype=np.int32))).take(distinct.indices)
        return Segments(starts, codes, lists.offsets.to_numpy()[begins], lists.flatten().to_numpy())

    def written(self, texts: pa.Array) -> Iterator[tuple[int, bytes, bytes]]:
        """For each text the number of its ids, the ids joined by spaces, and the bytes that they decode to."""
        if texts.nbytes > BULK:
            for text in texts.to_pylist():
                ids = self.piece(text)
                yield len(ids), " ".join(map(str, ids)).encode(), self.decode(ids)
        elif len(texts):
            own = self.segments(texts)
            n = np.diff(own.starts)[own.codes]
            some = n > 0  # a text may begin with a space
            names = joined(joined(self.names, own.ids, own.starts, " "), own.codes[some], np.append(0, np.cumsum(some))[own.texts], " ")
            data = joined(joined(self.data, own.ids, own.starts, b""), own.codes, own.texts, b"")
            yield from zip(np.add.reduceat(n, own.texts[:-1]).tolist(), names.cast(pa.binary()).to_pylist(), data.to_pylist())

    def piece(self, text: str) -> list[int]:
        """Ids of a text, its pre-tokens merged one by one."""
        return [i for token in self.find(text) for i in merge(token.encode(), self.ranks, self.pairs, self.single)]

    def encode(self, text: str) -> list[int]:
        return list(map(int, next(self.written(pa.array([text], pa.string())))[1].split()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(vocabulary: str, pattern: str) -> Codec:
    """The codec of a rank file, given by its path or by the name of a public tokenizer, which each worker looks up for itself."""
    if not os.path.isabs(vocabulary):
        import public_tokenizers

        vocabulary = public_tokenizers.path(vocabulary)
    return Codec(vocabulary, pattern)


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of the rows of a batch with a portion of text each, more only where one text is longer."""
    for start, end in runs(pc.binary_length(batch.column("text")).to_numpy(), PORTION):
        yield batch.slice(start, end - start)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def tokenize(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the ids themselves: ``doc_id, ids array<int>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        for batch in batches:
            for part in portions(batch):
                ids = [np.array(names.split(), dtype=np.int32) for _, names, _ in own.written(part.column("text"))]
                yield pa.record_batch([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode, decode and digest every text without keeping the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary, pattern)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in portions(batch):
                rows = [(n, sha(names), sha(data)) for n, names, data in own.written(part.column("text"))]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
                yield pa.record_batch([part.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op6_bpe(spark, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary, public_tokenizers.PATTERN)
