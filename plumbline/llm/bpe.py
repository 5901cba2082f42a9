"""BPE encoding and decoding by tree concatenation.

Texts up to ``LEAF_CHARS`` are encoded as they are.  A longer text is halved until its pieces are short, wherever the
cuts fall, the pieces are spread over the cluster and encoded in parallel, and the halves are joined again level by
level: around each join the tokens of a window are decoded and re-encoded, and the window grows until the new tokens
agree with those of both sides at its edges.  BPE is local: a sequence in which every adjacent pair of tokens comes from
a correct encoding is the encoding, so the joined tokens are those of the whole text.  A window that never agrees ends as
the whole text and is exact as well.

The ranks and the pattern are those of the vocabulary file; a special token in a text is one id.

Defined cases: a null text counts as empty and an empty text has no tokens; equal rows give equal rows; an empty table
gives an empty result; other columns are not looked at.  A very long text is many pieces; the task that joins them
holds 4 bytes for each of its tokens.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices, text_or_empty

LEAF_CHARS = 16_384
AGREE = 4
#: Characters that are read at once, and ids that are decoded at once.
SLICE, DECODE_IDS = 1 << 20, 1 << 16
SPECIAL = "<|endoftext|>"
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


class Codec:
    """Encoder and decoder of one vocabulary of ranks, its pattern and its special tokens; ids are arrays of uint32."""

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("plumbline", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.allowed, self.special = set(special), list(special)

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self.encoding.encode(text, allowed_special=self.allowed, disallowed_special=()), dtype="<u4")

    def decode(self, ids: Sequence[int]) -> bytes:
        return self.encoding.decode_bytes(np.asarray(ids, dtype="<u4").tolist())

    def halves(self, text: str, leaf: int) -> list[str]:
        """``text`` in 2^k pieces of about ``leaf`` characters; no cut falls inside a special token."""
        if len(text) <= leaf:
            return [text]
        at = len(text) // 2
        for token in self.special:
            if (inside := text.find(token, max(0, at - len(token) + 1), at + len(token) - 1)) >= 0:
                at = inside or inside + len(token)
        if not 0 < at < len(text):
            return [text]
        return self.halves(text[:at], leaf) + self.halves(text[at:], leaf)

    def join(self, left: np.ndarray, right: np.ndarray, window: int = 16) -> np.ndarray:
        """The tokens of the text that ``left`` and ``right`` encode the two parts of."""
        if not len(left) or not len(right):
            return left if len(left) else right
        while True:
            a = self._aligned(left, max(0, len(left) - window), -1)
            b = self._aligned(right, min(len(right), window), 1)
            middle = self.encode(self.decode(np.concatenate([left[a:], right[:b]])).decode("utf-8"))
            same = lambda x, y: np.array_equal(x, y)
            agree_left = a == 0 or (a + AGREE <= len(left) and same(middle[:AGREE], left[a : a + AGREE]))
            agree_right = b == len(right) or (b >= AGREE and same(middle[-AGREE:], right[b - AGREE : b]))
            if agree_left and agree_right and (len(middle) >= 2 * AGREE or a == 0 or b == len(right)):
                return np.concatenate([left[:a], middle, right[b:]])
            window *= 2

    def _aligned(self, ids: np.ndarray, at: int, step: int) -> int:
        """The first place from ``at`` on, in direction ``step``, where a character begins."""
        while 0 < at < len(ids) and self.decode(ids[at : at + 1])[0] & 0xC0 == 0x80:
            at += step
        return at

    def concatenate(self, parts: list[np.ndarray]) -> np.ndarray:
        while len(parts) > 1:
            pairs = [self.join(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
            parts = pairs
        return parts[0] if parts else np.zeros(0, dtype="<u4")

    def digest(self, ids: np.ndarray) -> tuple[int, str, str]:
        """Number of ids, and digests of the ids and of the decoded text, which is decoded a run of ids at a time."""
        sha, reader = hashlib.sha256(), codecs.getincrementaldecoder("utf-8")("replace")
        for i in range(0, len(ids), DECODE_IDS):
            sha.update(reader.decode(self.decode(ids[i : i + DECODE_IDS])).encode("utf-8"))
        sha.update(reader.decode(b"", True).encode("utf-8"))
        return len(ids), hashlib.sha256(np.ascontiguousarray(ids, dtype="<u4").tobytes()).hexdigest(), sha.hexdigest()


@lru_cache(maxsize=2)
def _built(ranks_path: str, pattern: str, special: tuple) -> Codec:
    return Codec(ranks_path, pattern, dict(special))


def shared_codec(codec: tuple) -> Codec:
    """The codec of these arguments, built once for all tasks of a Python worker."""
    ranks_path, pattern, special = codec
    return _built(ranks_path, pattern, tuple(sorted(special.items())))


def _encoded(df: DataFrame, codec: tuple, out: str, emit, leaf_chars: int) -> DataFrame:
    """doc_id and what ``emit(codec, ids)`` gives for the ids of every text; ``out`` is its schema.

    Whatever the size of the batches that arrive, texts are read and results given back about ``SLICE`` characters at a time.
    """
    rows = df.select(F.col("doc_id").cast("string"), text_or_empty().alias("text"))  # pandas has no null whole numbers
    names = [f.split()[0] for f in out.split(", ")]
    long_text = F.length("text") > leaf_chars

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared_codec(codec)
        for pdf in batches:
            for part in slices(pdf, "text", SLICE):
                got = pd.DataFrame([emit(c, c.encode(t)) for t in part["text"]], columns=names)
                yield pd.concat([part[["doc_id"]].reset_index(drop=True), got], axis=1)

    def leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared_codec(codec)
        for pdf in batches:
            for part in slices(pdf, "text", SLICE):
                for d, r, t in zip(part["doc_id"], part["_row"], part["text"]):
                    pieces = c.halves(t, leaf_chars)
                    yield pd.DataFrame({"doc_id": d, "_row": r, "n": range(len(pieces)), "piece": pieces})

    def encode_leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared_codec(codec)
        for pdf in batches:
            for part in slices(pdf, "piece", SLICE):
                yield part[["doc_id", "_row", "n"]].assign(ids=[c.encode(p).tobytes() for p in part["piece"]])

    def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by text and piece; a text's pieces are in one partition, but may span batches.
        c, held, key, doc, done, size = shared_codec(codec), [], None, None, [], 0
        for pdf in batches:
            for d, r, ids in zip(pdf["doc_id"], pdf["_row"], pdf["ids"]):
                if r != key and held:
                    done.append((doc, *emit(c, c.concatenate(held))))
                    size += sum(map(len, held))
                    held = []
                    if size > SLICE:
                        yield pd.DataFrame(done, columns=["doc_id", *names])
                        done, size = [], 0
                        release()
                key, doc = r, d
                held.append(np.frombuffer(ids, dtype="<u4"))
        if held:
            done.append((doc, *emit(c, c.concatenate(held))))
        yield pd.DataFrame(done, columns=["doc_id", *names])

    kind = "doc_id string"
    whole = rows.filter(~long_text).mapInPandas(short, f"{kind}, {out}")
    pieces = (
        rows.filter(long_text)
        .withColumn("_row", F.monotonically_increasing_id())
        .mapInPandas(leaves, f"{kind}, _row long, n int, piece string")
        .repartition("_row", "n")
        .mapInPandas(encode_leaves, f"{kind}, _row long, n int, ids binary")
    )
    trees = pieces.repartition("_row").sortWithinPartitions("_row", "n").mapInPandas(joined, f"{kind}, {out}")
    return whole.unionByName(trees).withColumn("doc_id", F.col("doc_id").cast(df.schema["doc_id"].dataType))


def encode(df: DataFrame, codec: tuple, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id and ids (array of int) of every text of ``df`` (doc_id, text, …)."""
    return _encoded(df, codec, "ids array<int>", lambda c, ids: (ids.tolist(),), leaf_chars)


def decode(df: DataFrame, codec: tuple) -> DataFrame:
    """doc_id and text of every row of ``df`` (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared_codec(codec)
        for b in batches:
            texts = [c.decode(ids or []).decode("utf-8", "replace") for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return df.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digest(df: DataFrame, codec: tuple, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded and decoded again, digested where it is."""
    return _encoded(df, codec, DIGEST, lambda c, ids: c.digest(ids), leaf_chars)
