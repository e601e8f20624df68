"""Byte-level BPE encoding and decoding in linear time.

A text is cut by the tokenizer's pattern; each match is encoded on its own. Bytes are mapped to Latin-1
characters, so that pyahocorasick's trie over the whole vocabulary finds the longest token at a place. From there the
match is encoded by backtracking: the longest token that may stand beside the one before it is taken; where none may,
the one before gives way to its next shorter one, and its end is closed for good. Whether two tokens may stand side by
side is decided by undoing merges, and memoised per pair. The encoding of a prefix is unique, so each place is closed
at most once and time is linear. The result equals that of applying the merges in rank order.

Nulls and empty texts give no tokens and the digest of no bytes. Repeated rows give equal rows; other columns
of the input are left alone.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import map_text, parts, quoted

#: Matches whose encoding a task keeps; the store is emptied when full, so memory stays bounded.
KEPT_MATCHES = 400_000
KEPT_PAIRS = 1_000_000
#: Longer matches are encoded but not kept.
KEPT_LENGTH = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.joined: dict[tuple[int, int], int] = {}
        reachable = []
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            parts = self._merge(token, rank)
            if len(parts) == 2:
                self.halves[rank] = (parts[0], parts[1])
                self.joined[parts[0], parts[1]] = rank
            elif len(token) == 1:
                self.halves[rank] = None
            else:
                continue  # no sequence of merges makes this token; it only stands for a whole match
            reachable.append((token, rank))
        self.automaton = ahocorasick.Automaton()
        known = {token.decode("latin-1"): rank for token, rank in reachable}
        for name in known:
            self.automaton.add_word(name, True)
        # of every beginning of a token, the longest token that it begins with; of every token, the next shorter one
        self.of: dict[str, int | None] = {"": None}
        for name in sorted(known, key=len):
            for n in range(1, len(name) + 1):
                if name[:n] not in self.of:
                    self.of[name[:n]] = known.get(name[:n], self.of[name[: n - 1]])
        self.shorter = {rank: self.of[name[:-1]] for name, rank in known.items()}
        self.reach = max(map(len, known), default=0)
        self.beside: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}

    def _merge(self, token: bytes, below: int) -> list[int]:
        """The merges of lower rank than ``below``, applied to one token's bytes in rank order."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the encoding of the two tokens' joined bytes is these two tokens."""
        pair = left << 32 | right
        known = self.beside.get(pair)
        if known is None:
            if len(self.beside) >= KEPT_PAIRS:
                self.beside.clear()
            known = self.beside[pair] = self._fits(left, right)
        return known

    def _fits(self, a: int, b: int) -> bool:
        halves, joined = self.halves, self.joined
        limit = 1 << 62
        while True:
            if joined.get((a, b), limit) < limit:
                return False  # this merge would have come before one that made a token here
            # undo the later of the two last merges, on the side that touches the border; at equal rank the
            # merge on the left comes first, hence the limit beyond b
            first, second = halves[a], halves[b]
            if first is not None and (a > b or second is None):
                limit, a = a, first[1]
            elif second is not None:
                limit, b = b + 1, second[0]
            else:
                return True

    def encode_match(self, data: bytes) -> list[int]:
        """Longest match first; where no token may follow the last one, that one gives way to its next shorter one.

        An end position is given up at most once: the encoding of a prefix is unique, so if no token fits behind it
        with one last token, it is no border of the encoding. So time is linear, however often tokens are taken back.
        """
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        text, longest, shorter, token, fits = data.decode("latin-1"), self.longest, self.shorter, self.token, self.fits
        end, at, ids, closed = len(data), 0, [], set()
        rank = longest(text, 0)
        while at < end:
            while rank is not None:
                after = at + len(token[rank])
                if after not in closed and (not ids or fits(ids[-1], rank)):
                    break
                rank = shorter[rank]
            else:
                # nothing stands here: this border is none, and the token before gives way
                closed.add(at)
                rank = ids.pop()
                at -= len(token[rank])
                rank = shorter[rank]
                continue
            ids.append(rank)
            at = after
            rank = longest(text, at) if at < end else None
        return ids

    def longest(self, text: str, at: int) -> int | None:
        """The longest token that stands at a place (every single byte is one)."""
        key = text[at : at + self.reach]
        return self.of[key[: self.automaton.longest_prefix(key)]]

    def encode_packed(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers."""
        kept, out = self.kept, []
        for match in self.find(text):
            packed = kept.get(match)
            if packed is None:
                packed = np.array(self.encode_match(match.encode("utf-8")), dtype="<u4").tobytes()
                if len(match) <= KEPT_LENGTH:
                    if len(kept) >= KEPT_MATCHES:
                        kept.clear()
                    kept[match] = packed
            out.append(packed)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _codec(ranks: dict[bytes, int], pattern: str) -> Codec:
    """One codec in each worker process, kept while the same ranks are asked for."""
    key = (len(ranks), hash(frozenset(ranks.items())), pattern)
    if _CODECS.get("key") != key:
        _CODECS.clear()
        _CODECS.update(key=key, codec=Codec(ranks, pattern))
    return _CODECS["codec"]


_CODECS: dict = {}


def _per_text(df: DataFrame, ranks: dict[bytes, int], pattern: str, fields: list[pa.Field], keep: list[str], text: str, of: Callable[[Codec, str], tuple]) -> DataFrame:
    # the rank file is one fixed file of a vocabulary (50,000 tokens: 0.4 MB); it does not grow with the data
    shipped = df.sparkSession.sparkContext.broadcast(ranks)

    def make():
        codec = _codec(shipped.value, pattern)
        return lambda t: of(codec, t or "")

    return map_text(df, keep, text, fields, make)


def encode(df: DataFrame, ranks_path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """Every row's whole text as ``ids`` (array of int), beside the columns ``keep``."""
    return _per_text(df, read_ranks(ranks_path), pattern, [pa.field("ids", pa.list_(pa.int32()))], keep, text, lambda c, t: (np.frombuffer(c.encode_packed(t), dtype="<u4").astype("i4"),))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """The text of each row's ``ids``, by a lookup in the vocabulary; a column named ``out`` is replaced, others stay."""
    shipped = df.sparkSession.sparkContext.broadcast({rank: token for token, rank in read_ranks(ranks_path).items()})
    kept = [c for c in df.columns if c != out]
    plain = df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept)], F.col(quoted(ids)).alias("ids"))
    schema = StructType([*plain.schema.fields[:-1], StructField("text", StringType())])

    def run(batches):
        token = shipped.value
        for batch in parts(batches):
            texts = pa.array([None if row is None else b"".join(map(token.__getitem__, row)).decode("utf-8", "replace") for row in batch.column(len(kept)).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=schema.names)

    return plain.mapInArrow(run, schema).toDF(*kept, out)


def token_digests(df: DataFrame, ranks_path: str, pattern: str, keep: list[str], text: str = "text") -> DataFrame:
    """Encode and decode every whole text; return counts and digests in place of the ids (one pass)."""

    def both(codec: Codec, t: str) -> tuple[int, str, str]:
        packed = codec.encode_packed(t)
        back = codec.decode_bytes(np.frombuffer(packed, dtype="<u4").tolist())
        return len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest()

    fields = [pa.field("n_tokens", pa.int64()), pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())]
    return _per_text(df, read_ranks(ranks_path), pattern, fields, keep, text, both)


def op10_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])
    return out.select("doc_id", F.col("n_tokens"), "ids_sha256", "decoded_sha256")
