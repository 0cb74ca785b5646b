"""Byte-level BPE encoding and decoding by backtracking over longest matches.

A sequence of tokens is the BPE encoding of its bytes if and only if every adjacent pair is: encoding the bytes of the two
gives just the two. So a pre-token need not be merged step by step. An automaton over the vocabulary (bytes mapped to Latin-1,
as it works on strings) gives the longest token at every position; the encoder takes it, or the next shorter token that
starts there, if it is compatible with the token before, and steps back where nothing fits. A position that led nowhere is
never entered again, so the work is linear in the bytes. Compatibility is decided once per pair and remembered.
"""
from __future__ import annotations

import base64
import hashlib
import os
import struct
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.llm.frames import map_rows, whole_text
from tracesieve.llm.pretokens import Memo, split

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(name: str) -> str:
    """A path as it is; a bare name among the installed public vocabularies."""
    if os.sep in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class ByteBpe:
    """Encoder and decoder of one rank file: ``ranks`` maps token bytes to ids, lower ids merge first."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import ahocorasick
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.text_of = {i: b.decode("latin-1") for b, i in ranks.items()}
        self.ranks = {t: i for i, t in self.text_of.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.automaton.add_word(t, (len(t), i))
        self.automaton.make_automaton()
        self.pair_memo: dict[tuple[int, int], bool] = {}
        self.shorter_memo: dict[int, int | None] = {}
        self.whole_memo: dict[int, bool] = {}
        self.memo = Memo(lambda piece: struct.pack(f"<{len(ids := self.encode_piece(piece))}I", *ids))

    @classmethod
    def load(cls, path: str) -> "ByteBpe":
        with open(vocabulary_path(path), "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def merge(self, s: str) -> list[int]:
        """Plain BPE: the leftmost pair of lowest rank merges first. Only for the few bytes of a token or a pair."""
        parts = list(s)
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 40:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        known = self.pair_memo.get((a, b))
        if known is None:
            if len(self.pair_memo) > 2_000_000:
                self.pair_memo.clear()
            known = self.pair_memo[a, b] = self.merge(self.text_of[a] + self.text_of[b]) == [a, b]
        return known

    def reachable(self, a: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        if a not in self.whole_memo:
            self.whole_memo[a] = self.merge(self.text_of[a]) == [a]
        return self.whole_memo[a]

    def shorter(self, a: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if a not in self.shorter_memo:
            t = self.text_of[a]
            self.shorter_memo[a] = next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ranks), None)
        return self.shorter_memo[a]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token. A pre-token that is itself a token is that token, as in the library."""
        s = piece.encode("utf-8").decode("latin-1")
        if s in self.ranks:
            return [self.ranks[s]]
        n = len(s)
        longest = [0] * n
        for end, (size, i) in self.automaton.iter(s):  # ends ascend: the last match of a start is its longest
            longest[end + 1 - size] = i
        open_at = [True] * (n + 1)
        ids: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            last = ids[-1] if ids else None
            candidate: int | None = token
            while candidate is not None:
                end = at + len(self.text_of[candidate])
                if open_at[end] and (self.compatible(last, candidate) if last is not None else self.reachable(candidate)):
                    break
                candidate = self.shorter(candidate)
            if candidate is not None:
                ids.append(candidate)
                at = end
                token = longest[at] if at < n else 0
            else:  # nothing fits here: close the position, take a shorter token before it
                open_at[at] = False
                token = ids.pop()
                at -= len(self.text_of[token])
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, struct.unpack(f"<{len(packed) // 4}I", packed)))


@cache
def load(path: str) -> ByteBpe:
    """One encoder per worker process and vocabulary; its memos live as long as the worker."""
    return ByteBpe.load(path)


def encode_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, tokens): ids of every whole text as packed little-endian unsigned 32-bit integers.

    A null or empty text has no tokens; rows, repeated keys and null keys are kept as they are; other columns are left out.
    """
    def make():
        encode = load(vocabulary).encode
        return lambda k, t: (k, encode(t))
    return map_rows(docs.select(F.col(key).cast("long").alias(key), whole_text(text)), make, f"{key} long, tokens binary")


def decode_documents(encoded: DataFrame, key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, bytes) of (key, tokens) as `encode_documents` gives them."""
    def make():
        decode = load(vocabulary).decode
        return lambda k, p: (k, decode(p))
    return map_rows(encoded.select(key, "tokens"), make, f"{key} long, bytes binary")


def round_trip(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of a text's ids and of what they decode to, in one pass.

    The ids don't leave the worker, so nothing but digests is moved. Null texts count as empty.
    """
    def make():
        bpe = load(vocabulary)

        def row(k, t):
            packed = bpe.encode(t)
            return k, len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(bpe.decode(packed)).hexdigest()
        return row
    return map_rows(docs.select(F.col(key).cast("long").alias(key), whole_text(text)), make,
                    f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string")
