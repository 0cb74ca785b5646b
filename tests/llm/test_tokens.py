"""Splitting, byte-level BPE, token counts and packing against the libraries."""
import base64
import hashlib
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

from tracesieve.llm import bpe, packing, pretokens, token_counts

PLAIN = ByteLevel(add_prefix_space=False, use_regex=True)


@pytest.fixture(scope="module")
def multi():
    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))


def split_plainly(text):
    return [text[a:b] for _, (a, b) in PLAIN.pre_tokenize_str(text)]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="ab 'srtvemld\n\t_1½²é!?\x1c\x85\xa0 ñ", max_size=60)))
def test_split(text):
    assert pretokens.split(text) == split_plainly(text)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text(alphabet="abehinrst", max_size=200)))
def test_bpe_encodes_like_the_library(text):
    e = bpe.load(bpe.VOCABULARY)
    ids = _ENCODING.encode_ordinary(text)
    assert e.encode(text) == struct.pack(f"<{len(ids)}I", *ids)
    assert e.decode(e.encode(text)) == text.encode()


with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as _f:
    _ENCODING = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                  mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, _f)})


def test_bpe_on_small_vocabulary():
    """Pairs that merge out of order, and a position that must be given up."""
    words = [b"ab", b"bc", b"abc", b"cd", b"bcd", b"aa", b"aaa", b"ba"]
    ranks = {bytes([i]): i for i in range(256)} | {w: 256 + i for i, w in enumerate(words)}
    e, t = bpe.ByteBpe(ranks), tiktoken.Encoding("x", pat_str=r"[^ ]+| ", mergeable_ranks=ranks, special_tokens={})
    import itertools
    for n in range(1, 7):
        for s in map("".join, itertools.product("abcd", repeat=n)):
            assert e.encode_piece(s) == t.encode_ordinary(s), s


def test_memo_is_bounded():
    m = pretokens.Memo(lambda k: len(k), size=10)
    assert all(m[f"k{i % 37}"] == len(f"k{i % 37}") for i in range(500))
    assert len(m) <= 10 and len(m.old) <= 10


def test_round_trip(docs, rows, multi):
    got = Counter(bpe.round_trip(docs).collect())
    want = Counter()
    for k, t in rows:
        ids = multi.encode_ordinary(t or "")
        want[k, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert got == want
    decoded = bpe.decode_documents(bpe.encode_documents(docs)).collect()
    assert Counter((r[0], bytes(r[1])) for r in decoded) == Counter((k, (t or "").encode()) for k, t in rows)


def test_counts(docs, rows, library):
    want = Counter()
    for k, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want[k, len((t or "").encode()), n, n > 512] += 1
    assert Counter(token_counts.count_tokens(docs).collect()) == want


def best_fit(lengths, capacity):
    """Bins of a plain best-fit-decreasing pass."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= n]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= n
        else:
            left.append(capacity - n)
    return len(left)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=120))
def test_plan_is_best_fit_decreasing(lengths):
    plan, rank, used = packing.plan_bins(Counter(lengths), 30), Counter(), defaultdict(list)
    for n in lengths:
        b, offset = packing.place(plan[n], n, rank[n])
        rank[n] += 1
        used[b].append((offset, n))
    assert len(used) == best_fit(lengths, 30)
    for pieces in used.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 30


def test_packing(docs, rows, library):
    got = packing.pack(docs).collect()
    want = Counter()
    lengths = []
    for k, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for piece, start in enumerate([0, *range(first, len(ids), 1024)]):
            part = ids[start:start + (1024 if piece else first)]
            lengths.append(len(part))
            want[k, piece, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))] += 1
    assert Counter(r[:5] for r in got) == want
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for pieces in used.values():
        ends = [0, *(o + n for o, n in sorted(pieces))]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 1024
    assert len(used) == best_fit(lengths, 1024)


@pytest.fixture(scope="module")
def one_piece():
    return packing.piece_encoder(token_counts.TOKENIZER)


@given(text=st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcdefgh eéü'0 \n")), max_size=40))
@settings(max_examples=400, deadline=None)
def test_pieces_encode_like_the_library(one_piece, text):
    one, lib = one_piece, token_counts.library(token_counts.TOKENIZER)
    for piece in pretokens.split(text):
        if not lib.holds_special(piece):
            assert one(piece) == lib.whole(piece)


def test_vocabulary_encodes_to_itself(one_piece):
    """Every pre-token of the vocabulary is one token by merging by rank too."""
    assert all(len(one_piece(p)) == 1 for p in token_counts.vocabulary_pretokens(token_counts.TOKENIZER))


def test_empty_tables(nothing):
    assert bpe.round_trip(nothing).collect() == token_counts.count_tokens(nothing).collect() == packing.pack(nothing).collect() == []
