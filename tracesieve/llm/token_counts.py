"""Token counts per document by a two-tier lookup, without a shuffle of pre-tokens.

Tier one is a table of frequent pre-tokens and their numbers of tokens, broadcast to the workers. Its size is bounded by
``table_rows``, whatever the corpus. It holds the vocabulary's own whole pre-tokens (one token each) and the most frequent
others of a spread of documents; it only saves work and never decides a count. Tier two is a bounded memo in each worker
that lets the library encode what the table lacks.
"""
from __future__ import annotations

from collections import Counter
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.llm.bpe import vocabulary_path
from tracesieve.llm.frames import map_rows, whole_text
from tracesieve.llm.pretokens import Memo, split

TOKENIZER = "byte_bpe_50k.json"
#: Bound of the broadcast table: about 2 MB as a pickled dictionary.
TABLE_ROWS = 60_000
#: One of so many documents, by hash of its text, is looked at for the table. The work grows with the corpus, the table doesn't.
TABLE_SHARE = 32
#: Pre-tokens that a partition proposes for the table.
PROPOSED = 4_000


class Library:
    """The installed tokenizer, split into pre-tokens where that is exact."""

    def __init__(self, name: str) -> None:
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(vocabulary_path(name))
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> list[int]:
        """Ids of a text, special strings inside it handled as the library does."""
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def holds_special(self, text: str) -> bool:
        return any(s in text for s in self.specials)


@cache
def library(name: str) -> Library:
    return Library(name)


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def vocabulary_pretokens(name: str = TOKENIZER) -> list[str]:
    """Entries of the vocabulary that are pre-tokens by themselves, in the order of their ids."""
    lib, alphabet, out = library(name), byte_alphabet(), []
    for entry, _ in sorted(lib.tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1]):
        try:
            text = bytes(alphabet[c] for c in entry).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if split(text) == [text] and len(lib.whole(text)) == 1:
            out.append(text)
    return out


def frequent_lengths(docs: DataFrame, text: str, name: str, rows: int = TABLE_ROWS) -> dict[str, int]:
    """The broadcast table: pre-token to number of tokens, ``rows`` entries at most.

    Partitions propose their most frequent pre-tokens of the documents looked at, with counts; the sums of those pick the rest of the table.
    """
    table = dict.fromkeys(vocabulary_pretokens(name)[:rows], 1)
    looked = docs.where(F.pmod(F.xxhash64(F.col(text)), F.lit(TABLE_SHARE)) == 0).select(whole_text(text).alias("text"))

    def propose(batches):
        counts: Counter[str] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                counts.update(w for w in split(t) if len(w) <= 64 and w not in table)
            if len(counts) > 40 * PROPOSED:  # bounded: rare ones go first
                counts = Counter(dict(counts.most_common(20 * PROPOSED)))
        import pyarrow as pa
        top = counts.most_common(PROPOSED)
        yield pa.RecordBatch.from_pydict({"piece": [w for w, _ in top], "n": [n for _, n in top]},
                                         schema=pa.schema([("piece", pa.string()), ("n", pa.int64())]))

    best = (looked.mapInArrow(propose, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
            .orderBy(F.desc("n"), "piece").limit(max(0, rows - len(table))))
    lib = library(name)
    return table | {r.piece: len(lib.whole(r.piece)) for r in best.toLocalIterator()}


class TokenCounter:
    """Counts tokens of whole texts: the shared table, then a memo, then the library."""

    def __init__(self, name: str, table: dict[str, int]) -> None:
        self.lib = library(name)
        self.memo = Memo(lambda piece: len(self.lib.whole(piece)))
        self.find = table.get

    def count(self, text: str) -> int:
        if self.lib.holds_special(text):
            return len(self.lib.whole(text))
        find, memo = self.find, self.memo
        return sum(find(w) or memo[w] for w in split(text))


def count_tokens(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str = TOKENIZER,
                 limit: int = 512) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text; over_limit where n_tokens > ``limit``.

    Null and empty texts have no bytes and no tokens. One narrow pass; rows, repeated and null keys stay as they are.
    """
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, text, tokenizer))

    def make():
        count = _counter(tokenizer, table).count

        def row(k, t):
            n = count(t)
            return k, len(t.encode("utf-8")), n, n > limit
        return row
    return map_rows(docs.select(F.col(key).cast("long").alias(key), whole_text(text)), make,
                    f"{key} long, n_bytes long, n_tokens long, over_limit boolean")


_COUNTERS: dict[tuple[str, int], TokenCounter] = {}


def _counter(tokenizer: str, table) -> TokenCounter:
    """The worker's counter for a broadcast table; its memo outlives the task."""
    key = (tokenizer, id(table.value))
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = TokenCounter(tokenizer, table.value)
    return _COUNTERS[key]
