"""Pre-token splitting of byte-level BPE, and the bounded memo that tokenizer workers keep.

`split` gives what the published pattern of these vocabularies gives::

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

Python's `re` has no ``\\p{..}``, but on texts without a few odd code points ``[^\\W\\d_]`` is ``\\p{L}``, ``\\d`` is
``\\p{N}`` and ``[^\\s\\w]`` is the rest, at about twice the speed of an engine that has it. Other texts go to the splitter
of the `tokenizers` library, which knows newer Unicode tables than Python.
"""
from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache
from typing import Any

_PLAIN = re.compile(r" ?[^\W\d_]+| ?\d+|'(?:[stmd]|re|ve|ll)| ?[^\s\w]+|\s+(?!\S)|\s+")
#: Latin-1 bytes on which the two patterns differ: separators that Python calls white space, "_", superscripts, fractions.
_ODD_LATIN = b"\x1c\x1d\x1e\x1f_\xb2\xb3\xb9\xbc\xbd\xbe"
_ODD = frozenset(_ODD_LATIN.decode("latin-1"))


def is_plain(text: str) -> bool:
    try:
        b = text.encode("latin-1")
    except UnicodeEncodeError:
        # No, Nl: numbers that are no decimal digits; Cn: unassigned in Python's tables
        return not any(c in _ODD or unicodedata.category(c) in ("No", "Nl", "Cn") for c in set(text))
    return len(b.translate(None, _ODD_LATIN)) == len(b)


@cache
def _library_splitter():
    from tokenizers.pre_tokenizers import ByteLevel
    return ByteLevel(add_prefix_space=False, use_regex=True)


def split(text: str) -> list[str]:
    """Pre-tokens of a whole text, in order; joined they are the text again."""
    if is_plain(text):
        return _PLAIN.findall(text)
    return [text[a:b] for _, (a, b) in _library_splitter().pre_tokenize_str(text)]


class Memo(dict):
    """``memo[key]`` is ``make(key)``, remembered within a bound.

    When ``size`` keys are held, they become the old generation; keys used again move to the new one. Never more than
    twice ``size`` keys are in memory, and frequent keys are never forgotten for long. Keys longer than ``longest``
    are not kept, so very long pre-tokens can't fill a worker.
    """

    def __init__(self, make: Callable[[Any], Any], size: int = 150_000, longest: int = 64) -> None:
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.size:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value
