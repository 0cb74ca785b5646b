"""Fuzzy matching of tokens against a word list."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the keyword list, in lookup order
KEYWORDS = (
    "int", "float", "double", "char", "bool", "void", "return", "if", "else", "while", "for", "do", "switch", "case", "break",
    "continue", "class", "struct", "public", "private", "protected", "new", "delete", "true", "false", "const", "static",
    "namespace", "include", "template", "virtual")


def nearest_word(tokens: DataFrame, token: str, words: Sequence[str] = KEYWORDS, edits: int = 2, shortest: int = 3) -> DataFrame:
    """(token, word, distance): same first letter, similar length, fewest edits, first in list order.

    The word list is a plan constant of known size, so it is broadcast; the join key is the first
    letter. ``tokens`` should be distinct, so the work grows with the vocabulary, not the text.
    """
    dim = tokens.sparkSession.createDataFrame([(w[0].lower(), w, i) for i, w in enumerate(words)], "__f string, word string, __ord int")
    low = F.lower(F.col(token))
    t = tokens.where(F.length(token) >= shortest).withColumn("__f", F.substring(low, 1, 1))
    j = t.join(F.broadcast(dim), "__f").where(F.abs(F.length(token) - F.length("word")) <= edits)
    d = j.withColumn("distance", F.levenshtein(low, F.lower("word"), edits)).where("distance >= 0")
    return d.groupBy(token).agg(F.min(F.struct("distance", "__ord", "word")).alias("__m")) \
        .select(token, "__m.word", "__m.distance")
