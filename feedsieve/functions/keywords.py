"""Keyword matching: one scan of the text per row, whatever the number of words."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedsieve.functions.bind import let

_CJK = re.compile("[一-鿿]")
_ONE_WORD = re.compile(r"\w+", re.UNICODE)
_SPECIAL = re.compile(r"([\\^$.|?*+()\[\]{}\-#&~])")


def quote(word: str) -> str:
    """Escape a literal for a Java (and RE2) pattern."""
    return _SPECIAL.sub(r"\\\1", word)


def is_cjk(word: str) -> bool:
    return bool(_CJK.search(word))


def _match_lowered(low: Column, word: str) -> Column:
    kw = word.lower()
    whole = F.contains(low, F.lit(kw)) & ~low.rlike(rf"(?U)\.{quote(kw)}[/?#\s]") & low.rlike(rf"(?U)\b{quote(kw)}\b")
    return (F.startswith(low, F.lit(kw)) | whole) if len(kw) >= 2 else whole


def keyword_match(text: Column, word: str) -> Column:
    """One keyword against a text, case-insensitive.

    A CJK word matches as a substring. Any other word matches at the start of the text, else as a
    whole word unless the text also holds it as a web domain ending ('.word/').
    """
    if is_cjk(word):
        return F.contains(text, F.lit(word))
    return let(F.lower(text), lambda low: _match_lowered(low, word))


def matched_words(text: Column, words: tuple[str, ...]) -> Column:
    """Distinct words (lowercased) that match a text; same rule as `keyword_match`.

    All one-word keywords share a single regex scan; phrases are looked for only where the plain
    substring occurs.
    """
    words = tuple(dict.fromkeys(words))
    empty = F.array().cast("array<string>")
    single = [w for w in words if not is_cjk(w) and _ONE_WORD.fullmatch(w)]
    bar = "|".join(sorted({quote(w.lower()) for w in single}, key=lambda q: (-len(q), q)))
    # What stands before a word and what it begins with are looked at before its edge, which costs more.
    first = "".join(sorted({w.lower()[0] for w in single}))

    def found(low: Column) -> Column:
        sets: list[Column] = []
        if single:
            tokens = F.array_distinct(F.regexp_extract_all(low, F.lit(rf"(?U)(?<![a-z])(?=[{first}])\b(?:{bar})\b"), F.lit(0)))
            # A domain ending needs a stop right before a word; most texts have none.
            vetoed = F.when(low.rlike(r"\.\w"), F.regexp_extract_all(low, F.lit(rf"(?U)\.({bar})(?=[/?#\s])"), F.lit(1)))
            sets.append(F.array_except(tokens, vetoed.otherwise(empty)))
            sets.append(F.array_compact(F.array(*[
                F.when(F.startswith(low, F.lit(w.lower())), F.lit(w.lower())) for w in single if len(w) >= 2])))
        others = [w for w in words if w not in single]
        if others:
            sets.append(F.array_compact(F.array(*[
                F.when(F.contains(text, F.lit(w)) if is_cjk(w) else _match_lowered(low, w), F.lit(w.lower()))
                for w in others])))
        out = empty
        for more in sets:
            out = F.array_union(out, more)
        return out

    return let(F.lower(text), found)


def count_hits(hits: Column, words: tuple[str, ...]) -> Column:
    """Number of list entries among the matched words; repeated entries count each time."""
    lowered = [w.lower() for w in words]
    if len(set(lowered)) == len(lowered):
        return F.size(F.array_intersect(hits, F.array(*[F.lit(w) for w in lowered])))
    return sum((F.array_contains(hits, w).cast("int") for w in lowered), F.lit(0))


def any_hit(hits: Column, words: tuple[str, ...]) -> Column:
    return F.arrays_overlap(hits, F.array(*[F.lit(w.lower()) for w in words])) if words else F.lit(False)


def hits_in_order(hits: Column, words: tuple[str, ...]) -> Column:
    """Matched words of a list in list order, spelled as given."""
    pairs = [F.when(F.array_contains(hits, w.lower()), F.lit(w)) for w in words]
    return F.array_compact(F.array(*pairs)) if pairs else F.array().cast("array<string>")
