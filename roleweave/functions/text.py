"""Row-local text expressions (Columns).

Java and Python regexes differ in what a word character is.  Python's ``\\w``
on ``str`` is "alphanumeric or underscore" over all of Unicode, i.e. the class
``[\\p{L}\\p{N}_]``; Java's ``\\w`` is ASCII unless ``(?U)`` and then also
takes combining marks.  To behave like Python everywhere we never use ``\\w``
or ``\\b`` in a Java pattern: :data:`WORD` and :data:`BOUNDARY` spell them out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NOT_WORD_BEHIND = rf"(?<!{WORD})"
NOT_WORD_AHEAD = rf"(?!{WORD})"
# Python's \b: a word/non-word transition
BOUNDARY = rf"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_regex(py_pattern: str, ignore_case: bool = False) -> str:
    """Turn a Python ``re`` pattern (Unicode ``str`` semantics) into a Java one.

    ``\\b`` becomes :data:`BOUNDARY`, ``\\w``/``\\W`` become explicit classes,
    ``\\d``/``\\s`` keep Python's Unicode meaning through ``(?U)``, and
    case-insensitivity is Unicode-aware like Python's.
    """
    out = []
    i = 0
    in_class = False
    while i < len(py_pattern):
        ch = py_pattern[i]
        if ch == "\\" and i + 1 < len(py_pattern):
            nxt = py_pattern[i + 1]
            if nxt == "b" and not in_class:
                out.append(BOUNDARY)
            elif nxt == "w":
                out.append(r"\p{L}\p{N}_" if in_class else WORD)
            elif nxt == "W" and not in_class:
                out.append(r"[^\p{L}\p{N}_]")
            else:
                out.append(ch + nxt)
            i += 2
            continue
        if ch == "[" and not in_class:
            in_class = True
        elif ch == "]" and in_class:
            in_class = False
        out.append(ch)
        i += 1
    body = "".join(out)
    flags = "(?Ud" + ("iu" if ignore_case else "") + ")"
    # a leading inline flag group of the Python pattern is merged into ours
    m = re.match(r"\(\?([a-z]+)\)", body)
    if m:
        extra = m.group(1).replace("i", "iu")
        body = body[m.end():]
        flags = "(?Ud" + ("iu" if ignore_case else "") + extra + ")"
    return flags + body


def _starts_with_letter(p: str) -> bool:
    """Does every way of matching ``p`` begin with an ASCII letter?  (Conservative:
    a letter, or a non-capturing group whose top-level alternatives all do.)"""
    if not p:
        return False
    if p[0].isascii() and p[0].isalpha():
        return True
    if p.startswith("(?:"):
        depth, alts, cur = 0, [], ""
        for i, ch in enumerate(p[3:], start=3):
            if ch == "(":
                depth += 1
            elif ch == ")":
                if depth == 0:
                    alts.append(cur)
                    rest = p[i + 1:]
                    # a quantifier after the group could make it optional
                    return not rest[:1] in ("?", "*", "{") and all(_starts_with_letter(a) for a in alts)
                depth -= 1
            elif ch == "|" and depth == 0:
                alts.append(cur)
                cur = ""
                continue
            cur += ch
    return False


def bounded_regex(py_pattern: str, ignore_case: bool = False) -> str:
    """Java form of Python's ``\\b(?:pattern)\\b`` (same flags as :func:`java_regex`).

    When the pattern provably starts (ends) with a letter, ``\\b`` there is just
    "no word character before (after)", a single cheap look-around; otherwise the
    full two-sided :data:`BOUNDARY` test is used.  Top-level alternation keeps
    Python's binding (``\\bA|B\\b`` is ``\\bA`` or ``B\\b``).
    """
    if _has_top_level_alternation(py_pattern):
        return java_regex(rf"\b{py_pattern}\b", ignore_case)
    core = java_regex(py_pattern, ignore_case)
    m = re.match(r"\(\?[a-zA-Z]+\)", core)
    flags, body = core[: m.end()], core[m.end():]
    head = NOT_WORD_BEHIND if _starts_with_letter(py_pattern) else BOUNDARY
    tail = NOT_WORD_AHEAD if _ends_with_letter(py_pattern) else BOUNDARY
    return flags + head + "(?:" + body + ")" + tail


def _has_top_level_alternation(p: str) -> bool:
    depth, esc, in_class = 0, False, False
    for ch in p:
        if esc:
            esc = False
            continue
        if ch == "\\":
            esc = True
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            return True
    return False


def _ends_with_letter(p: str) -> bool:
    """Does every way of matching ``p`` end with an ASCII letter?  (Conservative.)"""
    if not p:
        return False
    last = p[-1]
    if last.isascii() and last.isalpha() and (len(p) < 2 or p[-2] != "\\"):
        return True
    if last == ")":
        depth, i = 0, len(p) - 1
        while i >= 0:
            if p[i] == ")":
                depth += 1
            elif p[i] == "(":
                depth -= 1
                if depth == 0:
                    break
            i -= 1
        inner = p[i + 1:-1]
        if not inner.startswith("?:"):
            return False
        inner = inner[2:]
        alts, depth, cur = [], 0, ""
        for ch in inner:
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            if ch == "|" and depth == 0:
                alts.append(cur)
                cur = ""
                continue
            cur += ch
        alts.append(cur)
        return all(_ends_with_letter(a) for a in alts)
    return False


def quote(literal: str) -> str:
    """Java-regex quoting of a literal."""
    return r"\Q" + literal.replace(r"\E", r"\E\\E\Q") + r"\E"


def strip(c: str | Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(col(c), F.lit(""))


def title_case(c: str | Column) -> Column:
    """Python ``str.title()``: upper-case the first letter of every run of letters.

    Spark's ``initcap`` only starts words after spaces ("Back-end"); splitting into
    letter / non-letter runs first gives Python's "Back-End", "B.Tech".
    """
    runs = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def contains_any(c: str | Column, words: Iterable[str]) -> Column:
    """Plain substring containment of any word (Python ``any(w in s ...)``)."""
    words = list(words)
    if not words:
        return F.lit(False)
    target = col(c)
    out = None
    for w in words:
        term = target.contains(w)
        out = term if out is None else (out | term)
    return out


def contains_any_bounded(c: str | Column, words: Iterable[str]) -> Column:
    """Containment of any word with Python word boundaries on both sides.

    One alternation; each alternative is a quoted literal, so it is equivalent
    to testing ``\\bword\\b`` per word when every word starts and ends with a
    word character (true for the place lists).
    """
    words = list(words)
    if not words:
        return F.lit(False)
    alts = "|".join(quote(w) for w in words)
    return col(c).rlike(BOUNDARY + "(?:" + alts + ")" + BOUNDARY)


def skill_regex(word: str) -> str:
    """``(?<!\\w)word(?!\\w)`` with Python's ``\\w``."""
    return NOT_WORD_BEHIND + quote(word) + NOT_WORD_AHEAD


def dictionary_hits(c: str | Column, words: Iterable[str], bounded: bool) -> Column:
    """Sorted array of the dictionary words found in ``c``.

    ``bounded=False``: substring containment.  ``bounded=True``: the word must not
    touch a word character on either side.  The literal ``contains`` runs first, so
    the regex is only evaluated for the few words that occur at all.
    """
    target = col(c)
    words = sorted(set(words))
    whole: list[str] = []
    if bounded:
        # a word of word characters alone is bounded exactly where it is a whole token
        whole = [w for w in words if w and all(ch.isalnum() or ch == "_" for ch in w)]
        words = [w for w in words if w not in set(whole)]
    items = []
    for w in words:
        hit = target.contains(w)
        if bounded:
            hit = hit & target.rlike(skill_regex(w))
        items.append(F.when(hit, F.lit(w)))
    found = F.filter(F.array(*items), lambda x: x.isNotNull()) if items else F.array().cast("array<string>")
    if not whole:
        return found
    tokens = F.split(target, r"[^\p{L}\p{N}_]+")
    return F.sort_array(F.concat(F.array_intersect(F.array(*[F.lit(w) for w in whole]), tokens), found))


def truncate(c: str | Column, n: int) -> Column:
    """Python ``s[:n]``."""
    return F.substring(col(c), 1, n)
