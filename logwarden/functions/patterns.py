"""Regular expressions as the cheapest equivalent column predicate.

The rule patterns are mostly alternations, and many alternatives are plain
words.  A plain word is tested with ``contains`` (a byte scan inside generated
code); the other alternatives reach the regex engine only for rows that
contain all of their fixed parts.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from logwarden.functions.text import any_true, has

_META = set(r".*+?()[]{}^$|")
_ESCAPED_CLASS = re.compile(r"\\[dDsSwWbB]")
_UPPER_CLASS = re.compile(r"\[[A-Z]-[A-Z]\]")


def split_alternatives(pattern: str) -> list[str]:
    """Split on ``|`` outside groups and character classes."""
    parts, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    parts.append(pattern[start:])
    return parts


def plain_word(alternative: str) -> str | None:
    """The literal text an alternative stands for, or None if it is a regex."""
    out, i = [], 0
    while i < len(alternative):
        ch = alternative[i]
        if ch == "\\":
            nxt = alternative[i + 1]
            if nxt.isalnum():
                return None
            out.append(nxt)
            i += 1
        elif ch in _META:
            return None
        else:
            out.append(ch)
        i += 1
    return "".join(out)


def needs_upper_case(alternative: str) -> bool:
    """True when only text with an upper-case letter can match."""
    if _UPPER_CLASS.search(alternative):
        return True
    bare = _ESCAPED_CLASS.sub("", alternative)
    bare = re.sub(r"\[[^\]]*\]", "", bare)
    return any("A" <= ch <= "Z" for ch in bare)


def required_words(alternative: str) -> list[str]:
    """Texts that every match of the alternative contains.

    Only characters outside groups and classes that are not optional count.
    """
    words, run, depth, i = [], "", 0, 0

    def close() -> None:
        nonlocal run
        if len(run) > 1:
            words.append(run)
        run = ""

    while i < len(alternative):
        ch = alternative[i]
        literal = None
        if ch == "\\":
            i += 1
            literal = None if alternative[i].isalnum() else alternative[i]
        elif ch == "[":
            i = alternative.index("]", i)
        elif ch == "{":
            i = alternative.index("}", i)
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch not in _META:
            literal = ch
        quantified = alternative[i + 1 : i + 2]
        if literal is None or depth:
            close()
        elif quantified and quantified in "?*{":
            close()
        else:
            run += literal
            if quantified == "+":
                close()
        i += 1
    close()
    return words


def java_regex(pattern: str) -> str:
    """Pattern with line ends and white space as the rule texts mean them:
    ``.`` stops only at a line feed, ``$`` is the very end of the text."""
    out = pattern.replace(r"[\s]", r"\s")
    out = re.sub(r"\\.", lambda m: r"[\t\n\f\r ]" if m.group(0) == r"\s" else m.group(0), out)
    if out.endswith("$"):
        out = out[:-1] + r"\z"
    return "(?d)" + out


def matches(text: Column, pattern: str, mode: str = "reference") -> Column:
    """``pattern`` is found in the lower-cased column ``text``.

    ``mode="reference"``: the pattern is case-sensitive, so an alternative
    with an upper-case letter is dead and is dropped here.
    ``mode="intent"``: such alternatives are lower-cased and do match.
    """
    words, regexes = [], []
    for alternative in split_alternatives(pattern):
        if needs_upper_case(alternative):
            if mode == "reference":
                continue
            alternative = _lower_pattern(alternative)
        word = plain_word(alternative)
        if word is None:
            regexes.append(alternative)
        else:
            words.append(word)
    tests = []
    if words:
        tests.append(has(text, *words))
    for regex in regexes:
        # Cheap necessary conditions first: the regex engine then only sees
        # the few rows that already contain all the fixed parts.
        guards = [text.contains(w) for w in required_words(regex)]
        tests.append(reduce(and_, guards + [text.rlike(java_regex(regex))]))
    return any_true(tests) if tests else F.lit(False)


def _lower_pattern(pattern: str) -> str:
    return re.sub(r"\\.|[A-Z]", lambda m: m.group(0) if m.group(0)[0] == "\\" else m.group(0).lower(), pattern)
