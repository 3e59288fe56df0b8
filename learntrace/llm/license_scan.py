"""Licences: Aho-Corasick finds tags and notice phrases, a shunting-yard parser evaluates expressions.

Words are runs of digits, a to z (A to Z lower-cased) and characters outside ASCII; phrases are
matched on whole words.

Defined results: a null text counts as empty: no words, no places, empty labels, score 0; texts are
scanned whole; each row is judged alone; an empty table gives an empty table; other columns stay. An
expression ends where its grammar does; one that is not whole counts as its identifiers joined by AND, and is
marked ``malformed``; a tag without any identifier says nothing, nor does one before NONE or before a sentence: a single
word that is no known identifier has a digit or a hyphen, or ends its line.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases whose places are counted, with their labels.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Phrase: label, weight of the evidence.
PHRASES = {
    "mit license": ("mit", 0.8), "permission is hereby granted free of charge": ("mit", 0.9), "apache license": ("apache", 0.8), "apache license version 2 0": ("apache-2.0", 0.9),
    "lesser general public license": ("lgpl", 0.8), "affero general public license": ("agpl", 0.8), "mozilla public license": ("mpl", 0.8), "eclipse public license": ("epl", 0.8),
    "bsd license": ("bsd", 0.8), "redistribution and use in source and binary forms": ("bsd", 0.9), "isc license": ("isc", 0.8), "boost software license": ("bsl", 0.8),
    "cc by nc": ("cc-by-nc", 0.8), "cc by sa": ("cc-by-sa", 0.8), "cc by nd": ("cc-by-nd", 0.8), "cc0": ("cc0", 0.7), "creative commons": ("creative-commons", 0.6),
    "public domain": ("public-domain", 0.5), "the unlicense": ("unlicense", 0.7), "copyright": ("copyright", 0.3),
}
BASE_WEIGHTS = {"cc-by": 0.7, "gpl": 0.8, "reserved": 0.5}
#: Tags before an expression, as they stand in a text.
TAGS = ("spdx-license-identifier:", "license-expression:")
#: From the most to the least open; OR takes the most open side, AND the least open.
CLASSES = ("permissive", "weak copyleft", "strong copyleft", "restricted", "unknown")
_CLASS_OF = (
    (re.compile(r"(?i)^(mit|apache|bsd|isc|bsl|zlib|unlicense|cc0|cc-by-\d|0bsd)"), 0), (re.compile(r"(?i)^(lgpl|mpl|epl|cddl)"), 1),
    (re.compile(r"(?i)^(agpl|gpl|cc-by-sa)"), 2), (re.compile(r"(?i)^(cc-by-n[cd]|licenseref-proprietary|busl)"), 3),
)
_PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}
#: A parenthesis, or an identifier: letters, digits, dots and hyphens between letters or digits, with an
#: optional plus; a reference may name a document before a colon.
_TOKEN = re.compile(r"[ \t]*([()]|(?:DocumentRef-[A-Za-z0-9.-]*[A-Za-z0-9]:)?[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\+?)")


#: What stands for no licence.
_NOTHING = frozenset(("NONE", "NOASSERTION"))
#: The end of a line, after marks such as those that close a comment.
_LINE_END = re.compile(r"[^\w\n]*(?:\n|\Z)")


def read_expression(text: str, at: int = 0) -> tuple[list[str], bool, int]:
    """The tokens of the longest expression that starts at a place of a text, whether there is one, and where it ends.

    Reading ends where the grammar does, at the latest at the end of the line. Operators are read in any
    case, but in lower case only before a parenthesis or an identifier of a known family, for a sentence
    may go on there. If no expression is whole, the tokens are the ones that could be read."""
    tokens: list[str] = []
    whole = depth = 0
    end = at
    state = "start"  # start: an operand must follow; simple: after an identifier; whole: after ) or an exception; with: an exception must follow
    while m := _TOKEN.match(text, at):
        t = m[1]
        if state in ("start", "with"):
            if t == "(" and state == "start":
                depth += 1
            elif t in "()" or t.upper() in _PRECEDENCE:
                break
            else:
                state = "simple" if state == "start" else "whole"
        elif t == ")" and depth:
            depth -= 1
            state = "whole"
        elif t.upper() in _PRECEDENCE and (state == "simple" or t.upper() != "WITH"):
            following = _TOKEN.match(text, m.end())
            if not following or t.islower() and t != "with" and following[1] != "(" and not known(following[1]):
                break
            state = "with" if t.upper() == "WITH" else "start"
        else:
            break
        tokens.append(t)
        at = m.end()
        if not depth and state in ("simple", "whole"):
            whole, end = len(tokens), at
    return (tokens[:whole], True, end) if whole else (tokens, False, at)


def postfix(tokens: list[str]) -> list[str]:
    """Shunting-yard: the tokens of an expression in postfix order."""
    out: list[str] = []
    stack: list[str] = []
    for t in tokens:
        up = t.upper()
        if up in _PRECEDENCE:
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[up]:
                out.append(stack.pop())
            stack.append(up)
        elif t == "(":
            stack.append(t)
        elif t == ")":
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            out.append(t)
    return out + stack[::-1]


def license_class(identifier: str) -> int:
    return next((k for pattern, k in _CLASS_OF if pattern.search(identifier)), len(CLASSES) - 1)


def known(identifier: str) -> bool:
    return license_class(identifier) < len(CLASSES) - 1 or identifier.startswith(("LicenseRef-", "DocumentRef-"))


def formed(identifier: str) -> bool:
    """Whether an identifier is known or looks like one, and not like a word of a sentence."""
    return known(identifier) or "-" in identifier or any(c.isdigit() for c in identifier)


def evaluate(text: str, at: int = 0) -> tuple[str, list[str], int, bool]:
    """The expression at a place of a text, its identifiers, its class and whether it is whole."""
    tokens, ok, end = read_expression(text, at)
    ids = [t for t in tokens if t not in "()" and t.upper() not in _PRECEDENCE]
    prose = not (ok and (len(ids) > 1 or _LINE_END.match(text, end)))
    if any(t.upper() in _NOTHING for t in ids) or prose and not any(formed(t) for t in ids):
        return "", [], len(CLASSES) - 1, True
    if not ok:
        ids = [t for t in ids if formed(t)]
    shown = " ".join(tokens).replace("( ", "(").replace(" )", ")")
    if not ok:
        return shown, sorted({x.lower() for x in ids}), max((license_class(x) for x in ids), default=len(CLASSES) - 1), False
    stack: list[int | str] = []
    kept: set[str] = set()
    for t in postfix(tokens):
        if t not in _PRECEDENCE:
            stack.append(t)
            continue
        right, left = stack.pop(), stack.pop()
        if t == "WITH":  # an exception only adds permissions
            kept.add(str(left).lower())
            a = license_class(str(left))
            stack.append(max(0, a - 1) if a in (1, 2) else a)
        else:
            kept |= {x.lower() for x in (left, right) if isinstance(x, str)}
            a, b = (license_class(x) if isinstance(x, str) else x for x in (left, right))
            stack.append(min(a, b) if t == "OR" else max(a, b))
    last = stack[0]
    return (shown, [last.lower()], license_class(last), True) if isinstance(last, str) else (shown, sorted(kept), last, True)


@cache
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE_PHRASES, *PHRASES}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


@cache
def _tags() -> ahocorasick.Automaton:
    """Tags are found in the text itself, A to Z lower-cased, for words leave out what follows them."""
    found = ahocorasick.Automaton()
    for tag in TAGS:
        found.add_word(tag, tag)
    found.make_automaton()
    return found


_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def scan(text: str | None) -> dict:
    """What one text says about licences."""
    raw = text or ""
    data = raw.encode("utf-8", "replace")
    words = data.translate(_FOLD).split()
    joined = f" {b' '.join(words).decode('utf-8', 'replace')} "
    places: list[tuple[int, str]] = []
    at = word = 0
    labels: set[str] = set()
    base: set[str] = set()
    score, kind, expressions, malformed = 0.0, None, [], 0
    for end, phrase in _automaton().iter(joined):
        start = end - len(phrase) - 1
        word += joined.count(" ", at, start) if start >= at else -joined.count(" ", start, at)
        at = start
        if phrase in BASE_PHRASES:
            label = BASE_PHRASES[phrase]
            places.append((word, label))
            base.add(label)
            score = max(score, BASE_WEIGHTS[label])
        if phrase in PHRASES:
            label, weight = PHRASES[phrase]
            labels.add(label)
            score = max(score, weight)
    for end, _ in _tags().iter(data.lower().decode("utf-8")):
        expression, ids, k, ok = evaluate(raw, end + 1)
        if ids:
            labels.update(ids)
            expressions.append(expression)
            malformed += not ok
            score = max(score, 1.0 if ok else 0.9)
            kind = k if kind is None else max(kind, k)
    if kind is None and (labels | base):
        kind = max((license_class(x) for x in (labels | base) - {"reserved", "copyright"}), default=3)
    starts = [p[0] for p in places]
    return {
        "n_words": len(words), "n_base": len(places), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | labels)), "score": score, "class": CLASSES[kind] if kind is not None else None, "expressions": expressions, "malformed": malformed,
    }


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()), T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("class", T.StringType()),
    T.StructField("expressions", T.ArrayType(T.StringType())), T.StructField("malformed", T.LongType()),
])


def _scan_all(texts: pd.Series) -> pd.DataFrame:
    rows = pd.DataFrame([scan(t) for t in texts], columns=FOUND.names)
    return rows.astype({"first_word": "Int64", "last_word": "Int64"})


def licenses(text: Column | str) -> Column:
    """A struct of the words, places, labels, score, class and expressions of a text."""
    return F.pandas_udf(_scan_all, FOUND)(text)


def scan_licenses(docs: DataFrame, text: str = "text", out: str = "license") -> DataFrame:
    return docs.withColumn(out, licenses(F.col(text)))


def license_digest(docs: DataFrame) -> DataFrame:
    df = scan_licenses(docs.select("doc_id", "text"))
    return df.select("doc_id", *[F.col(f"license.`{k}`").alias({"class": "license_class"}.get(k, k)) for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "class")])
