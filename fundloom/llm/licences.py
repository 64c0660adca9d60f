"""License scans: identifier tags and notice phrases by Aho-Corasick, licence expressions by a shunting-yard parser.

A text becomes lower-case ASCII words (other letters stay as they are). One automaton, over all phrases with a blank at each end,
finds all places of all phrases in one pass. Where an identifier tag is found, the expression after it, in the original text, is
evaluated: ``and`` takes the least free licence, ``or`` the freest, ``with`` lifts its licence halfway to freely usable.

The score says how freely the text may be used: 0.5 if it says nothing, else the least of its notices' and expressions' values.
Defined results: a null text is empty; an expression that doesn't parse has no value but keeps its identifiers as labels; phrases may overlap, and all
places count; repeated rows are scanned each; a text of any length is scanned whole, in one pass; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame

from .arrow import map_texts

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: More phrases, with labels of the method's own.
NOTICES = {
    "mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "apache license version 2 0": "apache-2.0",
    "licensed under the apache license": "apache-2.0",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "eclipse public license": "epl",
    "creative commons attribution": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0 1 0": "cc0",
    "public domain": "public-domain",
    "the unlicense": "unlicense",
    "confidential and proprietary": "proprietary",
}
TAG = "spdx license identifier"
#: How freely a licence lets a text be used; by its label, else by the longest start of its identifier that ends at a hyphen, a digit or a dot.
FREE = {
    "public-domain": 1.0, "cc0": 1.0, "unlicense": 1.0, "0bsd": 1.0, "mit": 0.95, "isc": 0.95, "bsd": 0.95, "apache": 0.95, "zlib": 0.95, "cc-by": 0.9, "mpl": 0.7,
    "epl": 0.7, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nc": 0.2, "cc-by-nd": 0.2, "reserved": 0.1, "proprietary": 0.0,
}
SILENT = 0.5
FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,words:long>>, expressions array<string>"

#: Bytes of a word stay, A-Z in lower case; all other ASCII is a blank.
PLAIN = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
EXPRESSION = re.compile(r"spdx[^0-9a-z\u0080-\U0010ffff]+license[^0-9a-z\u0080-\U0010ffff]+identifier[^0-9A-Za-z\u0080-\U0010ffff(\n]*([^\n\r]*)", re.ASCII | re.IGNORECASE)
TOKEN = re.compile(r"\s*(\(|\)|[0-9A-Za-z.+:-]+)")
RANK = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE, TAG: ""}.items():
        made.add_word(f" {phrase} ", (phrase, label))
    made.make_automaton()
    return made


def free(identifier: str) -> float | None:
    starts = [k for k in FREE if identifier.startswith(k) and not identifier[len(k) : len(k) + 1].isalpha()]
    return FREE[max(starts, key=len)] if starts else None


def postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: operands and operators in postfix order, None if the expression isn't one."""
    out, stack, operand_next = [], [], True
    for t in tokens:
        word = t.lower()
        if word in RANK:
            if operand_next:
                return None
            while stack and stack[-1] in RANK and RANK[stack[-1]] >= RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
        elif t == "(":
            if not operand_next:
                return None
            stack.append(t)
        elif t == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if operand_next or not stack:
                return None
            stack.pop()
        else:
            if not operand_next:
                return None
            out.append(word)
            operand_next = False
    return None if operand_next or "(" in stack else out + stack[::-1]


def evaluate(order: list[str]) -> float | None:
    """The value of a postfix expression; a licence that FREE doesn't know has the silent value."""
    stack: list[tuple[float, str]] = []
    for t in order:
        if t not in RANK:
            value = free(t)
            stack.append((SILENT if value is None else value, t))
            continue
        b, a = stack.pop(), stack.pop()
        stack.append(((a[0] + 1) / 2 if t == "with" else min(a[0], b[0]) if t == "and" else max(a[0], b[0]), ""))
    return stack[0][0] if len(stack) == 1 else None


def tokens(expression: str) -> list[str]:
    """Identifiers, operators and parentheses from the start of a line, as far as it reads as an expression."""
    out, at, depth, operand_next = [], 0, 0, True
    while m := TOKEN.match(expression, at):
        t = m[1]
        is_operator = t.lower() in RANK
        if t == ")" and (depth == 0 or operand_next) or t != ")" and is_operator == operand_next:
            break
        depth += (t == "(") - (t == ")")
        operand_next = is_operator or t == "("
        out.append(t)
        at = m.end()
    while out and out[-1].lower() in RANK:
        out.pop()
    return out


def scan(text: str | None) -> tuple:
    """Of one text, what FIELDS names."""
    text = text or ""
    words = text.encode().translate(PLAIN).split()
    joined = b" " + b" ".join(words) + b" "
    spans, tagged, at, start = [], False, 0, 0
    line = joined.decode("latin-1")
    for end, (phrase, label) in automaton().iter(line):
        begin = end - len(phrase) - 1
        if begin >= at:
            start += line.count(" ", at, begin)
        else:
            start -= line.count(" ", begin, at)
        at = begin
        if label:
            spans.append((phrase, label, start, phrase.count(" ") + 1))
        else:
            tagged = True
    base = [s for s in spans if s[0] in BASE]
    labels = {s[1] for s in spans}
    # A phrase within a longer one, as the general licence's in the lesser one's notice, keeps its label but says nothing of its own.
    values, reached = [], 0
    for _, label, begin, n in sorted(spans, key=lambda s: (s[2], -s[3])):
        if begin + n > reached:
            values.append(free(label))
        reached = max(reached, begin + n)
    expressions = []
    for m in EXPRESSION.finditer(text) if tagged else ():
        read = tokens(m[1])
        order = postfix(read)
        labels |= {t.lower().rstrip(".") for t in read if t not in "()" and t.lower() not in RANK}
        if read:
            expressions.append(" ".join(read))
            values.append(evaluate(order) if order else None)
    values = [v for v in values if v is not None]
    at = [s[2] for s in base]
    told = lambda x: ",".join(sorted(x))
    return (len(words), len(base), min(at, default=None), max(at, default=None), told({s[1] for s in base}), told(labels), float(min(values, default=SILENT)), [{"label": s[1], "start": s[2], "words": s[3]} for s in spans], expressions)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with FIELDS."""
    return map_texts(docs, scan, FIELDS, text)
