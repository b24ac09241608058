"""Licence notices and identifiers in texts.

One Aho-Corasick pass over the words of a text finds all phrases at once: notices and the
words of identifier tags. Behind every tag, the raw text is read as a licence expression,
however long, by a shunting-yard parser (``+`` before ``WITH`` before ``AND`` before ``OR``) and evaluated to
how far it restricts use: of ``AND`` both sides bind, of ``OR`` the freer side may be
chosen, an exception (``WITH``) frees a little.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_map, split_words, text_slices, word_spans

# The phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notices, as words, and their labels.
NOTICES = {
    "mit license": "mit",
    "apache license": "apache",
    "apache license version 2 0": "apache-2.0",
    "bsd license": "bsd",
    "isc license": "isc",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "general public license version 2": "gpl-2.0",
    "general public license version 3": "gpl-3.0",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nd": "cc-by-nd",
    "creative commons": "cc",
    "cc0": "cc0",
    "public domain": "public-domain",
    "proprietary and confidential": "proprietary",
}
# Words that announce a licence expression.
TAGS = ("spdx license identifier", "licensed under", "released under")
# How far a family of licences restricts use, by the beginning of its label.
RESTRICTS = {
    "public-domain": 0.0, "cc0": 0.0, "unlicense": 0.0, "0bsd": 0.0,
    "mit": 0.1, "isc": 0.1, "bsd": 0.1, "zlib": 0.1, "apache": 0.15, "cc": 0.3, "cc-by": 0.2,
    "cc-by-sa": 0.5, "cc-by-nc": 0.8, "cc-by-nd": 0.8, "mpl": 0.4, "epl": 0.4, "lgpl": 0.5,
    "gpl": 0.7, "agpl": 0.8, "reserved": 1.0, "proprietary": 1.0,
}
UNKNOWN = 0.9
EXCEPTION_PART = 0.8

# As split_words has them, in characters.
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010FFFF]+")
_COLON = re.compile(r"[^\S\n]*:[^\S\n]*")
_THE = re.compile(r"(?i)\s+the(?=\s)")
_TOKEN = re.compile(r"\s*(?:(\()|(\))|(\+)|([A-Za-z0-9](?:[A-Za-z0-9.:-]*[A-Za-z0-9])?))")
_ORDER = {"or": 1, "and": 2, "with": 3}
_LISTED = re.compile(r"(?:licenseref-[a-z0-9.-]+|(?:mit|isc|bsd|0bsd|zlib|apache|cc0|cc-by|mpl|epl|lgpl|gpl|agpl|unlicense)(?:-[a-z0-9.]+)*)$")


def restriction(label: str) -> float:
    """By the longest family name that begins the label at a whole part."""
    while label:
        if label in RESTRICTS:
            return RESTRICTS[label]
        label = label.rpartition("-")[0]
    return UNKNOWN


def postfix(expression: str, strict: bool = True, at: int = 0) -> list[str] | None:
    """The names and operators, in postfix order, of the expression from ``at`` on; None if
    it is no expression. Reading ends where the expression does, as at the end of a sentence.
    If ``strict``, a line's end ends it too, but in parentheses, and so does a further tag;
    else only names of listed licences count."""
    out: list[str] = []
    waiting: list[str] = []
    want_name, depth = True, 0
    while m := _TOKEN.match(expression, at):
        word = (m.group(4) or "").lower()
        if strict and (not depth and "\n" in expression[at : m.start(m.lastindex)] or word == "spdx-license-identifier"):
            break
        if m.group(1):
            if not want_name:
                break
            waiting.append("(")
            depth += 1
        elif m.group(2):
            if want_name or not depth:
                break
            while waiting[-1] != "(":
                out.append(waiting.pop())
            waiting.pop()
            depth -= 1
        elif m.group(3):
            if want_name or at != m.start(3) or not out or out[-1] in _ORDER:
                break
            out[-1] += "+"
        elif word in _ORDER:
            if want_name:
                break
            while waiting and waiting[-1] != "(" and _ORDER[waiting[-1]] >= _ORDER[word]:
                out.append(waiting.pop())
            waiting.append(word)
            want_name = True
            after = m.end()
            at = after
            continue
        else:
            exception = bool(waiting) and waiting[-1] == "with"
            if not want_name or not (strict or exception or _LISTED.match(word)):
                break
            out.append(word)
            want_name = False
        at = m.end()
    if want_name and waiting and waiting[-1] != "(" and not depth:
        waiting.pop()  # "MIT and the like": the operator belongs to the sentence
        want_name = False
    if want_name or depth or not out:
        return None
    return out + waiting[::-1]


def evaluate(steps: list[str]) -> tuple[set[str], float]:
    """(licences named, restriction of the whole) of a postfix expression."""
    stack: list[tuple[set[str], float]] = []
    for step in steps:
        if step in _ORDER:
            (b, y), (a, x) = stack.pop(), stack.pop()
            if step == "with":
                stack.append((a, x * EXCEPTION_PART))
            else:
                stack.append((a | b, min(x, y) if step == "or" else max(x, y)))
        else:
            stack.append(({step}, restriction(step.rstrip("+"))))
    return stack[0]


def expressions(text: str, tags: list[tuple[str, int]]) -> tuple[set[str], float]:
    """Labels and the highest restriction of the expressions behind all ``tags`` (phrase,
    first word) of a text. An identifier tag without a readable expression gives the label
    ``unreadable``; the words "licensed under" alone give nothing, nor does an identifier's
    name without a colon. Behind a colon that ends a line, listed licences of the next count."""
    labels, score = set(), 0.0
    last = {at + phrase.count(" "): phrase for phrase, at in tags}
    words = enumerate(_WORD.finditer(text)) if last else ()
    for number, word in words:
        if number not in last:
            continue
        if strict := last[number].startswith("spdx"):
            if not (colon := _COLON.match(text, word.end())):
                continue
            steps = postfix(text, True, colon.end())
            if not steps and text[colon.end() : colon.end() + 1] == "\n":
                steps = postfix(text, False, colon.end())
        else:
            the = _THE.match(text, word.end())
            steps = postfix(text, False, the.end() if the else word.end())
        if steps:
            names, value = evaluate(steps)
            labels |= names
            score = max(score, value)
        elif strict:
            labels.add("unreadable")
            score = max(score, UNKNOWN)
    return labels, score


def automaton() -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, *TAGS}:
        machine.add_word(f" {phrase} ", (phrase, phrase.count(" ") + 1))
    machine.make_automaton()
    return machine


def places(machine: ahocorasick.Automaton, words: list[bytes]) -> list[tuple[str, int]]:
    """(phrase, first word) of every place where a phrase's words stand."""
    line = f" {b' '.join(words).decode('latin-1')} "
    out, seen, gaps = [], 0, 0
    for end, (phrase, size) in machine.iter(line):
        gaps += line.count(" ", seen, end + 1)
        seen = end + 1
        out.append((phrase, gaps - 1 - size))
    return out


def _scan(batches):
    machine = automaton()
    for batch in batches:
        for rows, data, offsets in text_slices(batch, 1):
            counts = np.diff(word_spans(data, offsets)[3])
            out = [[] for _ in range(6)]
            for text in rows.column(1).to_pylist():
                found = places(machine, split_words(text))
                starts = [at for phrase, at in found if phrase in BASE]
                base = {BASE[p] for p, _ in found if p in BASE}
                labels = base | {NOTICES[p] for p, _ in found if p in NOTICES}
                score = max(map(restriction, labels), default=0.0)
                if tags := [x for x in found if x[0] in TAGS]:
                    named, value = expressions(text, tags)
                    labels |= named
                    score = max(score, value)
                row = (len(starts), min(starts, default=None), max(starts, default=None),
                       ",".join(sorted(base)), ",".join(sorted(labels)), float(score))
                for column, value in zip(out, row):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(counts.astype(np.int64)), *(pa.array(x, t) for x, t in zip(out, types))],
                ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) per row. The
    counts and word numbers are of the base phrases; labels are distinct, sorted and
    comma-joined; score is the strongest restriction named, 0 if none.

    Null and empty texts have no words, no labels, score 0 and null word numbers. Rows of a
    null id and repeated rows are answered like any other. Other columns are not read,
    whatever their names."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return arrow_map(rows, _scan, "id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
                                  "base_labels string, labels string, score double")


def op7_licenses(spark, folder):
    return scan(spark.read.parquet(f"{folder}/documents.parquet")).withColumnRenamed("id", "doc_id")
