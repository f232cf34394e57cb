"""Counts of many word lists in one pass over a text, by an automaton of all their phrases.

Lists are patterns of a plain kind: letters, `x?`, `[xy]`, `(a|b)`, and `\\b` or `\\s` at an end. They are written out into
phrases, which one Aho-Corasick automaton finds all at once; what is left to do grows with the phrases found, not with the
lists. Case and word boundaries are those of ASCII.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(r"[A-Za-z0-9_]")


def phrases(pattern: str) -> list[str]:
    """All texts that a pattern matches, in the order in which a search prefers them; \\b and \\s stay as \\x01 and \\x02."""

    def alternatives(at: int) -> tuple[list[str], int]:
        out: list[str] = []
        heads = [""]
        while at < len(pattern) and pattern[at] != ")":
            c = pattern[at]
            if c == "|":
                out, heads, at = out + heads, [""], at + 1
                continue
            if c == "(":
                own, at = alternatives(at + 1)
                at += 1
            elif c == "[":
                end = pattern.index("]", at)
                own, at = list(pattern[at + 1 : end]), end + 1
            elif c == "\\":
                own, at = [{"b": "\x01", "s": "\x02"}[pattern[at + 1]]], at + 2
            else:
                own, at = [c], at + 1
            if at < len(pattern) and pattern[at] == "?":
                own, at = [*own, ""], at + 1
            heads = [h + o for h in heads for o in own]
        return out + heads, at

    return alternatives(0)[0]


class Lexicon:
    """Lists by name, each a list of patterns of which a search takes the first that matches, without overlaps."""

    def __init__(self, lists: dict[str, list[str]]):
        self.names = list(lists)
        found: dict[str, list[tuple[int, int, bool, bool, bool]]] = {}
        for k, patterns in enumerate(lists.values()):
            for rank, phrase in enumerate(x for p in patterns for x in phrases(p)):
                text = phrase.strip("\x01\x02").lower()
                found.setdefault(text, []).append((k, rank, phrase[0] == "\x01", phrase[-1] == "\x01", phrase[-1] == "\x02"))
        self.automaton = ahocorasick.Automaton()
        for text, uses in found.items():
            self.automaton.add_word(text, (len(text), uses))
        self.automaton.make_automaton()

    def counts(self, text: str) -> list[int]:
        t = text.encode("utf-8", "surrogatepass").lower().decode("latin-1")
        hits: list[list[tuple[int, int, int]]] = [[] for _ in self.names]
        for last, (size, uses) in self.automaton.iter(t):
            start, end = last + 1 - size, last + 1
            left = (start > 0 and _WORD.match(t[start - 1]) is not None) != (_WORD.match(t[start]) is not None)
            right = (end < len(t) and _WORD.match(t[end]) is not None) != (_WORD.match(t[last]) is not None)
            gap = end < len(t) and t[end] in " \t\n\r\f\v"
            for k, rank, at_start, at_end, spaced in uses:
                if (left or not at_start) and (right or not at_end) and (gap or not spaced):
                    hits[k].append((start, rank, end + spaced))
        out = []
        for own in hits:
            n = free = 0
            for start, _, end in sorted(own):
                if start >= free:
                    n, free = n + 1, end
            out.append(n)
        return out


def slices(batch: pa.RecordBatch, text: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts, without copies: a part ends with the row that brings its texts to `most` bytes."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(batch.column(text)).to_pylist(), 1):
        size += n or 0
        if size >= most:
            yield batch.slice(start, i - start)
            start, size = i, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def list_counts(text: Column, lists: dict[str, list[str]]) -> Column:
    """A struct of the number of matches of each list; null text counts nothing. Texts are read off the Arrow batch one by
    one."""
    lexicon: list[Lexicon] = []

    @F.arrow_udf(", ".join(f"`{n}` int" for n in lists))
    def run(texts: pa.Array) -> pa.Array:
        if not lexicon:  # made where it is used
            lexicon.append(Lexicon(lists))
        found = [array("i") for _ in lists]
        for t in texts:
            for own, n in zip(found, lexicon[0].counts(t.as_py() or "")):
                own.append(n)
        return pa.StructArray.from_arrays([pa.array(np.frombuffer(own, np.int32)) for own in found], list(lists))

    return run(text)
