"""Texts without their markers of doubt, by a lexer: one pass parts a text into tokens, and the edits are filters over them.

Tokens are spans of mathematics, which no edit touches, markers, words, sentence ends, clause marks and white space of
three kinds. Every edit walks the tokens once, so gaps may be of any length and time is linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon import slices
from .markers import MARKERS, MATH_OR_BOX

Token = tuple[str, str]

_LEXER = re.compile(
    rf"(?P<math>(?s:{MATH_OR_BOX}))|(?P<marker>\b(?i:{'|'.join(MARKERS)})\b)|(?P<end>[.!?])|(?P<cut>[,;:])"
    r"|(?P<blank>[ \t]+)|(?P<line>\n+)|(?P<gap>[^\S \t\n]+)|(?P<word>\w+)|(?P<other>[\W_])"
)
_WHITE = {"blank", "line", "gap"}


def tokens(text: str) -> list[Token]:
    """(kind, text) of all tokens, which put together are the text."""
    return [(m.lastgroup, m[0]) for m in _LEXER.finditer(text)]


def _narrowed(found: list[Token]) -> str:
    """The tokens' text, runs of blanks outside mathematics narrowed to one."""
    out: list[str] = []
    blanks = ""
    for kind, t in found:
        if kind == "blank":
            blanks += t
            continue
        if blanks:
            out.append(" " if len(blanks) > 1 else blanks)
            blanks = ""
        out.append(t)
    return "".join(out) + (" " if len(blanks) > 1 else blanks)


def without_words(text: str, found: list[Token] | None = None) -> str:
    """Without the markers and the white space and punctuation behind each. Where a line, or the text, then begins with a
    clause mark, that goes with the white space around it. What then begins the text or follows a sentence's end and white
    space begins with a capital."""
    kept: list[Token] = []
    swallow = False
    for kind, t in tokens(text) if found is None else found:
        swallow = swallow and (kind in _WHITE or kind in ("end", "cut") or t == "-")
        if kind == "marker":
            swallow = True
        elif not swallow:
            kept.append((kind, " " if kind == "blank" and len(t) > 1 else t))

    lined: list[Token] = []
    white, opening, dropping = [], True, False  # white space not settled yet; whether it began the text; behind a dropped mark
    for kind, t in kept:
        if kind in _WHITE:
            if not dropping:
                white.append((kind, t))
            continue
        before = "".join(w for _, w in white)
        if kind == "cut" and (opening or "\n" in before) and not dropping:
            at = before.find("\n") + 1
            if not opening and at:
                lined.append(("gap", before[:at]))
            white, dropping, opening = [], True, False
            continue
        lined += white
        lined.append((kind, t))
        white, opening, dropping = [], False, False
    lined += white

    out: list[str] = []
    large, ended = True, False  # whether a capital is due; whether a sentence has just ended
    for kind, t in lined:
        if kind in _WHITE:
            large = ended
            out.append(t)
            continue
        if large and kind == "word" and "a" <= t[0] <= "z":
            t = t[0].upper() + t[1:]
        large, ended = False, kind == "end"
        out.append(t)
    return "".join(out)


def _sentences(found: list[Token], lines: bool) -> Iterator[tuple[list[Token], list[Token]]]:
    """Sentences with the white space that parts each from the next: that behind an end mark, or with `lines` line ends too."""
    own: list[Token] = []
    gap: list[Token] = []
    for token in found:
        behind = gap or (own and own[-1][0] == "end")
        if token[0] in _WHITE and ((behind and (not gap or not lines or gap[0][0] != "line")) or (lines and token[0] == "line")):
            gap.append(token)
            continue
        if gap:
            yield own, gap
            own, gap = [], []
        own.append(token)
    yield own, gap


def _trimmed(found: list[Token], chars: str) -> list[Token]:
    """The tokens without these characters at either end; mathematics stays."""
    found = list(found)
    for end, strip in ((0, str.lstrip), (-1, str.rstrip)):
        while found and found[end][0] != "math":
            kind, t = found[end]
            if short := strip(t, chars):
                found[end] = (kind, short)
                break
            found.pop(end)
    return found


def without_clauses(text: str, found: list[Token] | None = None) -> str:
    """Without the clauses that hold a marker, between , ; : and a sentence's end; a sentence that loses one ends with a
    full stop. Runs of blanks are narrowed."""
    out: list[Token] = []
    for own, gap in _sentences(tokens(text) if found is None else found, lines=False):
        if any(kind == "marker" for kind, _ in own):
            kept: list[Token] = []
            clause: list[Token] = []
            for token in [*own, ("stop", "")]:
                clause.append(token)
                if token[0] in ("cut", "stop"):
                    if all(kind != "marker" for kind, _ in clause):
                        kept += clause
                    clause = []
            kept = _trimmed([x for x in kept if x[1]], " ,;:")
            body = kept[:-1] if kept and kept[-1][1] == "\n" else kept
            if kept and (not body or body[-1][0] != "end"):
                kept.append(("end", "."))
            own = kept
        out += own + gap
    return _narrowed(out)


def without_sentences(text: str, found: list[Token] | None = None) -> str:
    """Without the sentences and lines that hold a marker; those left, one a line."""
    kept = []
    for own, _ in _sentences(tokens(text) if found is None else found, lines=True):
        if any(kind not in _WHITE for kind, _ in own) and all(kind != "marker" for kind, _ in own):
            kept.append("".join(t for _, t in own))
    return "\n".join(kept)


#: The edits by name, each a function of a text and, if they are known, its tokens.
EDITS: dict[str, Callable[..., str]] = {"words": without_words, "clauses": without_clauses, "sentences": without_sentences}


def stripped(df: DataFrame, text: str, *edits: str) -> DataFrame:
    """df with a column for each of EDITS in place of the text, which is lexed once for all of them; null stays null.

    A task holds one Arrow batch of texts, and of what it makes no more than a slice of it.
    """
    others = [c for c in df.columns if c != text]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*others).schema) + ", ".join(f"`{e}` string" for e in edits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made: list[list[str | None]] = [[] for _ in edits]
                for t in part.column(text):
                    found = None if (t := t.as_py()) is None else tokens(t)
                    for out, e in zip(made, edits):
                        out.append(None if found is None else EDITS[e](t, found))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in others], *[pa.array(m, pa.string()) for m in made]], [*others, *edits])

    return df.mapInArrow(run, schema)


def _applied(edit: Callable[[str], str]) -> Callable[[Column], Column]:
    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        return pa.array((None if (t := x.as_py()) is None else edit(t) for x in texts), pa.string())

    return run


#: Columns without markers, their clauses or their sentences; null stays null. Several of one text: stripped.
strip_words = _applied(without_words)
strip_clauses = _applied(without_clauses)
strip_sentences = _applied(without_sentences)
