"""Splitting one text into an array of chunks, and re-cutting such an array.

All splits are zero-width or line-wise regular expressions, so a document never
leaves its row: no explode, no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from clauseflow import vocab as V
from clauseflow.functions.text import strip

_WS, _D = V.WS, r"\p{Nd}"
# (?m) line anchors, (?d) only \n ends a line.
BEFORE_ARTICLE = f"(?=제{_WS}*{_D}+{_WS}*조)"
BEFORE_OUTLINE = rf"(?md)(?=^{V.SECTION_NUMBER}{_WS}+.+$)"
_BLANK = V.WS_IN_LINE
# White space before the number stays in its line: blank lines above it belong to the cut
# part's end and are stripped there, and are not tried again from each of them.
BEFORE_GUIDELINE = rf"(?md)(?=^{_BLANK}*{_D}+\.{_WS}+.+$)"

_INK = V.NON_WS


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def split_before(text: Column, pattern: str) -> Column:
    return _kept(F.split(text, pattern))


def split_headings(text: Column, min_chars: int = V.HEADING_MIN_CHARS, max_chars: int = V.HEADING_MAX_CHARS) -> Column:
    """Sections opened by heading lines, each as ``[heading]`` newline body.

    A heading is a short line without a sentence ending.  The newline in front of it
    is the cut, so the first line never opens a section and the heading line stays
    in the body, where it is read back as the label.
    """
    endings = "".join(re.escape(e) for e in V.HEADING_ENDINGS)
    low, high = min_chars - 2, max_chars - 2
    cut = (
        rf"\n(?={_BLANK}*{_INK}[^\n]{{{low},{high}}}(?![{endings}]){_INK}{_BLANK}*(?:\n|\z))"
    )
    bodies = F.split(F.regexp_replace(text, V.LINE_END, "\n"), cut)
    labelled = F.transform(
        bodies,
        lambda body, i: F.struct(
            F.when(i == 0, F.lit(V.FIRST_HEADING))
            .otherwise(strip(F.substring_index(body, "\n", 1))).alias("heading"),
            strip(body).alias("body"),
        ),
    )
    return F.transform(
        F.filter(labelled, lambda s: s["body"] != ""),
        lambda s: F.concat(F.lit("["), s["heading"], F.lit("]\n"), s["body"]),
    )


def enough(parts: Column, min_parts: int = V.MIN_PARTS) -> Column:
    """The parts, or null when the split gave too few of them to be used."""
    return F.when(F.size(parts) >= min_parts, parts)


def fixed_windows(text: Column, size: int = V.WINDOW_CHARS, overlap: int = V.WINDOW_OVERLAP) -> Column:
    """Windows of a fixed width that ignore word and line ends.

    The text is cut once into pieces of the step between windows; a window is a piece and
    the opening of those behind it, so the cost follows the length.
    """
    step = size - overlap
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
    count = F.floor(F.greatest(F.length(text) - (overlap + 1), F.lit(0)) / step).cast("int") + 1
    joined = pieces
    for k in range(1, -(-overlap // step) + 1):
        behind = F.slice(pieces, F.lit(k + 1), F.greatest(F.size(pieces), F.lit(0)))
        joined = F.zip_with(joined, behind, lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return _kept(F.slice(F.transform(joined, lambda p: F.substring(p, 1, size)), F.lit(1), count))


def _runs(text: str, lo: int, hi: int, separators: Sequence[str], size: int) -> Iterator[list[int]]:
    """Cut positions of text[lo:hi], in runs within which windows may slide."""
    if not separators:
        yield [lo, hi]
        return
    for depth, mark in enumerate(separators):
        if mark == "":
            yield list(range(lo, hi + 1))
            return
        first = text.find(mark, lo, hi)
        if first >= 0:
            break
    cuts, at = [lo], first
    while at >= 0:
        if at > lo:
            cuts.append(at)
        at = text.find(mark, at + len(mark), hi)
    cuts.append(hi)
    run = [lo]
    for left, right in zip(cuts, cuts[1:]):
        if right - left < size:
            run.append(right)
            continue
        if len(run) > 1:
            yield run
        yield from _runs(text, left, right, separators[depth + 1:], size)
        run = [right]
    if len(run) > 1:
        yield run


def _windows(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    found = []
    for cuts in _runs(text, 0, len(text), separators, size):
        start = 0
        while True:
            end = max(bisect_right(cuts, cuts[start] + size) - 1, start + 1)
            piece = text[cuts[start]:cuts[end]].strip()
            if piece:
                found.append(piece)
            if end == len(cuts) - 1:
                break
            # Step back over the overlap, but leave room for the next piece.
            floor = max(cuts[end] - overlap, cuts[end + 1] - size)
            start = min(bisect_left(cuts, floor, start), end)
    return found


def _recut_udf(size: int, overlap: int, separators: Sequence[str]):
    @F.pandas_udf("array<string>")
    def recut(lists: pd.Series, limits: pd.Series) -> pd.Series:
        out: list[list[str] | None] = []
        for parts, limit in zip(lists, limits):
            if parts is None:
                out.append(None)
                continue
            cut: list[str] = []
            for part in parts:
                if len(part) > limit:
                    cut.extend(_windows(part, size, overlap, separators))
                else:
                    cut.append(part)
            out.append(cut)
        return pd.Series(out, index=lists.index, dtype=object)

    return recut


def recut_over(
    parts: Column,
    limit: Column | int,
    size: int = V.WINDOW_CHARS,
    overlap: int = V.WINDOW_OVERLAP,
    separators: Sequence[str] = V.RECURSIVE_SEPARATORS,
) -> Column:
    """Cuts the parts above ``limit`` into windows that end at line or word ends.

    Arrays with nothing to cut never leave the JVM: they reach the Python worker as
    nulls and are taken from the original column.
    """
    limit = F.lit(limit) if isinstance(limit, int) else limit
    touched = F.exists(parts, lambda p: F.length(p) > limit)
    recut = _recut_udf(size, overlap, separators)
    return F.coalesce(recut(F.when(touched, parts), limit), parts)


def recursive_windows(text: Column, size: int = V.WINDOW_CHARS, overlap: int = V.WINDOW_OVERLAP) -> Column:
    """A whole text as windows; a text within one window is only trimmed."""
    return _kept(recut_over(F.array(strip(text)), size, size, overlap))


def split_long(parts: Column, mode: str = "recursive", max_chars: int = V.LONG_CHUNK_CHARS) -> Column:
    """Cut only the parts above ``max_chars`` into windows."""
    if mode == "recursive":
        return recut_over(parts, max_chars)
    return F.flatten(F.transform(
        parts, lambda p: F.when(F.length(p) <= max_chars, F.array(p)).otherwise(fixed_windows(p))
    ))


def _merged(parts: Sequence[str], min_chars: int) -> list[str]:
    done: list[str] = []
    waiting: list[str] = []
    size = 0
    for part in parts:
        grown = size + len(part) + (1 if waiting else 0)
        if len(part) >= min_chars:
            if waiting:
                done.append("\n".join(waiting))
            done.append(part)
            waiting, size = [], 0
        elif grown >= min_chars:
            done.append("\n".join([*waiting, part]))
            waiting, size = [], 0
        else:
            waiting.append(part)
            size = grown
    if waiting:
        rest = "\n".join(waiting)
        if done:
            done[-1] = f"{done[-1]}\n{rest}"
        else:
            done.append(rest)
    return done


def _merge_udf(min_chars: int):
    @F.pandas_udf("array<string>")
    def merge(lists: pd.Series) -> pd.Series:
        out = [None if parts is None else _merged(parts, min_chars) for parts in lists]
        return pd.Series(out, index=lists.index, dtype=object)

    return merge


def merge_short(parts: Column, min_chars: int = V.SHORT_CHUNK_CHARS) -> Column:
    """Fold short parts together until they reach ``min_chars``.

    A part that is long enough closes the open buffer and stands alone; what is left
    at the end joins the last chunk, or stands alone if there is none.  A fold in the
    JVM copies what it has at every part; arrays with a short part go to Python, which
    passes over them once, and all others never leave the JVM.
    """
    touched = F.exists(parts, lambda p: F.length(p) < min_chars)
    return F.coalesce(_merge_udf(min_chars)(F.when(touched, parts)), parts)
