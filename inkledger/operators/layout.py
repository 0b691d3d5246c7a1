"""Text set in lines: wrapping, fitting and justification.

Where a line may break is a property of the characters on both sides. A text
is cut into unbreakable pieces once, and lines are filled with whole pieces.
Sequential by nature, so these run as Arrow functions by the batch.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkledger.functions.text import EMAIL, KINDS, URL

# Characters that may not start or end a line, and that may hang over its end.
NO_START = set("，。、；：？！）】》」』〉〕％,.;:?!)]}%…—’”")
NO_END = set("（【《「『〈〔([{‘“")
HANGING = set("，。、；：,.")
#: Step of shrinking, least share of the size, least leading in sizes, lines at most.
STEP, FLOOR, LEADING, MOST_LINES = 0.94, 0.62, 1.25, 96

_STICKY = re.compile(f"{URL}|{re.sub(r'[+][+]', '+', EMAIL.replace('(?<=\\.[A-Za-z]{2,63})', ''))}|{KINDS['placeholder']}")


_LINES = T.ArrayType(T.StringType())
_FITTED = T.StructType([T.StructField("lines", _LINES), T.StructField("size", T.DoubleType()), T.StructField("leading", T.DoubleType())])


def wide(c: str) -> bool:
    return unicodedata.east_asian_width(c) in "WF"


def width(text: str) -> float:
    """In ems: a wide character is one, any other half."""
    return sum(1.0 if wide(c) else 0.5 for c in text)


def pieces(text: str) -> list[str]:
    """The text in parts that no line may cut; joined, they are the text."""
    if not text:
        return []
    if max(text) < "\u1100":
        # No wide character, so lines break at spaces only, and no token has one.
        words = re.findall(" *[^ ]+ *|^ +$", text)
        out = words[:1]
        for w in words[1:]:
            if w[0] in NO_START:
                out[-1] += w
            else:
                out.append(w)
        return out
    held = set()
    for m in _STICKY.finditer(text):
        held.update(range(m.start() + 1, m.end()))
    out, start = [], 0
    for i in range(1, len(text)):
        a, b = text[i - 1], text[i]
        may = (a == " " and b != " ") or ((wide(a) or wide(b)) and a != " " and b != " ")
        if may and i not in held and b not in NO_START and a not in NO_END:
            out.append(text[start:i])
            start = i
    out.append(text[start:])
    return out


class Measured:
    """A text's pieces with their widths, in half ems, summed up: any number of widths can be tried on it."""

    def __init__(self, text: str):
        self.pieces = pieces(" ".join(text.split()))
        self.starts = [0]
        self.ends = []  # up to which half em a line reaches that ends here: without spaces, and with a mark hung over
        for p in self.pieces:
            narrow = max(p) < "\u1100"
            own = len(p) if narrow else sum(2 if wide(c) else 1 for c in p)
            bare = p.rstrip(" ")
            reach = own - (len(p) - len(bare))
            if len(bare) > 1 and bare[-1] in HANGING:
                reach -= 2 if wide(bare[-1]) else 1
            self.ends.append(self.starts[-1] + reach)
            self.starts.append(self.starts[-1] + own)

    def lines(self, ems: float) -> list[str]:
        """Lines of at most ``ems``, filled one after the other; marks may hang over, and a piece that is too wide is cut."""
        most, out, at, n = math.floor(2 * ems), [], 0, len(self.pieces)
        while at < n:
            stop = bisect.bisect_right(self.ends, self.starts[at] + most, at)
            if stop == at:
                # A piece too wide: its head fills a line, and its rest starts the next.
                cut, rest = self._cut(self.pieces[at], most)
                out += cut
                room = most - sum(2 if wide(c) else 1 for c in rest)
                stop = bisect.bisect_right(self.ends, self.starts[at + 1] + room, at + 1)
                out.append((rest + "".join(self.pieces[at + 1 : stop])).rstrip(" "))
            else:
                out.append("".join(self.pieces[at:stop]).rstrip(" "))
            at = stop
        return [x for x in out if x]

    @staticmethod
    def _cut(piece: str, most: int) -> tuple[list[str], str]:
        heads = []
        while True:
            bare = piece.rstrip(" ")
            reach = sum(2 if wide(c) else 1 for c in bare)
            if len(bare) > 1 and bare[-1] in HANGING:
                reach -= 2 if wide(bare[-1]) else 1
            if reach <= most or len(bare) <= 1:
                return heads, piece
            cut = size = 0
            for c in piece:
                size += 2 if wide(c) else 1
                if cut and size > most:
                    break
                cut += 1
            heads.append(piece[:cut])
            piece = piece[cut:]


def wrap(text: str, ems: float) -> list[str]:
    """The text in lines of at most ``ems``."""
    return Measured(text).lines(ems)


def fit(text: str, box_width: float, box_height: float, size: float) -> tuple[list[str], float, float] | None:
    """Lines, size and leading that fit the box, the size shrunk by steps; None if none does."""
    now, measured = size, Measured(text)
    while now >= FLOOR * size - 1e-9:
        lines = measured.lines(box_width / now)
        if not lines:
            return [], now, 0.0
        leading = box_height / len(lines)
        if len(lines) <= MOST_LINES and (leading >= LEADING * now or (len(lines) == 1 and box_height >= now)):
            return lines, now, min(leading, 2.2 * now)
        now *= STEP
    return None


def justify(line: str, ems: float, most: float = 0.05) -> list[float]:
    """The gap after each character that fills the line, between Han characters only."""
    gaps = [i for i in range(len(line) - 1) if wide(line[i]) and wide(line[i + 1]) and line[i] not in NO_START and line[i + 1] not in NO_START]
    out = [0.0] * len(line)
    extra = min(most, max(0.0, ems - width(line)) / len(gaps)) if gaps else 0.0
    for i in gaps:
        out[i] = extra
    return out


@F.pandas_udf(_LINES)
def _wrapped(texts: pd.Series, ems: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else wrap(t, e) for t, e in zip(texts, ems, strict=True)])


@F.pandas_udf(_FITTED)
def _fitted(texts: pd.Series, w: pd.Series, h: pd.Series, size: pd.Series) -> pd.DataFrame:
    rows = [None if t is None else fit(t, a, b, s) for t, a, b, s in zip(texts, w, h, size, strict=True)]
    return pd.DataFrame([r or (None, None, None) for r in rows], columns=["lines", "size", "leading"])


def wrapped(text: Column, ems: Column) -> Column:
    return _wrapped(text, ems)


def fitted(text: Column, box_width: Column, box_height: Column, size: Column) -> Column:
    """lines, size, leading; nulls where the source should be kept."""
    return _fitted(text, box_width, box_height, size)


def leading_scale(asked: Column) -> Column:
    return F.least(F.greatest(asked, F.lit(1.25)), F.lit(2.2))


def indent(level: Column, bullet: Column) -> Column:
    """Ems before a paragraph's first line."""
    return F.when((level == "body") & ~bullet, 2.0).otherwise(0.0)
