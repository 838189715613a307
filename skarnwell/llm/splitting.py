"""Splitting oversized texts at natural boundaries, with overlap."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundary strengths, strongest first. A boundary stands before the character that follows the match.
STRENGTHS = (
    (6, re.compile(r"\n[ \t]*\n\s*")),
    (5, re.compile(r"\n")),
    (4, re.compile(r"[.!?…。！？][\"'”’)\]]*\s+")),
    (3, re.compile(r"[;:,，、—–][\"'”’)\]]*\s+")),
    (2, re.compile(r"\s+")),
)
#: A cut before one of these would part a letter from its accent, or an emoji from its modifier.
INSEPARABLE = re.compile("[̀-ͯ҃-҉ְ-ֽً-ٟ᪰-᫿᷀-᷿⃐-⃿︀-️︠-︯​-‍⁠﻿\U0001f3fb-\U0001f3ff]")
BLOCK = 1 << 18  # code points under one sparse table; keeps its memory independent of the text's length


def strengths(text: str) -> np.ndarray:
    """Strength of the boundary before each position 0..len(text)."""
    s = np.ones(len(text) + 1, dtype=np.int64)
    for m in INSEPARABLE.finditer(text):
        s[m.start()] = 0
    for k, pattern in reversed(STRENGTHS):
        for m in pattern.finditer(text):
            s[m.end()] = max(s[m.end()], k)
    return s


class StrongestCut:
    """Sparse table for range maxima over boundary strengths; ties go to the right."""

    def __init__(self, s: np.ndarray, window: int):
        key = s * (len(s) + 1) + np.arange(len(s))
        self.n, self.levels = len(s) + 1, [key]
        h = 1
        while 2 * h <= min(window, len(s)):
            last = self.levels[-1]
            self.levels.append(np.maximum(last[:-h], last[h:]))
            h *= 2

    def query(self, lo: int, hi: int) -> int:
        """Position of the strongest boundary in lo..hi, both included."""
        j = min((hi - lo + 1).bit_length() - 1, len(self.levels) - 1)
        return int(max(self.levels[j][lo], self.levels[j][hi - (1 << j) + 1])) % self.n


def split_text(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans (start, end) of the pieces of a text, each at most `limit` code points long.

    Spaces and line feeds at the ends of the text belong to no piece; what fits the limit without them
    is one piece, and an empty text has none. Every piece after the first starts about `overlap` (0.75
    to 1.25 times) code points before the end of the one before.
    """
    if not 0 <= 2 * overlap < limit:
        raise ValueError("the overlap must be less than half the limit")
    left = len(text) - len(text.lstrip(" \n"))
    end = len(text.rstrip(" \n"))
    if end - left <= limit:
        return [(left, end)] if end > left else []
    slack = max(1, overlap // 4) if overlap else 0
    least = max(limit // 2, overlap + slack + 1)
    spans, start, base, table = [], left, -1, None
    while end - start > limit:
        if table is None or start + limit > base + BLOCK:
            base = start - min(start, overlap + slack)
            stop = min(end, base + BLOCK + limit)
            # one more character on either side: a boundary is seen by what surrounds it
            before = 64 if base > 64 else base
            table = StrongestCut(strengths(text[base - before : stop + 1])[before : before + stop - base + 1], limit + 1)
        cut = base + table.query(start + least - base, start + limit - base)
        spans.append((start, cut))
        back = cut
        if overlap:
            back = base + table.query(max(start + 1, cut - overlap - slack) - base, cut - overlap + slack - base)
        start = back
    spans.append((start, end))
    return spans


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int, line: str | None = None) -> DataFrame:
    """Pieces of the rows whose text exceeds the limit: keys, piece, piece_text, start, stop, line.

    A text counts without spaces and line feeds at its ends, in code points; rows within the limit (and
    null or empty texts) have no pieces here. `start` and `stop` are offsets in the stored text. `line` counts from the
    row's line number, null where that is null or below 1. Repeated rows give repeated pieces; other
    columns, whatever their names, are left out. Map-only: the row filter runs in the JVM and only
    oversized texts go to Python.
    """
    at = F.col(line).cast("long") if line else F.lit(1).cast("long")
    rows = df.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], F.col(text).alias("_text"), at.alias("_line")).filter(F.length(F.btrim("_text", F.lit(" \n"))) > limit)
    types = dict(rows.dtypes)
    names = [f"_k{n}" for n in range(len(keys))]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = {c: [] for c in [*names, "piece", "piece_text", "start", "stop", "line"]}
            for row in zip(*(pdf[c] for c in names), pdf["_text"], pdf["_line"], strict=True):
                body, first = row[-2], row[-1]
                known = first is not None and first == first and first >= 1
                lines, seen = int(first) if known else None, 0
                for n, (a, b) in enumerate(split_text(body, limit, overlap)):
                    if known:
                        lines += body.count("\n", seen, a)
                        seen = a
                    for c, v in zip(out, (*row[:-2], n + 1, body[a:b], a, b, lines), strict=True):
                        out[c].append(v)
            yield pd.DataFrame({c: pd.array(v, dtype="Int64") if c == "line" else pd.Series(v, dtype=object) if c in names else v for c, v in out.items()})

    schema = ", ".join(f"{c} {types[c]}" for c in names) + ", piece long, piece_text string, start long, stop long, line long"
    done = rows.mapInPandas(pieces, schema)
    return done.select(*[F.col(f"_k{n}").alias(k) for n, k in enumerate(keys)], "piece", "piece_text", "start", "stop", "line")
