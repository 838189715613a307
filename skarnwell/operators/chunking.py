"""Cutting documents into overlapping chunks with line numbers, and joining chunks into parents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CHARS, OVERLAP, VERSION, PARENT_CHARS = 1000, 150, 2, 4000
SENTENCE_END = re.compile(r"[.!?…][\"')\]]?\s")


def chunk_config(max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> str:
    return f"v{VERSION}:{max_chars}/{overlap}"


def _end_of_piece(text: str, start: int, most: int) -> int:
    """Where to end a piece of a long paragraph: after the last sentence of the window, else after its last space, both in the second half only, else at the limit."""
    half, stop = start + most // 2, min(start + most, len(text))
    ends = [m.end() for m in SENTENCE_END.finditer(text, start, stop) if m.end() >= half]
    if ends:
        return ends[-1]
    space = text.rfind(" ", half, stop)
    return space + 1 if space >= 0 else stop


def _pieces(paragraph: str, offset: int, most: int, overlap: int) -> Iterator[tuple[int, str]]:
    """(offset, piece) of one paragraph, each piece at most `most` long, overlapping at word starts."""
    if len(paragraph) <= most:
        yield offset, paragraph
        return
    start = 0
    while start < len(paragraph):
        end = _end_of_piece(paragraph, start, most)
        piece = paragraph[start:end].strip()
        if piece:
            yield offset + start, piece
        if end >= len(paragraph):
            return
        back = max(end - overlap, 0)
        space = paragraph.find(" ", back, end)
        back = space + 1 if space >= 0 else back
        start = back if start < back < end else end


def _tail(text: str, overlap: int) -> str:
    """What the next chunk repeats: the last characters, from after their first space; an overlap of 0 repeats everything."""
    tail = text[-overlap:]
    return tail[tail.find(" ") + 1 :]


def chunk_text(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP) -> list[tuple[int, str, int]]:
    """(ordinal, text, line) of the chunks of a text: paragraphs are packed together while they fit."""
    if overlap >= most:
        raise ValueError("the overlap must be less than the chunk size")
    parts, at = [], 0
    for raw in text.split("\n\n"):
        body = raw.strip()
        if body:
            parts += _pieces(body, at + raw.index(body[0]) if raw else at, most, overlap)
        at += len(raw) + 2
    chunks: list[tuple[int, str]] = []
    held, held_at = "", 0
    for offset, piece in parts:
        if not held:
            held, held_at = piece, offset
        elif len(held) + 2 + len(piece) <= most:
            held += "\n\n" + piece
        else:
            chunks.append((held_at, held))
            tail = _tail(held, overlap)
            if tail and len(tail) + 2 + len(piece) <= most:
                held = tail + "\n\n" + piece  # keeps the line of the chunk it repeats
            else:
                held, held_at = piece, offset
    if held:
        chunks.append((held_at, held))
    return [(n, c, text.count("\n", 0, a) + 1) for n, (a, c) in enumerate(chunks)]


def group_parents(texts: list[str], most: int = PARENT_CHARS) -> list[int]:
    """The parent of each chunk: a parent is full once its chunks have `most` characters."""
    out, parent, size = [], 0, 0
    for t in texts:
        out.append(parent)
        size += len(t)
        if size >= most:
            parent, size = parent + 1, 0
    return out


def chunked(documents: DataFrame, key: str, text: str, most: int = MAX_CHARS, overlap: int = OVERLAP, parent_chars: int = PARENT_CHARS) -> DataFrame:
    """(key, ordinal, text, parent_ordinal, line_start): the chunks of every document. Map-only, in Arrow batches."""
    if overlap >= most:
        raise ValueError("the overlap must be less than the chunk size")
    kind = dict(documents.dtypes)[key]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"], strict=True):
                found = chunk_text(t, most, overlap)
                rows += [(k, n, c, p, line) for (n, c, line), p in zip(found, group_parents([c for _, c, _ in found], parent_chars), strict=True)]
            yield pd.DataFrame(rows, columns=["k", "ordinal", "text", "parent_ordinal", "line_start"])

    d = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null and t != ''")
    return d.mapInPandas(cut, f"k {kind}, ordinal int, text string, parent_ordinal int, line_start int").withColumnRenamed("k", key)


def parents(chunks: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, text): chunks joined by blank lines, per parent; a parent's size is bounded, so its chunks may be collected."""
    g = chunks.groupBy(key, "parent_ordinal").agg(F.sort_array(F.collect_list(F.struct("ordinal", "text"))).alias("c"))
    return g.select(key, F.col("parent_ordinal").alias("ordinal"), F.array_join(F.transform("c", lambda x: x["text"]), "\n\n").alias("text"))
