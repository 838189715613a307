"""Evaluation texts inside training texts, by suffix arrays over the training words.

Each task builds suffix arrays over shards of its own documents and looks up every suffix of the test
words in them by binary search, so that the corpus is read once, in place, and nothing but the matches
leaves a task. A match can hold words of the test texts only; positions from which fewer than
`min_words` such words follow can begin no match, and get no suffix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarnwell.llm.lookalike import canonical

WORD = re.compile(r"[^\W_]+")
#: Markup that would put letters between the words of a passage: tags, comments, entities, link targets.
MARKUP = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>\n]{0,200}>|&(?:[a-zA-Z]{2,8}|#\d{1,6}|#x[0-9a-fA-F]{1,5});|(?<=\])\([^()\s]{1,500}\)", re.DOTALL)
SHARD_WORDS = 1 << 20
OTHER = 0
PAIRS_AT_ONCE = 1 << 20  # matches spelt out at once, before the best of each document and item are kept


def words(text: str) -> list[str]:
    """Runs of letters and digits of the canonical text, lower-cased, without markup."""
    text = canonical(text)
    if "<" in text or "&" in text or "](" in text:
        text = MARKUP.sub(" ", text)
    return WORD.findall(text.lower())


@dataclass
class TestWords:
    """All test texts as one array of word numbers, with a gap of OTHER after each text."""

    vocabulary: dict[str, int]
    ids: np.ndarray
    item: np.ndarray
    offset: np.ndarray
    suffixes: np.ndarray

    @classmethod
    def of(cls, items: list[tuple[int, str]], min_words: int) -> TestWords:
        vocabulary: dict[str, int] = {}
        ids, item, offset, starts = [], [], [], []
        for key, text in items:
            w = words(text)
            for k, x in enumerate(w):
                if k + min_words <= len(w):
                    starts.append(len(ids))
                ids.append(vocabulary.setdefault(x, len(vocabulary) + 1))
                item.append(key)
                offset.append(k)
            ids.append(OTHER)
            item.append(-1)
            offset.append(-1)
        return cls(vocabulary, np.array(ids, np.int64), np.array(item, np.int64), np.array(offset, np.int64), np.array(starts, np.int64))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ids in the order of the suffixes that start there, by at least their first `depth` words (prefix doubling)."""
    n = len(ids)
    rank = ids.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    done = 1
    while done < depth and n:
        rest = np.zeros(n, np.int64)
        rest[: n - done] = rank[done:] + 1 if done < n else 0
        key = rank * (int(rest.max()) + 1) + rest
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([0], np.cumsum(s[1:] != s[:-1])))
        rank, done = new, done * 2
        if rank[order[-1]] == n - 1:
            break
    return order


def _compare(hay: np.ndarray, at: np.ndarray, needle: np.ndarray, start: np.ndarray, depth: int) -> np.ndarray:
    """-1, 0, 1 as hay from `at` sorts before, like or after needle from `start`, by the first `depth` words."""
    a = hay[np.minimum(at[:, None] + np.arange(depth), len(hay) - 1)]
    b = needle[start[:, None] + np.arange(depth)]
    differs = a != b
    first = differs.argmax(1)
    rows = np.arange(len(at))
    return np.where(differs.any(1), np.sign(a[rows, first] - b[rows, first]), 0)


def _bound(hay: np.ndarray, order: np.ndarray, test: TestWords, depth: int, upper: bool) -> np.ndarray:
    """For every test suffix, by binary search, how many training suffixes sort before it (upper: or like it)."""
    lo = np.zeros(len(test.suffixes), np.int64)
    hi = np.full(len(test.suffixes), len(order), np.int64)
    while (open_ := lo < hi).any():
        k = np.flatnonzero(open_)
        mid = (lo[k] + hi[k]) // 2
        c = _compare(hay, order[mid], test.ids, test.suffixes[k], depth)
        right = c <= 0 if upper else c < 0
        lo[k[right]] = mid[right] + 1
        hi[k[~right]] = mid[~right]
    return lo


def _eligible(ids: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of at least min_words test words, each followed by OTHER, and where each word stood."""
    known = np.concatenate(([False], ids != OTHER, [False]))
    edges = np.flatnonzero(known[1:] != known[:-1])
    starts, ends = edges[::2], edges[1::2]
    keep = ends - starts >= min_words
    starts, ends = starts[keep], ends[keep] + 1  # the word after a run is OTHER, or the end
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.concatenate([np.arange(a, b) for a, b in zip(starts, ends, strict=True)])
    return np.append(ids, OTHER)[at], at


def find_in_shard(ids: np.ndarray, test: TestWords, min_words: int, at_once: int = PAIRS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Matches of at least min_words words, in blocks: place in ids, place in test.ids, length; each as long as it goes.

    Only matches that cannot be made longer to the left are spelt out: training suffixes that begin alike are ordered by the word before them,
    so that those with the word that stands before the test suffix too are one interval, which is left out. A text that repeats one word
    thus gives as many matches as it has words, not their product with the words of the item.
    """
    hay, at = _eligible(ids, min_words)
    if not len(hay) or not len(test.suffixes):
        return
    order = suffix_array(hay, min_words)
    lo, hi = (_bound(hay, order, test, min_words, u) for u in (False, True))
    suffixes = test.suffixes[hi > lo]
    lo, hi = lo[hi > lo], hi[hi > lo]
    if not len(lo):
        return
    edge = np.zeros(len(order) + 1, np.int64)
    edge[lo] = edge[hi] = 1
    alike = np.cumsum(edge[:-1])
    before = np.where(order > 0, hay[order - 1], OTHER)
    key = alike * (len(test.vocabulary) + 1) + before
    k = np.argsort(key, kind="stable")
    order, key = order[k], key[k]
    same = alike[lo] * (len(test.vocabulary) + 1) + np.where(suffixes > 0, test.ids[suffixes - 1], OTHER)
    skip_lo, skip_hi = np.searchsorted(key, same, "left"), np.searchsorted(key, same, "right")
    begins = (suffixes == 0) | (test.ids[suffixes - 1] == OTHER)  # nothing stands before the first word of an item
    skip_lo[begins] = skip_hi[begins] = lo[begins]
    first, last, start = np.concatenate([lo, skip_hi]), np.concatenate([skip_lo, hi]), np.concatenate([suffixes, suffixes])
    first, last, start = (x[first < last] for x in (first, last, start))
    total = np.cumsum(last - first)
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + at_once, "right")))
        count = (last - first)[a:b]
        which = np.repeat(np.arange(a, b), count)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        place, begin = order[first[which] + inside], start[which]
        length = np.full(len(which), min_words, np.int64)
        live = np.arange(len(which))
        while len(live):
            x, y = place[live] + length[live], begin[live] + length[live]
            more = (x < len(hay)) & (y < len(test.ids))
            more[more] = (hay[x[more]] == test.ids[y[more]]) & (hay[x[more]] != OTHER)
            live = live[more]
            length[live] += 1
        yield at[place], begin, length
        a = b


def _search(batches: Iterator[pd.DataFrame], test: TestWords, min_words: int) -> Iterator[pd.DataFrame]:
    def flush(docs: list, parts: list) -> pd.DataFrame:
        ids = np.concatenate(parts)
        begin = np.cumsum([0, *map(len, parts)])
        best = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("doc", "item", "words", "doc_word", "item_word")})
        for place, start, length in find_in_shard(ids, test, min_words):
            doc = np.searchsorted(begin, place, side="right") - 1
            new = pd.DataFrame({"doc": np.array(docs, dtype=np.int64)[doc], "item": test.item[start], "words": length, "doc_word": place - begin[doc], "item_word": test.offset[start]})
            best = pd.concat([best, new]).sort_values(["doc", "item", "words", "doc_word", "item_word"], ascending=[True, True, False, True, True]).drop_duplicates(["doc", "item"])
        return best

    docs, parts, size = [], [], 0
    get = test.vocabulary.get
    for pdf in batches:
        for key, text in zip(pdf["doc"], pdf["text"], strict=True):
            w = words(text)
            if len(w) < min_words:
                continue
            docs.append(key)
            parts.append(np.array([get(x, OTHER) for x in w] + [OTHER], np.int64))
            size += len(w)
            if size >= SHARD_WORDS:
                yield flush(docs, parts)
                docs, parts, size = [], [], 0
    if docs:
        yield flush(docs, parts)


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, min_words: int = 13, block_chars: int = 5_000_000) -> DataFrame:
    """(doc_id, item_id, words, doc_word, item_word): the longest passage of at least min_words words that
    a document shares with a test item, and where it begins in either (counted in words from 0; of equally
    long ones the first).

    Words are runs of letters and digits; case, punctuation, markup, spacing and the choice among look-alike
    characters do not matter. Test texts are taken in blocks of at most block_chars characters (an item
    alone may exceed that), each block being looked up in one pass over the documents, so that what is sent
    to the tasks is bounded. Null ids and texts match nothing; a document or item given twice gives its row
    once; empty tables give no rows. Document ids must be bigint; other columns are left out.
    """
    d = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")).filter(f"doc is not null and length(text) >= {2 * min_words - 1}")
    e = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null").distinct()
    total = e.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_chars))
    schema = "doc long, item long, words long, doc_word long, item_word long"
    found = None
    for b in range(blocks):
        rows = e.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        test = TestWords.of(sorted((r.item, r.text) for r in rows), min_words)
        part = d.mapInPandas(lambda it, test=test: _search(it, test, min_words), schema)
        found = part if found is None else found.unionByName(part)
    best = found.groupBy("doc", "item").agg(F.min(F.struct(-F.col("words"), "doc_word", "item_word")).alias("m"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), (-F.col("m.col1")).alias("words"), "m.doc_word", "m.item_word")


def without_leaks(docs: DataFrame, doc_id: str, found: DataFrame) -> DataFrame:
    """The documents in which no test item was found; documents without an id stay."""
    return docs.join(found.select(doc_id).distinct(), doc_id, "left_anti")
