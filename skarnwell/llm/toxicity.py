"""Scores for abusive, hateful and sexual language.

Words are read through their disguises: look-alike letters and invisible characters, letters spaced out,
drawn out, replaced by digits and signs, masked or misspelled. One automaton, the intersection of the words'
Levenshtein automata with the trie of the lexicon, reads every distinct word once and gives the lexicon term it
stands for. Terms and patterns of terms add up within a window of words; what is quoted as someone else's, named
as a word, or stands near words on rules, medicine, law or machines counts less.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarnwell.llm import lexicon
from skarnwell.llm.lookalike import canonical

CATEGORIES = ("abusive", "hateful", "sexual")
THRESHOLD, WINDOW, NEAR = 1.0, 14, 8
EXCUSED, MENTIONED, QUOTED = 0.3, 0.3, 0.3  # what is left of a weight
TOKEN = re.compile(r"[\w@$*]+(?:!(?=\w)\w+)?")
SPACED = re.compile(r"(?<![\w.*-])(?:[^\W_][ .*_-]){2,}[^\W_](?![\w*-])")
SENTENCE = re.compile(r"(?<=[.!?…])\s+")
QUOTE = re.compile(r'"[^"]+"|“[^”]+”|„[^“”]+[“”]|«[^»]+»')
DISGUISE = re.compile(r"[\d@$*!_]")
DRAWN = re.compile(r"(.)\1{2,}")
#: Signs that stand for letters.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}
WILD = "*"
REMEMBERED = 400_000


def _entries(text: str) -> list[tuple[int, float, str]]:
    out = []
    for line in text.strip().splitlines():
        head, _, body = line.partition(":")
        name, weight = head.split()
        out += [(CATEGORIES.index(name), float(weight), e.strip()) for e in body.split(",") if e.strip()]
    return out


def _listed(text: str) -> set[str]:
    return {e.strip() for e in text.split(",") if e.strip()}


def edits_allowed(term: str) -> int:
    """None below 4 letters, where most words are one edit from another; two from 10 letters on."""
    return 0 if len(term) < 4 else 1 if len(term) < 10 else 2


class Automaton:
    """Every lexicon term within its edits of the word read: the Levenshtein automata of words, intersected with the lexicon's trie.

    A state is what a nondeterministic run may be in after a prefix of the word: trie nodes with the edits made, and nodes that wait for the
    first of two swapped letters. States are made when first reached and numbered, so that a word costs one look-up a letter, and a word unlike
    all terms ends after a few. A wildcard stands for any one letter, a sign for its letters. The first letter is not edited, only swapped.
    """

    def __init__(self, terms: set[str]):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]  # edits that some term below a node allows
        for t in sorted(terms):
            node = 0
            self.most[0] = max(self.most[0], edits_allowed(t))
            for ch in t:
                if ch not in self.child[node]:
                    self.child[node][ch] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = self.child[node][ch]
                self.most[node] = max(self.most[node], edits_allowed(t))
            self.term[node] = t
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.found: list[tuple[tuple[str, int], ...]] = []
        self.dead = self._numbered({})
        self.start = self._numbered({(0, ""): 0})

    def _numbered(self, state: dict[tuple[int, str], int]) -> int:
        key = frozenset(state.items())
        at = self.number.get(key)
        if at is None:
            at = self.number[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            self.found.append(tuple(sorted(((self.term[n], e) for (n, swap), e in state.items() if not swap and self.term[n] and e <= edits_allowed(self.term[n])), key=lambda x: (x[1], x[0]))))
        return at

    def _step(self, state: frozenset, ch: str) -> int:
        new: dict[tuple[int, str], int] = {}

        def reach(node: int, edits: int, swap: str = "") -> None:
            if edits <= self.most[node] and edits < new.get((node, swap), 9):
                new[node, swap] = edits
                if not swap:
                    for below in self.child[node].values():  # a letter of the term is left out
                        reach(below, edits + 1)

        for (node, swap), edits in state:
            children = self.child[node]
            if swap:
                between = children.get(ch)
                if between is not None and swap in self.child[between]:
                    reach(self.child[between][swap], edits)
                continue
            for c, below in children.items():
                same = c == ch or ch == WILD or c in LEET.get(ch, "")
                if same:
                    reach(below, edits)
                elif node:
                    reach(below, edits + 1)
                if not same and ch in self.child[below]:
                    reach(node, edits + 1, ch)
            if node:
                reach(node, edits + 1)
        return self._numbered(new)

    def read(self, word: str) -> tuple[tuple[str, int], ...]:
        """(term, edits) of the terms within reach of the word, nearest first."""
        at = self.start
        for ch in word:
            to = self.next[at].get(ch)
            if to is None:
                to = self.next[at][ch] = self._step(self.states[at], ch)
            if to == self.dead:
                return ()
            at = to
        return self.found[at]


@dataclass
class Pattern:
    words: list[str]
    rarest_first: list[frozenset[str]]
    first: frozenset[str]
    category: int
    weight: float


class Scorer:
    def __init__(self):
        self.terms: dict[str, tuple[int, float]] = {e: (c, w) for c, w, e in reversed(_entries(lexicon.TERMS))}
        classes = {}
        for line in lexicon.CLASSES.strip().splitlines():
            name, _, body = line.partition(":")
            classes["@" + name] = _listed(body)
        self.classes = classes
        self.patterns: list[Pattern] = []
        self.by_word: dict[str, list[int]] = {}  # patterns by the words of their rarest place
        self.parts: set[str] = set()
        for c, w, e in sorted(_entries(lexicon.PATTERNS), key=lambda e: -len(e[2])):
            words = e.split()
            places = [frozenset(classes.get(p, {p})) for p in words if p != "_"]
            for p in places:
                self.parts |= p
            # the longest words first: they are the rarest
            rarest = max(places, key=lambda p: sum(map(len, p)) / len(p))
            for p in rarest:
                self.by_word.setdefault(p, []).append(len(self.patterns))
            self.patterns.append(Pattern(words, sorted(places, key=lambda p: -sum(map(len, p)) / len(p)), places[0], c, w))
        # marks tell words of tonal languages apart, so words with marks are read as they stand
        self.automaton = Automaton({t for t in self.terms} | {w for w in self.parts if len(w) >= 4 and w.isascii()})
        self.mentions, self.calling, self.speech, self.excuses = (_listed(x) for x in (lexicon.MENTIONS, lexicon.CALLING, lexicon.SPEECH, lexicon.EXCUSES))
        self.ordinary = _listed(lexicon.ORDINARY)
        self.plain: set[str] = set()  # words seen lately that stand for nothing
        self.known: dict[str, tuple[str, float]] = {}

    def _resolve(self, word: str) -> tuple[str, float] | None:
        """(term or pattern word, certainty) that a word stands for."""
        if word in self.terms or word in self.parts:
            return word, 1.0
        bare = word.strip("*_")
        if bare in self.terms or bare in self.parts:
            return bare, 1.0
        letters = sum(map(str.isalpha, bare))
        if letters < 1 or len(bare) < 3:
            return None
        if word.endswith(WILD) and not word.startswith(WILD):  # a masked last letter, not markup
            hit = next((t for t, e in self.automaton.read(word) if not e), None)
            if hit:
                return hit, 1.0
        drawn = DRAWN.sub(r"\1", bare)
        for form in dict.fromkeys((bare, drawn, DRAWN.sub(r"\1\1", bare))):
            if form != bare and (form in self.terms or form in self.parts):
                return form, 1.0
            if DISGUISE.search(form) and letters * 2 >= len(bare) - 1 and (letters >= 2 or len(set(bare)) > 2):
                hit = next((t for t, e in self.automaton.read(form) if not e), None)
                if hit:
                    return hit, 1.0
        if not bare.isalpha() or bare in self.ordinary:
            return None
        for term, edits in self.automaton.read(drawn):
            sure = self._certainty(drawn, term)
            if edits and sure:
                return term, sure
        return None

    def _certainty(self, word: str, term: str) -> float:
        """How surely a misspelled word stands for a term: short words and weak terms have plain words near them, but seldom by swapped or left-out letters."""
        swapped = sorted(word) == sorted(term)
        if term not in self.terms:
            return 1.0 if word.isascii() else 0.0
        if len(word) < 4:
            return 0.0
        if len(term) < 6:
            return 0.0 if not (word.isascii() and term.isascii()) else 1.0 if swapped else 0.4
        if self.terms[term][1] < 1.0:
            return 1.0 if swapped or len(word) < len(term) else 0.6
        return 1.0 if swapped or len(word) >= 7 else 0.6

    def resolve(self, word: str) -> tuple[str, float] | None:
        hit = self.known.get(word)
        if hit is None and word not in self.plain:
            hit = self._resolve(word)
            if hit is None:
                if len(self.plain) > REMEMBERED:
                    self.plain.clear()
                self.plain.add(word)
            else:
                if len(self.known) > REMEMBERED:
                    self.known.clear()
                self.known[word] = hit
        return hit

    def _hits(self, words: list[str], patterns: list[Pattern]) -> list[tuple[int, int, float, str]]:
        """(place, category, weight, entry) of terms and patterns in a sentence."""
        read = [self.resolve(w) for w in words]
        names = [r[0] if r else w for r, w in zip(read, words, strict=True)]
        hits = []
        for k, r in enumerate(read):
            if r is None:
                continue
            if r[0] in self.terms:
                c, w = self.terms[r[0]]
                hits.append((k, c, w * r[1], r[0]))
            for pattern in patterns:
                if r[0] not in pattern.first:
                    continue
                at, gap = k, 0
                for p in pattern.words[1:]:
                    if p == "_":
                        gap = 4
                        continue
                    fits = self.classes.get(p, (p,))
                    at = next((j for j in range(at + 1, min(at + 2 + gap, len(names))) if names[j] in fits), None)
                    if at is None:
                        break
                    gap = 0
                else:
                    hits.append((k, pattern.category, pattern.weight, " ".join(pattern.words)))
        return hits

    def sentence(self, words: list[str], quoted: list[bool] | None = None, patterns: list[Pattern] | None = None) -> list[float]:
        """Score per category: the largest total of distinct entries within a window, by what the words around say of them."""
        best = [0.0, 0.0, 0.0]
        hits = self._hits(words, self.patterns if patterns is None else patterns)
        if not hits:
            return best
        excuse = [k for k, w in enumerate(words) if w in self.excuses]
        mention = [k for k, w in enumerate(words) if w in self.mentions]
        weighed = []
        for k, c, w, e in hits:
            if quoted and quoted[k]:
                w *= QUOTED
            elif w >= 1.0 and (any(abs(x - k) <= NEAR for x in mention) or not self.calling.isdisjoint(words[max(0, k - 4) : k])):
                w *= MENTIONED
            weighed.append((k, c, w, e))
        for k, *_ in weighed:
            near: dict[str, tuple[float, int]] = {}
            for j, c, w, e in weighed:
                if 0 <= j - k <= WINDOW:
                    near[e] = max(near.get(e, (0.0, 0)), (w, c))
            total = sum(w for w, _ in near.values())
            strong = max(w for w, _ in near.values()) >= 1.0
            if not strong and any(abs(x - k) <= WINDOW for x in (*excuse, *mention)):
                total *= EXCUSED
            top = max(near.values())[1]
            best[top] = max(best[top], total)
        return best

    def _attributed(self, line: str) -> list[tuple[int, int]]:
        """Passages of a line in quotation marks that a verb of speech, or a word on rules and the like, next to them makes someone else's."""
        out = []
        for m in QUOTE.finditer(line):
            around = TOKEN.findall(line[: m.start()])[-NEAR:] + TOKEN.findall(line[m.end() :])[:NEAR]
            if not self.speech.isdisjoint(around) or not self.mentions.isdisjoint(around):
                out.append(m.span())
        return out

    def _line(self, line: str, told: set[str], patterns: list[Pattern]) -> list[float]:
        best = [0.0, 0.0, 0.0]
        spans = self._attributed(line)
        begin = 0
        for end in [*(m.start() for m in SENTENCE.finditer(line) if not any(a < m.start() < b for a, b in spans)), len(line)]:
            part = line[begin:end]
            if any(w in part for w in told):
                words = TOKEN.findall(part)
                if not told.isdisjoint(words):
                    quoted = [any(a <= m.start() + begin < b for a, b in spans) for m in TOKEN.finditer(part)] if spans else None
                    best = [max(p) for p in zip(best, self.sentence(words, quoted, patterns), strict=True)]
            begin = end
        return best

    def _join(self, spaced: re.Match) -> str:
        """The term that spaced-out letters spell, perhaps after a word of one letter; else as they stand."""
        word = re.sub(r"[ .*_-]", "", spaced.group())
        if self.resolve(word):
            return word
        return f"{word[0]} {word[1:]}" if len(word) > 3 and self.resolve(word[1:]) else spaced.group()

    def text(self, text: str) -> list[float]:
        """Score per category of a text: that of its worst sentence."""
        best = [0.0, 0.0, 0.0]
        low = SPACED.sub(self._join, canonical(text).lower())
        words = set(TOKEN.findall(low))
        for w in words - self.plain:
            self.resolve(w)
        read = {w: self.known[w][0] for w in words & self.known.keys()}
        names = set(read.values())
        at_all = {k for n in names for k in self.by_word.get(n, ()) if not any(place.isdisjoint(names) for place in self.patterns[k].rarest_first)}
        patterns = [self.patterns[k] for k in sorted(at_all)]
        wanted = self.terms.keys() | frozenset().union(*(p.rarest_first[0] for p in patterns)) if patterns else self.terms
        told = {w for w, name in read.items() if name in wanted}
        if told:
            for line in low.split("\n"):
                if any(w in line for w in told):
                    best = [max(p) for p in zip(best, self._line(line, told, patterns), strict=True)]
        return best


@cache
def scorer() -> Scorer:
    return Scorer()


def _score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    s = scorer()
    for pdf in batches:
        rows = [(k, *s.text(t)) for k, t in zip(pdf["id"], pdf["text"], strict=True)]
        yield pd.DataFrame(rows, columns=["id", *CATEGORIES])


def scored(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, abusive, hateful, sexual, score): per document the scores of its worst sentences and the largest of them.

    Every document has its row: null and empty texts score 0. Documents given twice come twice. The whole text is read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = rows.mapInPandas(_score, "id long, abusive double, hateful double, sexual double")
    return out.select(F.col("id").alias(doc_id), *CATEGORIES, F.greatest(*CATEGORIES).alias("score"))


def rates(docs: DataFrame, doc_id: str, source: str, found: DataFrame) -> DataFrame:
    """(source, documents, harmful, rate) from the documents and their scores; a null source is one of its own."""
    s = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("source")).join(found.select(F.col(doc_id).alias("_id"), "score"), "_id", "left")
    harmful = F.sum(F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
    return s.groupBy("source").agg(F.count("*").alias("documents"), harmful.alias("harmful")).withColumn("rate", F.col("harmful") / F.col("documents"))
