"""Answers from a language model behind a protocol: gate, prompt, refusal, judge, and what a model's JSON is read into."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarnwell.operators.conversation import REFUSAL, answerable, prompt


class Model(Protocol):
    """A language model; called in the tasks, so it must be picklable or made by a factory."""

    def generate(self, prompt: str) -> str: ...


class EchoModel:
    """Deterministic stand-in for tests: cites the first passage."""

    def generate(self, prompt: str) -> str:
        m = re.search(r"\[1\] [^\n]*\n([^\n]+)", prompt)
        return f"{m[1]} [1]" if m else ""


def answers(hits: DataFrame, questions: DataFrame, query_id: str, question: str, model: Callable[[], Model], cosine: str = "cosine", least: float = 0.0, turns: DataFrame | None = None) -> DataFrame:
    """(query_id, answer): one answer per question. Questions without hits, or whose best cosine lies under `least`, are refused unasked;
    an empty answer is asked for once more, then refused."""
    ok = answerable(hits, query_id, cosine, least).filter("answerable").select(query_id)
    asked = prompt(hits.join(ok, query_id, "left_semi").join(questions.select(query_id, F.col(question).alias("_q")), query_id), query_id, "_q", turns)
    kind = dict(questions.dtypes)[query_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model()
        for pdf in batches:
            yield pd.DataFrame({"k": pdf["k"], "answer": [(m.generate(p) or m.generate(p) or "").strip() or REFUSAL for p in pdf["prompt"]]})

    got = asked.select(F.col(query_id).alias("k"), "prompt").mapInPandas(run, f"k {kind}, answer string").withColumnRenamed("k", query_id)
    return questions.select(query_id).distinct().join(got, query_id, "left").withColumn("answer", F.coalesce("answer", F.lit(REFUSAL)))


def first_json(text: str, opening: str = "{") -> dict | list | None:
    """The JSON value in the prose of a model's answer, null where there is none."""
    closing = {"{": "}", "[": "]"}[opening]
    a, b = text.find(opening), text.rfind(closing)
    try:
        return json.loads(text[a : b + 1]) if 0 <= a < b else None
    except json.JSONDecodeError:
        return None


def retrieval_plan(text: str, question: str, most: int = 2) -> dict:
    """standalone, sub_queries and hypothetical of a planning answer; the question itself where the answer cannot be read."""
    j = first_json(text)
    j = j if isinstance(j, dict) else {}
    sub = [s.strip() for s in j.get("sub_queries", []) if isinstance(s, str) and s.strip()] if isinstance(j.get("sub_queries", []), list) else []
    return {"standalone": str(j.get("standalone") or question).strip(), "sub_queries": sub[:most], "hypothetical": str(j.get("hypothetical") or "").strip()}


def judged(text: str, keys: tuple[str, ...] = ("grounded", "complete")) -> dict:
    """Grades between 0 and 1 of a judging answer; judged is false where it cannot be read."""
    j = first_json(text)
    try:
        return {k: min(1.0, max(0.0, float(j[k]))) for k in keys} | {"judged": True}
    except (KeyError, TypeError, ValueError):
        return dict.fromkeys(keys, 0.0) | {"judged": False}


def memories_in(text: str, most: int = 5, shortest: int = 4) -> list[str]:
    """Facts to remember of an extracting answer: the first few strings of its list."""
    j = first_json(text, "[")
    return [s.strip() for s in j if isinstance(s, str) and len(s.strip()) >= shortest][:most] if isinstance(j, list) else []


#: Words that lead to a symbol, and the words that may end it; without such words it is all that follows. English and Vietnamese.
LEADS: dict[str, tuple[str, ...]] = {
    "calls": (), "caller of": (), "callers of": (), "who uses": (), "where is": ("defined",), "where does": ("defined", "called", "used"),
    "ai gọi": (), "ai dùng": (), "đứa nào gọi": (), "đứa nào dùng": (),
    "hàm": ("định nghĩa", "gọi"), "biến": ("định nghĩa", "gọi"), "class": ("định nghĩa", "gọi"), "module": ("định nghĩa", "gọi"),
}
FILLERS = {"get", "được", "tới"}


def symbol_question(question: str) -> tuple[str, bool]:
    """(symbol, certain) of a question about one; an empty symbol for others. Certain: it can hardly be an ordinary word.

    The words after a lead, up to its end words, must be one name without fillers; of a dotted name the last part counts.
    """
    spoken = question.split()
    plain = [w.lower().rstrip("?!.") for w in spoken]
    for at in range(len(plain)):
        for lead, ends in LEADS.items():
            first = lead.split()
            if plain[at : at + len(first)] != first or lead == "calls" and plain[max(at - 1, 0)] not in ("who", "what"):
                continue
            begin = at + len(first)
            stop = [k for e in ends for k in range(begin + 1, len(plain)) if plain[k : k + len(e.split())] == e.split()]
            if ends and not stop:
                continue
            name = [w for w, p in zip(spoken[begin : min(stop, default=None)], plain[begin:], strict=False) if p not in FILLERS]
            dotted = name[0].strip(" `'\"()[]{}:;,.?!") if len(name) == 1 else ""
            symbol = dotted.rpartition(".")[2]
            if symbol.isascii() and symbol.isidentifier():
                return symbol, "." in dotted or "_" in symbol or not symbol.islower()
    return "", False
