"""Chat analytics, refusals, feedback, and similarity caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarnwell.functions import text as T
from skarnwell.operators.dense import dense_topk

CACHE_COSINE, CORRECTION_COSINE, MEMORY_COSINE = 0.88, 0.88, 0.35
ANSWER_CACHE_ROWS, EMBED_CACHE_ROWS = 500, 50_000
#: Fixed value: the answer that is a refusal.
REFUSAL = "I could not find this in your indexed sources."


def once(messages: DataFrame) -> DataFrame:
    return messages.dropDuplicates(["id"])


SEGMENT_IDS = 65_536


def previous_question(messages: DataFrame) -> DataFrame:
    """messages with `question`: the last user text before each in its chat, by id.

    A chat is taken in segments of ids: a running window within each, and the last question of earlier segments from a second window over one row a
    segment, so that a chat with very many messages is spread over many tasks.
    """
    m = messages.withColumn("_s", F.floor(F.col("id") / SEGMENT_IDS))
    asked = F.when(F.col("role") == "user", F.col("text"))
    inside = Window.partitionBy("chat_id", "_s").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("_q", F.last(asked, ignorenulls=True).over(inside))
    ends = messages.withColumn("_s", F.floor(F.col("id") / SEGMENT_IDS)).groupBy("chat_id", "_s").agg(F.max_by("text", F.when(asked.isNotNull(), F.col("id"))).alias("_last"))
    earlier = Window.partitionBy("chat_id").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_before", F.last("_last", ignorenulls=True).over(earlier)).filter("_before is not null").select("chat_id", "_s", "_before")
    return m.join(carried, ["chat_id", "_s"], "left").withColumn("question", F.coalesce("_q", "_before")).select(*messages.columns, "question")


def recent_turns(messages: DataFrame, turns: int = 3) -> DataFrame:
    """(chat_id, pos, role, text): the last `turns` exchanges (two messages each) of every chat, oldest first."""
    w = Window.partitionBy("chat_id").orderBy(F.desc("id"))
    last = messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= 2 * turns)
    up = Window.partitionBy("chat_id").orderBy("id")
    return last.select("chat_id", F.row_number().over(up).cast("long").alias("pos"), "role", "text")


def chat_list(chats: DataFrame, messages: DataFrame, limit: int = 50) -> DataFrame:
    """(id, title, updated_at, messages): the chats changed last; messages are counted per chat before the join."""
    n = messages.groupBy(F.col("chat_id").alias("id")).agg(F.count("*").alias("messages"))
    rows = chats.join(n, "id", "left").select("id", "title", "updated_at", F.coalesce("messages", F.lit(0)).alias("messages"))
    return rows.orderBy(F.desc("updated_at"), F.desc("id")).limit(limit)


def feedback_rows(messages: DataFrame) -> DataFrame:
    """(id, chat_id, question, text, feedback) of the rated answers."""
    return previous_question(messages).filter("role = 'assistant' and feedback != 0").select("id", "chat_id", "question", "text", "feedback")


def feedback_golden(messages: DataFrame) -> DataFrame:
    """(query, relevant): evaluation rows from answers rated well, with the paths they cite; one per question."""
    good = previous_question(messages).filter("role = 'assistant' and feedback > 0 and question is not null and size(citations) > 0")
    w = Window.partitionBy("question").orderBy(F.desc("id"))
    last = good.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return last.select(F.col("question").alias("query"), F.array_sort(F.array_distinct(F.transform("citations", lambda c: c["path"]))).alias("relevant"))


def refusals(messages: DataFrame, refused: Column, limit: int = 25) -> DataFrame:
    """(question, count, last_seen, resolved): questions that were refused, and whether their latest answer was not; case and outer spaces of a question do not count."""
    a = previous_question(messages).filter("role = 'assistant' and question is not null").withColumn("refused", F.coalesce(refused, F.lit(False)))
    rows = a.groupBy(F.lower(F.trim("question")).alias("key")).agg(
        F.max_by("question", F.when(F.col("refused"), F.col("id"))).alias("question"), F.sum(F.col("refused").cast("long")).alias("count"),
        F.max(F.when(F.col("refused"), F.col("created_at"))).alias("last_seen"), (~F.max_by("refused", "id")).alias("resolved"),
    )
    return rows.filter("count > 0").select("question", "count", "last_seen", "resolved").orderBy(F.desc("count"), F.desc("last_seen"), "question").limit(limit)


def keep_newest(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` newest rows, one per key: the newest. A top-k by time, then ties by key."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("created_at"))
    one = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return one.orderBy(F.desc_nulls_last("created_at"), F.asc(key)).limit(most)


def cache_put(cache: DataFrame, new: DataFrame, key: str, most: int) -> DataFrame:
    """The cache with new rows in place of those of the same key, cut to the newest `most`."""
    return keep_newest(cache.join(new.select(key).distinct(), key, "left_anti").unionByName(new), key, most)


def cache_nearest(cache: DataFrame, queries: DataFrame, query_id: str, vector: str, dim: int, least: float = CACHE_COSINE) -> DataFrame:
    """(query_id, cache_key, score): the most similar cached question of the same fingerprint, at least that similar.

    Fingerprints are compared where the vectors are, so that questions of one fingerprint are never paired up first.
    """
    c = cache.dropDuplicates(["cache_key"])
    return dense_topk(c, "cache_key", "embedding", queries, query_id, vector, dim, 1, min_cosine=least, group=("fingerprint", "fingerprint")).select(query_id, "cache_key", "score")


def nearest_correction(corrections: DataFrame, queries: DataFrame, query_id: str, vector: str, dim: int, least: float = CORRECTION_COSINE) -> DataFrame:
    """(query_id, id, score): the most similar corrected question; of equally similar ones the newest (largest id)."""
    c = corrections.withColumn("minus_id", -F.col("id"))
    best = dense_topk(c, "minus_id", "embedding", queries, query_id, vector, dim, 1, min_cosine=least)
    return best.select(query_id, (-F.col("minus_id")).alias("id"), "score")


def relevant_memories(memories: DataFrame, queries: DataFrame, query_id: str, vector: str, dim: int, top: int = 3, least: float = MEMORY_COSINE) -> DataFrame:
    """(query_id, id, score, rank): the most similar memories; texts that differ in case only count once, under the smallest id."""
    w = Window.partitionBy(F.lower("text")).orderBy("id")
    m = memories.withColumn("_n", F.row_number().over(w)).filter("_n = 1")
    return dense_topk(m, "id", "embedding", queries, query_id, vector, dim, top, min_cosine=least)


def revisions(documents: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row: what changes when the corpus or the corrections change."""
    d = documents.agg(F.coalesce(F.max("indexed_at").cast("string"), F.lit("")).alias("corpus"))
    c = corrections.agg(F.concat_ws(":", F.count("*"), F.coalesce(F.max("id"), F.lit(0))).alias("corrections"))
    return d.crossJoin(F.broadcast(c))


#: Signs of a question with several parts, and the words that a follow-up has at most.
SEVERAL = (" and ", " vs ", " both ", " so sánh", " và ", " với ")
FOLLOW_UP_WORDS = 12


def needs_plan(question: Column, has_history: Column, hyde: bool = False) -> Column:
    """A model is asked to rewrite and divide a question first: always with hyde, for short follow-ups, and for questions with several parts."""
    q = F.lower(question)
    several = F.lit(False)
    for sign in SEVERAL:
        several = several | F.contains(q, F.lit(sign))
    words = F.size(F.filter(F.split(question, r"(?U)\s+"), lambda w: w != ""))
    return F.lit(hyde) | (has_history & (words <= FOLLOW_UP_WORDS)) | several


def plan_prompts(questions: DataFrame, query_id: str, question: str, turns: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt) that asks for a JSON object with standalone, sub_queries and hypothetical; turns: query_id, pos, role, text, cut to 300 characters each."""
    ask = "Prepare a search. Answer with one JSON object with the keys standalone (the question rewritten to stand alone), sub_queries (two other phrasings at most) and hypothetical (a short paragraph that would answer it), in the language of the question."
    q = questions.select(query_id, F.col(question).alias("_q"))
    if turns is not None:
        t = turns.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(": ", "role", F.substring("text", 1, 300)).alias("line")))).alias("t"))
        q = q.join(t, query_id, "left").withColumn("_h", F.array_join(F.transform("t", lambda x: x["line"]), "\n"))
    return q.select(query_id, F.concat_ws("\n\n", F.lit(ask), F.col("_h") if turns is not None else F.lit(None), F.concat(F.lit("Question: "), "_q")).alias("prompt"))


def memory_windows(messages: DataFrame, last: int = 12) -> DataFrame:
    """(chat_id, window): the last messages of every chat, oldest first, as the text that facts to remember are drawn from."""
    rows = recent_turns(messages, last // 2)
    text = rows.groupBy("chat_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(": ", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("line")))).alias("t"))
    return text.select("chat_id", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("window"))


def fingerprint(documents: DataFrame, chunks: DataFrame, corrections: DataFrame, version: str, embedder: str, model: str, spec: str) -> DataFrame:
    """One row: all that an answer depends on, joined by bars: prompt version, embedder, model and its spec, how many documents and chunks, revisions of corpus and corrections."""
    n = documents.agg(F.count("*").alias("d")).crossJoin(F.broadcast(chunks.agg(F.count("*").alias("c")))).crossJoin(F.broadcast(revisions(documents, corrections)))
    return n.select(F.concat_ws("|", F.lit(version), F.lit(embedder), F.lit(model), F.lit(spec), F.col("d").cast("string"), F.col("c").cast("string"), "corpus", "corrections").alias("fingerprint"))


def index_due(hours: Column, last: Column, now: Column) -> Column:
    """An automatic run is due: never without an interval, at once without a readable time of the last run, else when the interval has passed."""
    ran = F.try_to_timestamp(last, F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(F.coalesce(hours, F.lit(0.0)) <= 0, False).when(ran.isNull(), True).otherwise(F.unix_timestamp(now) - F.unix_timestamp(ran) >= hours * 3600)


#: What is asked for as to the length of an answer.
LENGTHS = {"short": "Answer in two sentences.", "medium": "", "long": "Answer in detail."}


def notes(query_id: str, memories: DataFrame | None = None, corrections: DataFrame | None = None) -> list[DataFrame]:
    """(query_id, note) texts to put before the passages: memories (query_id, rank, text), corrections (query_id, question, answer; cut to 200 and 800 characters)."""
    out = []
    if memories is not None:
        m = memories.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("m"))
        out.append(m.select(query_id, F.concat(F.lit("Known about the reader:\n"), F.array_join(F.transform("m", lambda x: F.concat(F.lit("- "), x["text"])), "\n")).alias("note")))
    if corrections is not None:
        c = corrections.select(query_id, F.concat(F.lit("Corrected answer to '"), F.substring("question", 1, 200), F.lit("': "), F.substring("answer", 1, 800)).alias("line"))
        out.append(c.groupBy(query_id).agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("note")))
    return out


def prompt(hits: DataFrame, query_id: str, question: str, turns: DataFrame | None = None, before: list[DataFrame] | None = None, diagrams: bool = False, length: str = "medium") -> DataFrame:
    """(query_id, prompt): notes (see notes()), numbered passages in order of place, then the question; the last turns, cut to 400 characters each, before it.
    With diagrams, a question that asks for a picture has a line that says so; length is one of LENGTHS."""
    block = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col("path"), F.lit("\n"), F.col("text"))
    p = hits.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("place", block.alias("block")))).alias("b"), F.first(question).alias("question"))
    p = p.withColumn("passages", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n"))
    if turns is not None:
        t = turns.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("pos", F.concat_ws(": ", "role", F.substring("text", 1, 400)).alias("line")))).alias("t"))
        p = p.join(t, query_id, "left").withColumn("history", F.array_join(F.transform("t", lambda x: x["line"]), "\n"))
    for k, note in enumerate(before or []):
        p = p.join(note.select(query_id, F.col("note").alias(f"_note{k}")), query_id, "left")
    picture = F.when(T.wants_diagram(F.col("question")), "Answer with a diagram in text form.") if diagrams else F.lit(None).cast("string")
    parts = ([F.col("history")] if turns is not None else []) + [F.col(f"_note{k}") for k in range(len(before or []))] + [picture, F.lit(LENGTHS[length] or None).cast("string"), F.col("passages"), F.concat(F.lit("Question: "), "question")]
    return p.select(query_id, F.concat_ws("\n\n", *parts).alias("prompt"))


def answerable(hits: DataFrame, query_id: str, cosine: str, least: float) -> DataFrame:
    """(query_id, answerable): false where the best cosine of the hits lies under the least; hits from other lanes count as 0."""
    return hits.groupBy(query_id).agg((F.max(F.coalesce(cosine, F.lit(0.0))) >= least).alias("answerable"))
