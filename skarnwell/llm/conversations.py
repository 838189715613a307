"""Rebuilding conversations from message rows, as a stateful stream.

Every chat has a buffer of its messages in keyed state and a timer of its own. Late arrivals find their place while the chat is open;
when the watermark has passed its last message by the time of inactivity, it is ordered, validated and emitted, or dropped if it is broken. Chats
of a hash bucket share one state row, so that a state call serves many of them. A chat with very many messages, named as hot by the
caller, is kept in a second level: state keyed by chat and time segment, so that it is spread over many keys; its closed segments are emitted
with a summary each, from which it is judged and numbered. State holds a fixed-size record per message, never its text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skarnwell.durable import checkpointed, shared_folder

BAD, USER, ASSISTANT, SYSTEM = 0, 1, 2, 3
#: Role names, lower-case, and what they mean.
ROLES = {"user": USER, "human": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "ai": ASSISTANT, "system": SYSTEM}
#: One character that draws something: no space, control, format or unassigned character, no filler or selector.
VISIBLE = r"[^\s\p{Z}\p{Cc}\p{Cf}\p{Cn}\x{034F}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{2800}\x{3164}\x{FFA0}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]"
RECORD = np.dtype([("chat", "<i8"), ("at", "<i8"), ("id", "<i8"), ("h1", "<i8"), ("h2", "<i8"), ("role", "<i8")])
#: Watermarks start at 1970, and Python's nanosecond timestamps end in 2262. Event times are kept within these; order and segments use the exact time.
FIRST_TIME, LAST_TIME, END_OF_INPUT = "1970-01-02 00:00:00", "2262-01-01 00:00:00", "2262-04-01 00:00:00"
LAST_TIME_MS = 9_214_646_400_000
SPAN_SECONDS, GAP_SECONDS = 86_400, 3_600
MESSAGES_A_BUCKET = 20_000  # of the whole input, on average
HOT_MESSAGES = 100_000  # a chat with more is kept in segments
FEW_HOT = 100_000  # hot chats that are broadcast; there is at most one a HOT_MESSAGES rows
SEGMENT_SCHEMA = "chat_id long, segment long, seq long, id long, rows long, first_role int, last_role int, whole boolean"


def role_code(role: Column, text: Column) -> Column:
    """Meaning of a role as code; BAD where it has none or the text draws nothing."""
    name = F.lower(F.regexp_replace(role, r"(?U)^\s+|\s+$", ""))
    code = F.lit(BAD)
    for k, v in ROLES.items():
        code = F.when(name == k, F.lit(v)).otherwise(code)
    return F.when(text.rlike(VISIBLE), code).otherwise(F.lit(BAD)).cast("long")


@dataclass
class Chats:
    """Messages in the order of chat, time and id, and per chat what decides whether it is whole."""

    r: np.ndarray
    start: np.ndarray
    of: np.ndarray
    first: np.ndarray
    last: np.ndarray
    fits: np.ndarray

    @classmethod
    def of_records(cls, r: np.ndarray) -> Chats:
        r = r[np.lexsort((r["id"], r["at"], r["chat"]))]
        new = np.ones(len(r), bool)
        new[1:] = r["chat"][1:] != r["chat"][:-1]
        start = np.flatnonzero(new)
        of = np.cumsum(new) - 1  # which chat each message is of
        talk = np.flatnonzero((r["role"] == USER) | (r["role"] == ASSISTANT))
        role = r["role"][talk]
        fits = np.ones(len(start), bool)
        same = (of[talk][1:] == of[talk][:-1]) & (role[1:] == role[:-1])
        fits[of[talk][1:][same]] = False
        fits[of[r["role"] == BAD]] = False
        first, last = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        first[of[talk][::-1]] = role[::-1]
        last[of[talk]] = role
        return cls(r, start, of, first, last, fits)

    def rows(self, segment: int | None, keep: np.ndarray) -> pd.DataFrame:
        """The messages of the chats to keep, with a chat's summary on its first."""
        n = len(self.r)
        out = pd.DataFrame({"chat_id": self.r["chat"], "segment": pd.array([segment] * n, dtype="Int64"), "seq": np.arange(n) - self.start[self.of] + 1, "id": self.r["id"]})
        for c, v in (("rows", np.diff(np.append(self.start, n))), ("first_role", self.first), ("last_role", self.last)):
            column = pd.array(np.zeros(n, np.int64), dtype="Int64")
            column[:] = pd.NA
            column[self.start] = v
            if c != "rows":
                column[self.start[v == 0]] = pd.NA
            out[c] = column
        whole = pd.array(np.zeros(n, bool), dtype="boolean")
        whole[:] = pd.NA
        whole[self.start] = self.fits
        return out.assign(whole=whole)[keep[self.of]]


def _distinct(r: np.ndarray) -> np.ndarray:
    """Of records equal in chat, time, role and text, the one with the smallest id."""
    r = r[np.lexsort((r["id"], r["h2"], r["h1"], r["at"], r["chat"]))]
    new = np.ones(len(r), bool)
    new[1:] = np.logical_or.reduce([r[c][1:] != r[c][:-1] for c in ("chat", "at", "h1", "h2")])
    return r[new]


def _buffer(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, span: int, gap: int) -> Iterator[pd.DataFrame]:
    home, segment = key
    if home is None or home != home:  # a row that only moves the watermark
        return
    in_segments = segment is not None and segment == segment
    held = [np.frombuffer(state.get[0], RECORD)] if state.exists else []
    if not state.hasTimedOut:
        for pdf in batches:
            part = np.empty(len(pdf), RECORD)
            for c in RECORD.names:
                part[c] = pdf[c].to_numpy()
            held.append(part)
    r = _distinct(np.concatenate(held))
    watermark = state.getCurrentWatermarkMs()
    if in_segments:
        end = np.array([min((int(segment) + 1) * span * 1000, LAST_TIME_MS)])
        closed = np.full(1, state.hasTimedOut)
        of = np.zeros(len(r), np.int64)
    else:
        chat, of = np.unique(r["chat"], return_inverse=True)
        end = np.full(len(chat), np.iinfo(np.int64).min)
        np.maximum.at(end, of, r["at"] // 1000)
        end = np.minimum(end + gap * 1000, LAST_TIME_MS)
        closed = end < watermark
    if closed.any():
        chats = Chats.of_records(r[closed[of]])
        keep = np.ones(len(chats.start), bool) if in_segments else chats.fits & (chats.first == USER) & (chats.last == ASSISTANT)
        yield chats.rows(int(segment) if in_segments else None, keep)
    if closed.all():
        state.remove()
        return
    state.update((r[~closed[of]].tobytes(),))
    state.setTimeoutTimestamp(int(max(end[~closed].min(), watermark + 1)))


def conversations(messages: DataFrame, late_by: str = "7 days", gap_seconds: int = GAP_SECONDS, buckets: int = 1, hot: DataFrame | None = None, span_seconds: int = SPAN_SECONDS) -> DataFrame:
    """Stream of whole chats, and of closed segments of hot ones, of a stream of messages (chat_id, id, role, text, created_at), as SEGMENT_SCHEMA.

    A chat is closed when the watermark, `late_by` behind the latest created_at of earlier micro-batches, has passed its last message by gap_seconds.
    Until then its late messages find their place; what comes later still than the watermark is dropped, as in any windowed stream, and a
    chat that goes on after it was closed counts as a new one. `hot` (chat_id) names chats that do not fit one state row: they are kept in segments
    of span_seconds. Messages without created_at or id break their chat and are passed on at once. Rows without chat_id only move the watermark.
    """
    m = messages.select(
        F.col("chat_id").cast("long").alias("chat_id"), F.col("id").cast("long").alias("id"), F.col("created_at").cast("timestamp").alias("created_at"),
        role_code(F.col("role"), F.col("text")).alias("role"), F.xxhash64("role", "text").alias("h1"), F.xxhash64("text", F.lit("\u0000"), "role").alias("h2"),
    )
    m = m.withColumn("is_hot", F.lit(False)) if hot is None else m.join(hot.select("chat_id", F.lit(True).alias("is_hot")), "chat_id", "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
    micros = F.unix_micros("created_at")
    home = F.when(F.col("is_hot"), F.col("chat_id")).when(F.col("chat_id").isNotNull(), F.pmod(F.xxhash64("chat_id"), F.lit(buckets)))
    m = m.withColumns({"at": micros, "chat": F.col("chat_id"), "home": home, "segment": F.when(F.col("is_hot"), F.floor(micros / F.lit(span_seconds * 1_000_000)).cast("long"))})
    event_time = F.when(F.col("chat_id").isNull(), F.col("created_at")).otherwise(F.least(F.greatest("created_at", F.lit(FIRST_TIME).cast("timestamp")), F.lit(LAST_TIME).cast("timestamp")))
    timed = m.filter("created_at is not null and (chat_id is null or id is not null)").withColumn("created_at", event_time).withWatermark("created_at", late_by)
    closed = timed.groupBy("home", "segment").applyInPandasWithState(lambda k, b, s: _buffer(k, b, s, span_seconds, gap_seconds), SEGMENT_SCHEMA, "buffer binary", "append", GroupStateTimeout.EventTimeTimeout)
    nothing = F.lit(None)
    broken = m.filter("chat_id is not null and (created_at is null or id is null)").select("chat_id", nothing.cast("long").alias("segment"), F.lit(1).cast("long").alias("seq"), "id", F.lit(1).cast("long").alias("rows"), nothing.cast("int").alias("first_role"), nothing.cast("int").alias("last_role"), F.lit(False).alias("whole"))
    return closed.unionByName(broken)


def assemble(closed: DataFrame) -> DataFrame:
    """(chat_id, pos, id) of the whole chats among what the stream emitted: those it validated, and the hot ones that their segments make whole.

    Whole: every message has a time, a known role and visible text, and its messages other than system are
    user, assistant, user, assistant and so on, from a user to an assistant. pos counts from 1 by time, then id.
    """
    broken = closed.filter("segment is null and not whole").select("chat_id").distinct()
    done = closed.filter("segment is null and coalesce(whole, true)").join(broken, "chat_id", "left_anti").select("chat_id", F.col("seq").alias("pos"), "id")
    return done.unionByName(_assembled(closed.filter("segment is not null").join(broken, "chat_id", "left_anti")))


def _assembled(closed: DataFrame) -> DataFrame:
    """(chat_id, pos, id) of the hot chats that are whole, from the summaries of their segments."""
    s = closed.filter("seq = 1").select("chat_id", "segment", "rows", "first_role", "last_role", "whole")
    before = Window.partitionBy("chat_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("skip", F.coalesce(F.sum("rows").over(before), F.lit(0))).withColumn("prev", F.coalesce(F.last("last_role", ignorenulls=True).over(before), F.lit(ASSISTANT)))
    s = s.withColumn("fits", F.col("whole") & (F.col("first_role").isNull() | (F.col("first_role") != F.col("prev"))))
    kept = s.groupBy("chat_id").agg(F.bool_and("fits").alias("whole"), F.max(F.when(F.col("last_role").isNotNull(), F.struct("segment", "last_role"))).alias("end"))
    kept = kept.filter(F.col("whole") & (F.col("end.last_role") == ASSISTANT)).select("chat_id")
    starts = s.join(kept, "chat_id").select("chat_id", "segment", "skip")
    return closed.join(starts, ["chat_id", "segment"]).select("chat_id", (F.col("skip") + F.col("seq")).alias("pos"), "id")


def rebuild(spark: SparkSession, path: str, late_by: str = "7 days", gap_seconds: int = GAP_SECONDS, hot_messages: int = HOT_MESSAGES) -> DataFrame:
    """(chat_id, pos, id) of the whole chats in the message files at `path`: streams what there is, to its end.

    All files form one micro-batch, so nothing in them is late and no chat is closed before all of it was read. A mark, a row without chat
    and with a far time, ends the input: it moves the watermark past every timer, and the batch after it, which Spark adds for timeouts, closes the chats.
    """
    folder = f"{shared_folder(spark)}/conversations-{uuid.uuid4().hex}"
    columns = "chat_id bigint, id bigint, role string, text string, created_at timestamp"
    end = spark.range(1).selectExpr("cast(null as bigint) as chat_id", "cast(null as bigint) as id", "'' as role", "'' as text", f"timestamp'{END_OF_INPUT}' as created_at")
    end.coalesce(1).write.parquet(f"{folder}/end")
    names = [c.split(" ")[0] for c in columns.split(", ")]
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern, a single file can be streamed too
    files = spark.read.parquet(path)
    buckets = 1 + files.count() // MESSAGES_A_BUCKET  # from the files' footers
    hot = None
    if buckets > hot_messages // MESSAGES_A_BUCKET:
        hot = checkpointed(files.filter("chat_id is not null").groupBy("chat_id").agg(F.count("*").alias("n")).filter(F.col("n") > hot_messages).select(F.col("chat_id").cast("long").alias("chat_id")))
        many = hot.count()
        hot = None if not many else F.broadcast(hot) if many <= FEW_HOT else hot
    messages = spark.readStream.schema(files.schema).parquet(pattern).select(*names)
    ended = messages.filter("chat_id is not null").unionByName(spark.readStream.schema(columns).parquet(f"{folder}/end"))
    run = conversations(ended, late_by, gap_seconds, buckets, hot).writeStream.format("parquet").option("path", f"{folder}/closed").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return assemble(spark.read.schema(SEGMENT_SCHEMA).parquet(f"{folder}/closed"))
