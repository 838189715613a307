from pyspark.sql import functions as F

from skarnwell.llm import conversations as C

SCHEMA = "chat_id long, id long, role string, text string, created_at timestamp, pos string"


def write(spark, path, rows):
    df = spark.createDataFrame([(c, i, r, t, s, "extra") for c, i, r, t, s in rows], "chat_id long, id long, role string, text string, s double, pos string")
    df.select("chat_id", "id", "role", "text", F.timestamp_micros((F.col("s") * 1000000).cast("long")).alias("created_at"), "pos").coalesce(1).write.mode("append").parquet(path)


def found(df):
    out = {}
    for r in df.orderBy("chat_id", "pos").collect():
        out.setdefault(r.chat_id, []).append((r.pos, r.id))
    return {k: [i for _, i in v] for k, v in out.items() if [p for p, _ in v] == list(range(1, len(v) + 1))}


def test_whole_chats_only(spark, tmp_path):
    day = 86400.0
    rows = [
        (1, 10, "User ", "hi", 5.0), (1, 9, "bot", "yo", 6.0), (1, 8, "SYSTEM", "s", 1.0), (1, 11, "human", "more", day + 1), (1, 12, "AI", "ok", day + 1),
        (2, 20, "user", "hi", 1.0),  # no reply
        (3, 30, "user", "a", 1.0), (3, 31, "user", "b", 2.0), (3, 32, "ai", "c", 3.0),  # two in a row
        (4, 40, "user", "a", 1.0), (4, 41, "ai", "​  ", 2.0),  # nothing visible
        (5, 50, "user", "a", 1.0), (5, 51, "moderator", "b", 2.0),
        (6, 60, "user", "a", None), (6, 61, "ai", "b", 2.0),
        (7, 70, "user", "a", 1.0), (7, 71, "ai", "b", 2.0), (7, 72, "user", "a", 1.0), (7, 71, "ai", "b", 2.0),  # the same again, repeated row
        (8, 80, "system", "s", 1.0),
        (None, 90, "user", "a", 1.0), (None, 91, None, None, None),
        (9, 92, "ai", "a", 1.0), (9, 93, "user", "b", 2.0),
        (10, 100, "user", "a", 4.0), (10, 99, "ai", "b", 4.0),  # equal times go by id: the answer comes first
        (11, 110, "user", None, 1.0), (11, 111, "ai", "b", 2.0),
        (12, 120, "user", "x" * 100_000, -1.0), (12, 121, "ai", "b", 9e9),  # before 1970, after 2250
        (13, 130, "user", "a", 1e10), (13, 131, "ai", "b", 1.1e10),  # beyond nanosecond timestamps
    ]
    path = str(tmp_path / "messages.parquet")
    write(spark, path, rows[:12])
    write(spark, path, rows[12:])
    want = {1: [8, 10, 9, 11, 12], 7: [70, 71], 12: [120, 121], 13: [130, 131]}
    assert found(C.rebuild(spark, path)) == want
    assert found(C.rebuild(spark, path, hot_messages=1)) == want  # as hot chats, in segments
    assert found(C.rebuild(spark, path, hot_messages=3)) == want  # some hot, some not


def test_one_file_and_empty_table(spark, tmp_path):
    path = str(tmp_path / "m.parquet")
    write(spark, path, [(1, 1, "user", "a", 1.0), (1, 2, "ai", "b", 2.0)])
    one = next((tmp_path / "m.parquet").glob("*.parquet"))
    assert found(C.rebuild(spark, str(one))) == {1: [1, 2]}
    empty = str(tmp_path / "e.parquet")
    spark.createDataFrame([], SCHEMA).write.parquet(empty)
    assert C.rebuild(spark, empty).count() == 0


def test_late_arrivals_and_timeouts_across_batches(spark, tmp_path):
    """A message that comes in a later micro-batch finds its place while its chat is open; the chat is emitted when it was inactive for long enough."""
    src = str(tmp_path / "in")
    run = lambda: C.conversations(spark.readStream.schema(SCHEMA).parquet(src + "/*"), "1 day", 7200, 2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    emitted = lambda: found(C.assemble(spark.read.schema(C.SEGMENT_SCHEMA).parquet(str(tmp_path / "out"))))
    day, hour = 86400.0, 3600.0
    write(spark, src + "/0", [(1, 2, "ai", "b", 20.0)])
    run()
    assert emitted() == {}
    write(spark, src + "/1", [(1, 1, "user", "a", 10.0), (4, 8, "user", "open", 9 * day - hour), (4, 9, "ai", "soon", 9 * day + hour), (2, 5, "user", "x", 10 * day)])
    run()
    assert emitted() == {1: [1, 2]}  # chat 4 was active within two hours of the watermark
    write(spark, src + "/2", [(1, 3, "user", "too late", 30.0), (2, 6, "ai", "y", 10 * day + 1), (5, 10, "user", "no reply", 10 * day), (3, 7, "user", "z", 30 * day)])
    run()
    assert emitted() == {1: [1, 2], 2: [5, 6], 4: [8, 9]}
