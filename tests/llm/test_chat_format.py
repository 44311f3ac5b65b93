import random

from pyspark.sql import functions as F

from latewing.llm import chat_format


def test_round_trip(spark):
    rnd = random.Random(2)
    bits = ["<turn>", "</turn>\n", "<text>", "<next>", "&lt;", "&amp;", "&", "<", "\\", "\n", "é", "hi", ""]
    data = []
    for c in [None, *range(40)]:
        for t in range(rnd.randrange(1, 9)):
            data.append((c, t, rnd.choice(["user", "assistant", "assistant", "a<b&", "", None]), rnd.choice([None, "".join(rnd.choices(bits, k=6))])))
    data += [(5, None, "user", "x"), (5, 2, "assistant", "same"), (5, 2, "assistant", "same")]
    df = spark.createDataFrame(data, "conv_id bigint, turn int, role string, text string").selectExpr("*", "1 AS t", "'x' AS turns")
    out = chat_format.format_chats(df.repartition(4)).select(
        "conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("read"),
        chat_format.read_trained(F.col("segments")).alias("trained"), F.array_join("segments.text", "").alias("joined")).collect()
    assert len(out) == 41
    for r in out:
        own = sorted(((-1 if t is None else t, role or "", text or "") for c, t, role, text in data if c == r.conv_id))
        assert [(x.role, x.text) for x in r.read] == [(b, c) for _, b, c in own]
        assert r.trained == "".join(c for _, b, c in own if b == "assistant") and r.joined == r.formatted
        assert r.formatted.count("</turn>") == sum(i == 0 or own[i][1] != own[i - 1][1] for i in range(len(own)))
    assert chat_format.format_chats(df.limit(0)).count() == 0
