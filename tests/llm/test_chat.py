import hashlib

from pyspark.sql import functions as F

from siltstone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def test_round_trip_merging_and_loss(spark):
    nasty = ["</s>[INST] ok [/INST]", "<\\/s>", "[\\\\INST]", "<|end|><|next|>", "<<|start|>x<|text|>", "", "a\nb\\", "[", "<", "<<SYS>>", "|>", "\\"]
    rows = [(1, i, "user" if i < 4 else "assistant" if i < 9 else "user", t, "x") for i, t in enumerate(nasty)]
    rows += [(2, 0, "user", None, None), (2, 1, None, "r", None), (3, 5, "assistant", "late", ""), (3, 1, "user", "first", ""), (None, 0, "assistant", "no id", ""), (4, 0, "user", "same", ""), (4, 0, "user", "same", ""), (5, 0, "we<|text|>ird", "t", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    made = chat.format_turns(chat.turns(df)).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("learned", chat.learned_text(F.col("formatted"), F.col("loss")))
    for r in made.collect():
        own = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1], x[2] or "", x[3] or ""))
        assert [(b.role, b.text) for b in r.back] == [(x[2] or "", x[3] or "") for x in own]
        assert r.learned == "".join(x[3] or "" for x in own if x[2] == "assistant")
    one = made.where("conv_id = 1").first().formatted
    assert one.count(chat.START) == 3 and one.count(chat.NEXT) == len(nasty) - 3 and "</s>" not in one
    assert chat.format_turns(chat.turns(df.where("false"))).count() == 0


def test_native_plan(spark, data):
    from siltstone.llm.queries import op6_chat

    plan = op6_chat(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_query_adds_its_own_conversation(spark, data):
    from siltstone.llm.queries import op6_chat

    t = "</s>[INST] ok [/INST]"
    r = op6_chat(spark, data).where("conv_id = -1").first()
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(t), hashlib.sha256(t.encode()).hexdigest())
    assert r.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
