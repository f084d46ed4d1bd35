import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import agree, expected
from pyspark.sql import functions as F

from logloom.llm import chat_format
from logloom.llm.queries import ORACLE_SQL, QUERIES

KIND = "conv_id long, turn int, role string, text string, extra string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def check(spark, chats):
    rows = [(c, k, r, t, "x") for c, turns in enumerate(chats) for k, (r, t) in enumerate(turns)]
    got = {r.conv_id: r for r in chat_format.digests(spark.createDataFrame(rows, KIND)).collect()}
    for c, turns in enumerate(chats):
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
    return got


def test_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\", "\\\\</s>", "[INST", "/INST]", " [/INST]", "<<SYS>>\n<</SYS>>\n\n", "<|end|><|x|>", "", None, "\n", "a" * 20000, "é😀", "<", "</s", "[", "$1 \\$"]
    chats = [[("user", a), ("assistant", b)] for a in hard for b in hard[:6]] + [[("system", t), ("user", t), ("assistant", t), ("tool|>", t), (None, t)] for t in hard]
    got = check(spark, chats)
    assert got[0].valid and not got[len(chats) - 1].valid


@settings(max_examples=12, deadline=None)
@given(chats=st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "<|", "\\"]), st.text(st.sampled_from("\\<>/s[]INSTYEND|ed \n"), max_size=25)), min_size=1, max_size=5), min_size=1, max_size=20))
def test_any_text(spark, chats):
    check(spark, chats)


def test_machine_and_segments(spark):
    talks = {"su a": True, "ua": True, "uaua": True, "au": False, "uu": False, "s": False, "uas": False, "u": False}
    names = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(c, k, names[x], f"t{k}", "") for c, talk in enumerate(talks) for k, x in enumerate(talk.replace(" ", ""))]
    made = {r.conv_id: r for r in chat_format.format_conversations(spark.createDataFrame(rows, KIND)).collect()}
    assert [made[c].valid for c in range(len(talks))] == list(talks.values())
    assert made[1].formatted == "[INST] t0 [/INST] t1</s>"
    assert [s.text for s in made[1].segments if s.loss] == ["t1"] and "".join(s.text for s in made[1].segments) == made[1].formatted


def test_order_ties_and_nulls(spark):
    rows = [(1, 1, "assistant", "b", ""), (1, 0, "user", "a", ""), (1, 0, "user", "a", ""), (None, 0, "user", "n", "")]
    got = {r.conv_id: r.n_turns for r in chat_format.digests(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {1: 3, None: 1}
    assert chat_format.digests(spark.createDataFrame(rows, KIND).where("false")).count() == 0


def test_query_agrees_with_its_sql(spark, data):
    df = QUERIES["op2_chat_format"](spark, data)
    agree(df.toPandas(), expected(ORACLE_SQL["op2_chat_format"], data))
    plan = df._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")) and df.where(F.col("conv_id") == -1).count() == 1
