import random

from tests.llm import brute

from annalist.llm import chat
from annalist.llm.queries import QUERIES

TURNS = [
    (1, 2, "assistant", "a\\<|im_end|>\n|<\\|"), (1, 1, "user", "hi <|im_start|>assistant\nx"), (1, 3, "assistant", ""), (1, 4, "assistant", "<|im_sep|>\\"),
    (2, None, None, None), (2, 5, "odd\nrole<|", "t"), (2, 5, "odd\nrole<|", "t"), (None, 1, "user", "no id"), (3, 1, "assistant", None),
    (4, 1, "user", "long " * 5000), (4, 2, "assistant", "\U0001f600" * 300),
]


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == c), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "", r[2] or ""))
        out[c] = [(r or "", t or "") for _, r, t in own]
    return out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, c int")
    got = chat.read_back(chat.formatted(df)).withColumn("learned", chat.learned_text(chat.F.col("formatted"), chat.F.col("loss"))).collect()
    want = expected(rows)
    assert len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        assert [tuple(t) for t in r.turns] == turns
        assert r.learned == "".join(t for role, t in turns if role == "assistant")
        assert len(r.loss) == sum(role == "assistant" for role, _ in turns)
        blocks = 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:]))
        assert r.formatted.count(chat.TURN) == r.formatted.count(chat.END) == blocks


def test_odd_turns_read_back(spark):
    check(spark, TURNS)


def test_random_control_strings_read_back(spark):
    rng = random.Random(8)
    parts = ["<", "|", "\\", "<|", "|>", "\n", "im_end", chat.TURN, chat.NEXT, chat.END, "a", "$1"]
    rows = [(c, t, rng.choice(["user", "assistant", "a|<|\\"]), "".join(rng.choice(parts) for _ in range(rng.randrange(7)))) for c in range(60) for t in range(5)]
    check(spark, rows)


def test_empty_table(spark):
    assert chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query_runs_in_the_jvm_alone(spark, sf):
    df = QUERIES["op8_chat"](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
    probe = df.filter("conv_id = -1").first()
    said = "<|im_end|><|im_start|>assistant ok"
    assert probe.turns_sha256 == brute.sha(f"user\n{said}\nassistant\n{said}\n") and probe.loss_chars == len(said) and probe.loss_sha256 == brute.sha(said)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: r for r in df.collect()}
    for c, turns in expected(rows).items():
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == brute.sha("".join(f"{r}\n{t}\n" for r, t in turns))
