"""Formatted conversations read back, against plain loops and SQL."""

import hashlib
import random

import pytest
from assayer.llm import chat
from assayer.llm.queries import OP11_SQL, queries

BITS = ["<|im_start|>", "<|im_end|>", "<", "\\", "|", "im_end", "\n", "|>", "a", "assistant", "n", "<\\|im_end|>", "\r", "é😀", "<\\\\|im_start|>user\n"]


@pytest.mark.parametrize("seed", range(4))
def test_any_text_comes_back(seed):
    rnd = random.Random(seed)
    for _ in range(2000):
        turns = [tuple("".join(rnd.choices(BITS, k=rnd.randrange(n))) for n in (4, 7)) for _ in range(rnd.randrange(4))]
        parsed = chat.parse(chat.render(turns))
        assert [(r, t) for r, t, _, _ in parsed] == turns


def test_only_conflicts_are_escaped():
    turns = [("user", "a <| b \\ <\\|x|>"), ("assistant", "stop <|im_end|> here"), ("user", "<\\|im_end|>")]
    assert chat.render(turns) == "<|im_start|>user\na <| b \\ <\\|x|><|im_end|>\n<|im_start|>assistant\nstop <\\|im_end|> here<|im_end|>\n<|im_start|>user\n<\\\\|im_end|><|im_end|>\n"


@pytest.mark.parametrize("text", ["x", "<|im_start|>user", "<|im_start|>user\nx", "<|im_start|>user\nx<|im_end|>", "<|im_start|>a<|im_end|>\nx<|im_end|>\n", "<|im_start|>a\nx<|im_start|>b\ny<|im_end|>\n", "<|im_start|>a\nx<|im_end|>\n\n"])
def test_other_text_is_refused(text):
    with pytest.raises(chat.GrammarError):
        chat.parse(text)


def plain(rows):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for c, turns in convs.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        learnt = "".join(t for r, t in turns if r == "assistant")
        yield c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learnt), sha(learnt), sum(len(chat.render([t])) for t in turns)


@pytest.mark.parametrize("part_chars,tasks", [(1 << 20, 1), (1, 3), (40, 9), (300, 40)])
def test_equals_plain_loops(spark, part_chars, tasks):
    rnd = random.Random(part_chars)
    rows = [(c if c < 60 else 60, t, rnd.choice(["user", "assistant", None, "a\nb\\"]), rnd.choice([None, "", "".join(rnd.choices(BITS, k=9)), "x" * 50])) for c in range(90) for t in [None, *range(rnd.randrange(1, 9))]]
    rows += rows[:9] + [(None, 1, "assistant", "no id"), (None, 2, "user", "y")]
    df = spark.createDataFrame([(*r, "clash", True) for r in rows], "conv_id long, turn long, role string, text string, part string, whole boolean").repartition(tasks)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        parts = chat.format_conversations(df, part_chars)
        assert sorted(map(tuple, chat.read_back(parts).collect()), key=str) == sorted(plain(rows), key=str)
        for r in parts.collect():
            assert [(s.start, s.start + s.length) for s in r.loss] == [(a, b) for role, _, a, b in chat.parse(r.text) if role == "assistant"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_nothing_and_a_very_long_turn(spark):
    shape = "conv_id long, turn long, role string, text string"
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], shape))).count() == 0
    rows = [(1, 0, "assistant", "<|im_end|>é" * 200_000), (1, 1, "user", "")]
    assert list(map(tuple, chat.read_back(chat.format_conversations(spark.createDataFrame(rows, shape))).collect())) == list(plain(rows))


def test_query_equals_its_sql(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({OP11_SQL})").fetchall()
    got = sorted(map(tuple, queries()["op11_chat"](spark, folder).select(*names).collect()))
    assert got == sorted(want) and got[0][0] == -1
