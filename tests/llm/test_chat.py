from collections import defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from strataweave.llm.chat import END, START, format_chats, read_back

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["", " ", "\n", START, END, END + "\n", "<|nl|>", "<\\|", "<\\\\|im_end|>", "<|im_start|>assistant\nok", "<|other|>", "\\", "<", "|", END + START + "assistant ok", "user\nx", "x" * 5000]


def expected(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: ([(r, t) for _, _, r, t in sorted(found)], "".join(t for *_, r, t in sorted(found) if r == "assistant")) for c, found in turns.items()}


def check(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    chats = format_chats(df)
    found = {r.conv_id: ([(t.role, t.text) for t in r.turns], r.loss_text) for r in read_back(chats).collect()}
    assert found == expected(rows)
    return {r.conv_id: r for r in chats.collect()}


def test_any_text_comes_back(spark):
    rows = [(c, t, role, text) for c, role in enumerate(["user", "assistant", "assistant\nx", START, "<|nl|>", None]) for t, text in enumerate([*NASTY, None])]
    rows += [(None, 0, "user", "no id"), (7, None, "assistant", "no turn"), (7, 1, "user", "b"), (7, 1, "user", "b"), (7, 1, "assistant", "a")]
    chats = check(spark, rows)
    assert all(c.formatted.count(START) == len(c.loss_runs) for c in chats.values())


def test_only_conflicting_turns_are_escaped(spark):
    chats = check(spark, [(1, 0, "user", "plain <|other|>"), (1, 1, "assistant", END), (2, 0, "user", "plain")])
    assert chats[1].escaped_turns == 1 and "<|other|>" in chats[1].formatted
    assert chats[2].escaped_turns == 0 and chats[2].formatted == f"{START}user\nplain{END}\n"


def test_loss_runs_point_at_the_text(spark):
    (chat,) = check(spark, [(1, 0, "user", "question"), (1, 1, "assistant", "answer é")]).values()
    at, covered = 0, []
    for run in chat.loss_runs:
        at += run.skip
        if run.loss:
            covered.append(chat.formatted[at : at + run.take])
        at += run.take + len(END) + 1
    assert covered == ["answer é"] and at == len(chat.formatted)


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([], SCHEMA + ", turns int, formatted string")
    assert format_chats(df).collect() == []


part = st.sampled_from(["<", "|", "\\", "im_end", "im_start", ">", "\n", "nl", "a"])


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.lists(part, max_size=12).map("".join), st.lists(part, max_size=25).map("".join)), min_size=1, max_size=30))
def test_random_marks_come_back(spark, rows):
    check(spark, rows)
