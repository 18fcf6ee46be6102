import hashlib
import random

from moraine.llm import chat
from moraine.llm.bpe import default_path, word_bpe

TURNS = "conv_id long, turn long, role string, text string, window int"


def test_escape_round_trip():
    rng = random.Random(1)
    parts = [*chat.CONTROL, "<", "[", "\\", "|", "/", "INST]", "s>", "n", "\n", "SYS>>", "<<"]
    for _ in range(3000):
        x = "".join(rng.choices(parts, k=rng.randint(0, 8)))
        y = chat.escape(x)
        assert chat.unescape(y) == x and not any(c in y for c in chat.CONTROL)
        r = chat.escape_role(x)
        assert chat.unescape_role(r) == x and "\n" not in r and not any(c in r for c in chat.CONTROL)


def test_windows_and_digests(spark):
    rng = random.Random(2)
    rows = []
    for conv in [*range(40), None]:
        for t in range(rng.randint(1, 30)):
            role = "system" if not t and rng.random() < 0.5 else rng.choice(["user", "assistant", None, "tool\nx"])
            text = rng.choice([None, "", "hello " * rng.randint(1, 700), "</s>[INST] ok [/INST]", "a\\<\\s>é"])
            rows.append((conv, rng.choice([t, t, 3]), role, text, 5))
    rows.append((7, None, "user", "no turn", 5))
    df = spark.createDataFrame(rows, TURNS)
    windows = chat.format_windows(df, default_path()).collect()
    bpe = word_bpe(default_path())
    assert any(w.over_budget for w in windows)
    for w in windows:
        turns = chat.parse_window(w.text)
        assert len(turns) == w.n_system + w.n_repeated + w.n_new and w.n_new >= 1
        assert w.n_tokens == sum(len(bpe.encode(x)) // 4 for t in turns for x in t) + 3 * len(turns)
        assert w.over_budget == (w.n_tokens > chat.BUDGET)
        assert not w.over_budget or w.n_new == 1 and not w.n_repeated
        assert w.n_repeated <= chat.HISTORY
    got = {r.conv_id: r for r in chat.read_back(chat.format_windows(df, default_path())).collect()}
    convs = {}
    for conv, turn, role, text, _ in rows:
        convs.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    assert got.keys() == convs.keys()
    for conv, turns in convs.items():
        turns.sort(key=lambda x: (x[0], x[1] or 0, x[2].encode(), x[3].encode()))
        loss = "".join(x[3] for x in turns if x[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in turns).encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars == sum(len(w.text) for w in windows if w.conv_id == conv)


def test_history_and_system_turn():
    turns = [("system", "rules " * 10), *[(r, f"{i} " * 60) for i in range(10) for r in ("user", "assistant")]]
    found = list(chat.windows_of(iter(turns), 300, 2, lambda x: len(x.split())))
    assert len(found) > 2 and all(w[0] == 1 for w in found[1:]) and any(w[1] for w in found)
    assert sum(w[2] for w in found) == len(turns)


def test_empty_and_query(spark):
    assert chat.read_back(chat.format_windows(spark.createDataFrame([], TURNS), default_path())).collect() == []
    got = {r.conv_id: r for r in chat.op5_chat_format(spark, "/root/testdata/sf0.001").collect()}
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len("</s>[INST] ok [/INST]")
