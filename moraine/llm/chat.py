r"""Chat formatting in windows of a token budget.

A conversation is a sequence of turns with running token sums: the tokens of the
vocabulary at a path, and three for the template of each turn. A window takes
new turns from where the last one ended, up to the last turn whose running sum
still fits; it begins with the conversation's system turn and with up to
`history` of the turns before, as far as the budget allows. A turn is never
cut: one that alone exceeds the budget gets a window without history, and
over_budget tells so. Only the
texts of new assistant turns are under the loss mask, so repeated history is
masked and each assistant text counts once.

The template is <|turn|>role, newline, text, <|end|>, newline. Control strings
inside a role or text get a backslash after their first character (one more
than they had), which unescape takes away again.

Turns are handled in the order (turn, role, text) as a stream: a task keeps the
history of one conversation, not the conversation. Null roles and texts are
empty, a null conv_id is a conversation of its own, repeated rows are turns of
their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .bpe import default_path, word_bpe
from .common import ready, table

BUDGET, HISTORY = 512, 2
OPEN, CLOSE = "<|turn|>", "<|end|>"
# Control strings of public chat templates.
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>")
_TAILS = "|".join(sorted({re.escape(x[1:]) for x in CONTROL}))
_PLAIN = re.compile(rf"([<\[]\\*)(?={_TAILS})")
_QUOTED = re.compile(rf"([<\[]\\*)\\(?={_TAILS})")


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _QUOTED.sub(r"\1", text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


WINDOWS = "conv_id long, window long, n_system int, n_repeated int, n_new int, n_tokens long, over_budget boolean, text string, loss array<struct<start:long,end:long>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_WINDOW_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), _SPAN)


#: Tokens that the template adds to a turn.
TEMPLATE_TOKENS = 3
Count = Callable[[str], int]


def turn_tokens(role: str, text: str, count: Count) -> int:
    return count(role) + count(text) + TEMPLATE_TOKENS


def windows_of(turns: Iterator[tuple[str, str]], budget: int, history: int, count: Count) -> Iterator[tuple]:
    """(n_system, n_repeated, n_new, n_tokens, over_budget, text, loss spans) for one conversation's turns. count: tokens of a text."""
    system: tuple | None = None
    past: deque[tuple] = deque(maxlen=history) if history else deque(maxlen=0)
    new: list[tuple] = []  # (role, text, running sum before, running sum after)
    total = start = 0
    repeated: list[tuple] = []

    def shown() -> tuple:
        head = [system] if system and not (new and new[0] is system) else []
        text, spans, at = [], [], 0
        for k, turn in enumerate((*head, *repeated, *new)):
            mark, body = f"{OPEN}{escape_role(turn[0])}\n", escape(turn[1])
            text.append(f"{mark}{body}{CLOSE}\n")
            if turn[0] == "assistant" and k >= len(head) + len(repeated):
                spans.append({"start": at + len(mark), "end": at + len(mark) + len(body)})
            at += len(text[-1])
        tokens = sum(x[3] - x[2] for x in (*head, *repeated, *new))
        return len(head), len(repeated), len(new), tokens, tokens > budget, "".join(text), spans

    room = budget
    for k, (role, text) in enumerate(turns):
        turn = (role, text, total, total + turn_tokens(role, text, count))
        if new and turn[3] - start > room:
            yield shown()
            past.extend(new)
            new, start = [], total
            left = budget - (turn[3] - turn[2]) - (system[3] - system[2] if system else 0)
            repeated = []
            for old in reversed(past):
                left -= old[3] - old[2]
                if old is system or left < 0:
                    break
                repeated.insert(0, old)
            room = budget - sum(x[3] - x[2] for x in repeated) - (system[3] - system[2] if system else 0)
        new.append(turn)
        total = turn[3]
        if not k and role == "system":
            system = turn
    if new:
        yield shown()


def in_order(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Rows of the batches, a small part at a time."""
    for big in batches:
        for at in range(0, big.num_rows, 256):
            batch = big.slice(at, 256)
            yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns))


def by_key(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Group neighbours by their first value without holding a group."""
    from itertools import groupby

    return groupby(rows, key=lambda r: r[0])


def chunks(rows: Iterator[tuple], kinds: tuple, names: list[str], size: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows and about 4 MB of text."""
    part, weight = [], 0
    for r in rows:
        part.append(r)
        weight += sum(len(x) for x in r if isinstance(x, str))
        if len(part) >= size or weight > 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names)
            part, weight = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), kinds)], names)


def format_windows(turns: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """WINDOWS of every conversation; a partition holds whole conversations, in order. path: of the vocabulary."""
    names = [x.split()[0] for x in WINDOWS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)

        def count(text: str) -> int:
            return len(bpe.encode(text)) // 4

        def rows() -> Iterator[tuple]:
            for conv, own in by_key(in_order(batches, "conv_id", "role", "text")):
                for k, w in enumerate(windows_of(((r, t) for _, r, t in own), budget, history, count)):
                    yield (conv, k, *w)

        yield from chunks(rows(), _WINDOW_TYPES, names, 64)

    ready(turns.sparkSession)
    rows = turns.selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "coalesce(cast(role as string), '') role", "coalesce(cast(text as string), '') text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, WINDOWS)


def parse_window(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted window, unescaped."""
    out = []
    for part in text.split(OPEN)[1:]:
        role, _, body = part.partition("\n")
        out.append((unescape_role(role), unescape(body[: -len(CLOSE) - 1])))
    return out


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(windows: DataFrame) -> DataFrame:
    """DIGEST per conversation, from the windows' texts and spans alone; takes format_windows' rows in its order."""
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for conv, own in by_key(in_order(batches, "conv_id", "n_system", "n_repeated", "text", "loss")):
                turns, loss = hashlib.sha256(), hashlib.sha256()
                n = chars = formatted = 0
                for _, system, repeated, text, spans in own:
                    for role, body in parse_window(text)[system + repeated :]:
                        turns.update(f"{role}\n{body}\n".encode())
                        n += 1
                    for s in spans:
                        body = unescape(text[s["start"] : s["end"]])
                        loss.update(body.encode())
                        chars += len(body)
                    formatted += len(text)
                yield conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

        yield from chunks(rows(), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), names, 4096)

    return windows.mapInArrow(run, DIGEST)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as bigint) conv_id", "cast(turn as bigint) turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return read_back(format_windows(turns.unionByName(extra), default_path()))
