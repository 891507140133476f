"""Chat formatting: a template with reversible escapes, and windows of a token budget.

Turns of a conversation reach one task in order and are streamed: what is held at a time is one window
and the turns that may be repeated, never a whole conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template (fixed values).
START, END = "<|im_start|>", "<|im_end|>"

WINDOW_SCHEMA = (
    "window long, formatted string, loss array<struct<start: long, end: long>>, repeated long, turns long, "
    "tokens long, over_budget boolean")
_LOSS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
ROWS_OUT = 256


def escaped(text: str) -> str:
    """No control string is left: every "<", backslashes, "|" gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role_out(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role), flags=re.S)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window, as they were before."""
    turns, at = [], 0
    while at < len(formatted):
        assert formatted.startswith(START, at)
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        turns.append((_role_in(formatted[at + len(START): line]), unescaped(formatted[line + 1: end])))
        at = end + len(END) + 1
    return turns


def counted_pieces(text: str) -> int:
    """Tokens of a text where no tokenizer is given: words and single marks."""
    return len(re.findall(r"\w+|[^\w\s]", text))


def tokenizer_counter(path: str) -> Callable[[], Callable[[str], int]]:
    """Counts by a tokenizer file of the `tokenizers` library; the path must be there on executors."""
    def load() -> Callable[[str], int]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)
    return load


class _Turn:
    __slots__ = ("role", "text", "upto", "before")

    def __init__(self, role: str, text: str, before: int, tokens: int) -> None:
        self.role, self.text, self.before, self.upto = role, text, before, before + tokens


class _Conversation:
    """Cuts a stream of turns into windows. `before` and `upto` of a turn are prefix sums of tokens,
    so the tokens of a span are a difference of two of them."""

    def __init__(self, conv, budget: int, history: int) -> None:
        self.conv, self.budget, self.history = conv, budget, history
        self.system: _Turn | None = None
        self.total, self.windows = 0, 0
        self.old: list[_Turn] = []  # may be repeated in the window that is open
        self.new: list[_Turn] = []

    def add(self, role: str, text: str, tokens: int) -> dict | None:
        first = self.total == 0 and self.system is None and not self.new
        turn = _Turn(role, text, self.total, tokens)
        if first and role == "system":
            self.system = turn
            self.new.append(turn)
            self.total = turn.upto
            return None
        done = None
        if self.new and self._base() + turn.upto - self._from() > self.budget and not self._only_system():
            done = self.flush()
            self.old = [t for t in self.old if turn.before - t.before <= self.history]
        if not self.new:
            while self.old and self._base() + turn.upto - self.old[0].before > self.budget:
                self.old.pop(0)
        self.new.append(turn)
        self.total = turn.upto
        return done

    def _only_system(self) -> bool:
        return self.system is not None and self.new == [self.system]

    def _base(self) -> int:
        """Tokens of the system turn where it is repeated."""
        return self.system.upto if self.system and self.windows else 0

    def _from(self) -> int:
        return (self.old or self.new)[0].before

    def flush(self) -> dict | None:
        if not self.new:
            return None
        again = ([self.system] if self.system and self.windows else []) + self.old
        parts, loss, at = [], [], 0
        for i, turn in enumerate([*again, *self.new]):
            head, text = f"{START}{_role_out(turn.role)}\n", escaped(turn.text)
            if i >= len(again) and turn.role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(text)})
            parts += [head, text, END, "\n"]
            at += len(head) + len(text) + len(END) + 1
        tokens = self._base() + self.new[-1].upto - self._from()
        out = {
            "conv": self.conv, "window": self.windows, "formatted": "".join(parts), "loss": loss,
            "repeated": len(again), "turns": len(again) + len(self.new), "tokens": tokens,
            "over_budget": tokens > self.budget}
        self.old = [t for t in self.old + self.new if t is not self.system]
        while self.old and self.old[-1].upto - self.old[0].before > self.history:
            self.old.pop(0)
        self.new, self.windows = [], self.windows + 1
        return out


def _windowed(budget: int, history: int, load: Callable | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load() if load else counted_pieces
        now, out, held, schema = None, [], 0, None

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, schema=schema)

        for batch in batches:
            schema = schema or pa.schema([
                ("conv", batch.schema.field("conv").type), ("window", pa.int64()), ("formatted", pa.string()),
                ("loss", _LOSS), ("repeated", pa.int64()), ("turns", pa.int64()), ("tokens", pa.int64()),
                ("over_budget", pa.bool_())])
            for conv, role, text in zip(*(batch[c].to_pylist() for c in ("conv", "role", "text"))):
                done = []
                if now is None or now.conv != conv:
                    done.append(now.flush() if now else None)
                    now = _Conversation(conv, budget, history)
                role, text = role or "", text or ""
                done.append(now.add(role, text, count(text)))
                for row in filter(None, done):
                    out.append(row)
                    held += len(row["formatted"])
                if len(out) >= ROWS_OUT or held > 1 << 22:
                    yield packed()
                    out, held = [], 0
        if now:
            out.append(now.flush())
            yield packed()
    return run


def chat_windows(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", *, budget: int = 2048, history: int = 256,
    counter: Callable[[], Callable[[str], int]] | None = None,
) -> DataFrame:
    """(conv, window, formatted, loss, repeated, turns, tokens, over_budget): training windows.

    A window holds whole turns. It begins with the conversation's system turn (its first turn, if
    that is a system turn) and the longest run of turns just before it of at most `history` tokens; new
    turns follow while all fit into `budget`. A turn that does not fit beside the history drops
    history; one larger than the budget stands alone after the system turn, with over_budget set, as no
    turn is cut. `repeated` is how many turns at the front were in an earlier window. `loss` lists the
    spans of `formatted` (code points) to train on: texts of new assistant turns; no repeated turn.
    So every assistant text is under the mask once. Rows come out in order within a partition.

    Rows are ordered by turn (null first), then role, then text, so ties and repeated rows have a
    place. null role or text: empty. A null conversation id is a conversation. Texts of any length stay
    whole. An empty table gives no rows. Other columns are not read.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    return ordered.select("conv", "role", "text").mapInArrow(
        _windowed(budget, history, counter), f"conv {kind}, {WINDOW_SCHEMA}")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out, schema = None, [], None

    def closed() -> dict:
        conv, n, all_, chars, loss, formatted = now
        return {"conv_id": conv, "n_turns": n, "turns_sha256": all_.hexdigest(), "loss_chars": chars,
                "loss_sha256": loss.hexdigest(), "formatted_chars": formatted}

    for batch in batches:
        schema = schema or pa.schema([
            ("conv_id", batch.schema.field("conv").type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        for row in batch.to_pylist():
            if now is None or now[0] != row["conv"]:
                if now:
                    out.append(closed())
                now = [row["conv"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parsed(row["formatted"])[row["repeated"]:]:
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in row["loss"]:
                text = unescaped(row["formatted"][span["start"]: span["end"]])
                now[3] += len(text)
                now[4].update(text.encode("utf-8", "surrogatepass"))
            now[5] += len(row["formatted"])
        if len(out) >= ROWS_OUT:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if now:
        out.append(closed())
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def read_back(windows: DataFrame) -> DataFrame:
    """A row per conversation from what `chat_windows` returned, read from the formatted texts and loss
    spans alone. The windows must be in its order, as they come (or sorted by conv, window within
    partitions that hold a conversation whole)."""
    kind = windows.schema["conv"].dataType.simpleString()
    return windows.select("conv", "formatted", "loss", "repeated").mapInArrow(
        _digested, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                   "loss_sha256 string, formatted_chars long")
