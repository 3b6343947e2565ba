"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation (white space is significant):

    conversation := turn*
    turn         := open body close
    open         := "<s>[" NAME "!"? "]\\n"     "!" marks a body with escapes; NAME is the role, percent-encoded
    close        := "</s>\\n"
    body         := any text without a control string

Control strings are "<s>[", "</s>", "[INST]", "[/INST]", "<<SYS>>" and "<</SYS>>"; the parser treats each as structure wherever it stands, so a
body that holds one does not parse back. A conversation is first rendered as it is, parsed, and compared turn by turn with its source; the
turns that do not come back are rendered with escapes, and so on until the parsed turns equal the source. In an escaped body
every backslash is doubled, and a backslash is put behind the first character of every control string, which undoes uniquely.

Defined cases: null text and null role count as empty; turns are ordered by (turn, role, text), nulls first; a null conv_id is one conversation; repeated rows are
turns of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ("<s>[", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_OPEN = re.compile(r"<s>\[([^\]\n!]*)(!?)\]\n")
_CLOSE = "</s>\n"


class GrammarError(ValueError):
    pass


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def render_turn(role: str, text: str, escaped: bool) -> str:
    return f"<s>[{quote(role, safe='')}{'!' if escaped else ''}]\n{escape(text) if escaped else text}{_CLOSE}"


def parse(formatted: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start and end of the body) of each turn; raises GrammarError where the grammar does not hold."""
    at = 0
    while at < len(formatted):
        head = _OPEN.match(formatted, at)
        if not head:
            raise GrammarError(f"no turn opens at {at}")
        control = _CONTROL.search(formatted, head.end())
        if not control or not formatted.startswith(_CLOSE, control.start()):
            raise GrammarError(f"the turn at {at} is not closed before the next control string")
        body = formatted[head.end() : control.start()]
        yield unquote(head[1]), unescape(body) if head[2] else body, head.end(), control.start()
        at = control.start() + len(_CLOSE)


def comes_back(role: str, text: str, rendered: str) -> bool:
    try:
        return [(r, t) for r, t, *_ in parse(rendered)] == [(role, text)]
    except GrammarError:
        return False


def format_conversation(turns: Iterable[tuple[str, str]]) -> str:
    """Render, parse and escape until the parsed turns equal the source."""
    turns = list(turns)
    escaped = [False] * len(turns)
    while True:
        rendered = [render_turn(r, t, e) for (r, t), e in zip(turns, escaped, strict=True)]
        formatted = "".join(rendered)
        try:
            if [(r, t) for r, t, *_ in parse(formatted)] == turns:
                return formatted
        except GrammarError:
            pass
        conflicts = [not e and not comes_back(r, t, x) for (r, t), e, x in zip(turns, escaped, rendered, strict=True)]
        if not any(conflicts):
            raise GrammarError("an escaped turn does not come back")
        escaped = [e or c for e, c in zip(escaped, conflicts, strict=True)]


def loss_spans(formatted: str, role: str = "assistant") -> list[tuple[int, int]]:
    """Where the bodies of the role's turns stand in the formatted text."""
    return [(a, b) for r, _, a, b in parse(formatted) if r == role]


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (spans of the assistant's bodies), and what is read back from the formatted text."""
    schema = "conv_id long, formatted string, loss array<struct<start:int,end:int>>, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def one(conv_id, rows: list[tuple[str, str]]) -> tuple:
        formatted = format_conversation(rows)
        turns_, loss, n, chars, spans = hashlib.sha256(), hashlib.sha256(), 0, 0, []
        for role, text, start, end in parse(formatted):
            n += 1
            turns_.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                spans.append((start, end))
                loss.update(text.encode())
                chars += len(text)
        return conv_id, formatted, spans, n, turns_.hexdigest(), chars, loss.hexdigest(), len(formatted)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["conv_id", "formatted", "loss", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, rows, out = (), [], []
        for f in frames:
            for conv_id, none, role, text in zip(f["conv_id"], f["none"], f["role"], f["text"], strict=True):
                if (key := (none, conv_id)) != now:
                    if rows:
                        out.append(one(None if now[0] else now[1], rows))
                    now, rows = key, []
                rows.append((role, text))
            if out:
                yield pd.DataFrame(out, columns=columns)
                out = []
        if rows:
            yield pd.DataFrame([one(None if now[0] else now[1], rows)], columns=columns)

    keyed = turns.select(
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("none"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    return keyed.repartition("none", "conv_id").sortWithinPartitions("none", "conv_id", "turn", "role", "text").drop("turn").mapInPandas(run, schema)
