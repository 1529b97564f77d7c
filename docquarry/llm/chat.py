"""Chat formatting by prefix-target expansion: one example for each assistant turn, all turns before it as context.

Template, one line-framed block a turn::

    ### role:\\n<escaped text>\\n</turn>\\n

Control strings inside roles and texts are escaped with a backslash before their first character, and a backslash is doubled, so
that no text can open or close a turn; ``unescape`` undoes it. An example's loss span covers the escaped reply only. Conversations
that don't end in an assistant turn get a last example with the whole conversation and no trainable text, so nothing is lost.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from docquarry.session import ship_package

OPEN, CLOSE = "### ", "</turn>"
_HEAD = re.compile(r"### ([^\n:]*):\n")


def escape(text: str) -> str:
    r"""Doubles backslashes and puts one before what could read as a marker: ``###`` and ``</turn>`` in any place."""
    return re.sub(r"\\|#(?=##)|<(?=/turn>)", r"\\\g<0>", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _role(role: str) -> str:
    return re.sub(r"[:\n]", lambda m: {":": r"\c", "\n": r"\n"}[m[0]], role.replace("\\", r"\\").replace("#", r"\h"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"c": ":", "n": "\n", "h": "#"}.get(m[1], m[1]), role)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(block, start and end of the escaped text inside it)."""
    head = f"{OPEN}{_role(role)}:\n"
    body = escape(text)
    return f"{head}{body}\n{CLOSE}\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end of the escaped text) of each turn: the inverse of rendering."""
    out, at = [], 0
    while at < len(formatted):
        m = _HEAD.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        end = formatted.index(f"\n{CLOSE}\n", m.end())  # inside texts, the marker has a backslash before it
        out.append((_unrole(m[1]), unescape(formatted[m.end() : end]), m.end(), end))
        at = end + len(CLOSE) + 2
    return out


def expand(turns: list[tuple[str, str]], target: str = "assistant") -> Iterator[tuple[int, str, int, int]]:
    """(index of the last turn, formatted text, loss start, loss end) of each example, in order."""
    context: list[str] = []
    size = 0
    for i, (role, text) in enumerate(turns):
        block, a, b = render(role, text)
        context.append(block)
        if role == target:
            yield i, "".join(context), size + a, size + b
        elif i == len(turns) - 1:
            yield i, "".join(context), 0, 0
        size += len(block)


def conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turns): one row a conversation, turns in order. A conversation is the unit of work; its rows meet in one task."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return turns.groupBy(F.col(conv).alias("conv")).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target: str = "assistant") -> DataFrame:
    """(conv, example, last_turn, formatted, loss_start, loss_end): prefix-target expansion of every conversation.

    Offsets are code points. Null text or role: empty. Ties in turn go by role, then text; repeated rows are turns of their own. A
    null conversation id is one conversation. Empty table: no rows. Other columns are not read. Output is made an example at a
    time, in batches of about 8 MB, since a long conversation's prefixes add up to the square of its length."""
    ship_package(turns.sparkSession)
    kind = turns.schema[conv].dataType.simpleString()

    key = to_arrow_type(turns.schema[conv].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, held = [], 0
            for i, ts in enumerate(b.column(1)):
                for k, (last, formatted, x, y) in enumerate(expand(_turns(ts), target)):
                    rows.append((i, k, last, formatted, x, y))
                    held += len(formatted)
                    if held > 8_000_000:
                        yield made(b, rows)
                        rows, held = [], 0
            if rows:
                yield made(b, rows)

    def made(b: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        at, *cols = zip(*rows)
        ints = pa.int32()
        return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)).cast(key), *(pa.array(c, t) for c, t in zip(cols, (ints, ints, pa.string(), ints, ints)))], _COLS)

    schema = f"conv {kind}, example int, last_turn int, formatted string, loss_start int, loss_end int"
    return conversations(turns, conv, turn, role, text).mapInArrow(run, schema).withColumnRenamed("conv", conv)


_COLS = ["conv", "example", "last_turn", "formatted", "loss_start", "loss_end"]


def _turns(ts: pa.ListScalar) -> list[tuple[str, str]]:
    return [(t["role"], t["text"]) for t in ts.as_py()]


def read_back(rows: Iterator[tuple[int, str, int, int]]) -> dict:
    """A conversation's digest from its formatted examples, given in order: turns from the last, trainable text from every one."""
    turns, loss, n_loss, chars, last = [], hashlib.sha256(), 0, 0, ""
    for _, formatted, a, b in rows:
        reply = unescape(formatted[a:b])
        loss.update(reply.encode("utf-8", "surrogatepass"))
        n_loss += len(reply)
        chars += len(formatted)
        last = formatted
    turns = parse(last)
    whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _, _ in turns).encode("utf-8", "surrogatepass"))
    return {"n_turns": len(turns), "turns_sha256": whole.hexdigest(), "loss_chars": n_loss, "loss_sha256": loss.hexdigest(), "formatted_chars": chars}


def digest(turns: DataFrame, conv: str = "conv_id", **columns: str) -> DataFrame:
    """``read_back`` of every conversation. Examples are made and read where the conversation is, one after the other, so the
    quadratic text is never held or moved as a whole."""
    ship_package(turns.sparkSession)
    kind = turns.schema[conv].dataType.simpleString()

    key = to_arrow_type(turns.schema[conv].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.RecordBatch.from_pylist([read_back(expand(_turns(ts))) for ts in b.column(1)], _DIGEST)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(key), *out.columns], ["conv", *_DIGEST.names])

    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return conversations(turns, conv, **columns).mapInArrow(run, schema).withColumnRenamed("conv", conv)


_DIGEST = pa.schema([("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
