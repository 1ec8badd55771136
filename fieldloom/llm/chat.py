r"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Each conversation is rendered
turn prefix by turn prefix. What one more turn appends is that turn's span; a template whose output no longer
starts with the previous output rewrites history and is rejected. Rendering the last turn once more with a probe
character in place of its text gives the place of the text inside the span, and so the loss mask.

Rows of a conversation stream through one task in turn order. Prefixes are whole by default, as a template may number
turns or look back to the first one; the time then grows with the square of a conversation. A template declared
``turn_local`` renders each turn alone, so its prefixes start at most ``HORIZON`` turns back, and neither memory nor
time grows that way. The production template is.

The production template marks turns with ``<s>``, ``[INST]`` and the like, and puts a backslash before every ``<``,
``[`` and backslash of a text, so no text holds a control string and every text can be read back.

Defined cases: a missing text or role is empty; rows sort by turn, then role, then text, missing values first;
repeated rows are turns of their own; rows without conv_id form one conversation; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .tables import lean, ship

HORIZON = 64
PROBE = "\ue000"
TRAINED_ROLE = "assistant"

Turn = tuple[str, str]

_CONTROL = re.compile(r"[<\[\\]")
_ESCAPED = re.compile(r"\\(.)", re.S)


class RewritesHistory(ValueError):
    """The template changed output that it had given for an earlier prefix."""


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def escape_role(role: str) -> str:
    """A role inside its mark, which ends at the first plain bracket."""
    return escape(role).replace("]", "\\]")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def turn_local(template: Callable[[list[Turn]], str]) -> Callable[[list[Turn]], str]:
    """Declare that what the template shows of a turn depends on no other turn, nor on its place."""
    template.turn_local = True
    return template


@turn_local
def inst_template(turns: list[Turn]) -> str:
    """The production template: one marked turn after the other, texts escaped."""
    out = ["<s>"]
    for role, text in turns:
        if role == "system":
            out.append(f"<<SYS>>\n{escape(text)}\n<</SYS>>\n")
        elif role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == TRAINED_ROLE:
            out.append(f" {escape(text)}</s>\n")
        else:
            out.append(f"[ROLE {escape_role(role)}] {escape(text)} [/ROLE]")
    return "".join(out)


def locate_turn(template: Callable[[list[Turn]], str], before: list[Turn], turn: Turn, shown: str) -> tuple[str, int, int]:
    """What ``turn`` appends to ``shown``, the rendering of ``before``, and the bounds of its text in there."""
    whole = template([*before, turn])
    if not whole.startswith(shown):
        raise RewritesHistory(f"turn {len(before)} changes earlier output")
    probe = template([*before, (turn[0], PROBE)])
    at = probe.rfind(PROBE)
    added = len(whole) - len(probe) + 1
    if at < len(shown) or added < 0 or not whole.startswith(probe[:at]) or whole[at + added:] != probe[at + 1:]:
        raise ValueError("the template does not show the text of a turn in one place")
    return whole[len(shown):], at - len(shown), at - len(shown) + added


def rewrites_history(template: Callable[[list[Turn]], str], turns: list[Turn]) -> list[int]:
    """The turns whose addition changes what was rendered before."""
    shown = [template(turns[:i]) for i in range(len(turns) + 1)]
    return [i for i in range(len(turns)) if not shown[i + 1].startswith(shown[i])]


SCHEMA = "conv_id bigint, seq bigint, formatted string, loss_start bigint, loss_end bigint"


def _format(template: Callable[[list[Turn]], str], local: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, before, seq, shown = object(), [], 0, ""
        for batch in batches:
            out = []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2)), strict=True):
                if c != conv:
                    conv, before, seq, shown = c, [], 0, template([])
                    lead = shown
                span, a, b = locate_turn(template, before, (role, text), shown)
                shown += span
                if seq == 0:  # what stands before the first turn belongs to it
                    span, a, b = lead + span, a + len(lead), b + len(lead)
                out.append((c, seq, span, a if role == TRAINED_ROLE else None, b if role == TRAINED_ROLE else None))
                before.append((role, text))
                seq += 1
                if local and len(before) > HORIZON:
                    before = before[-HORIZON // 2:]
                    shown = template(before)
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["conv_id", "seq", "formatted", "loss_start", "loss_end"])

    return run


def format_turns(conversations: DataFrame, template: Callable[[list[Turn]], str] = inst_template) -> DataFrame:
    """conv_id, seq, formatted, loss_start, loss_end: what each turn adds, conversations in turn order inside partitions.

    The formatted conversation is its rows joined; the loss bounds (code points in ``formatted``, end exclusive)
    hold the text of assistant turns and are missing elsewhere. Prefixes are whole unless the template is ``turn_local``.
    """
    ship(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("turn").cast("bigint").alias("turn"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(lean(_format(template, getattr(template, "turn_local", False))), SCHEMA)


_TURN = re.compile(r"<s>|<<SYS>>\n(?P<system>(?:[^<\[\\]|\\.)*)\n<</SYS>>\n|\[INST\] (?P<user>(?:[^<\[\\]|\\.)*) \[/INST\]"
                   r"|\[ROLE (?P<role>(?:[^<\[\\\]]|\\.)*)\] (?P<other>(?:[^<\[\\]|\\.)*) \[/ROLE\]| (?P<assistant>(?:[^<\[\\]|\\.)*)</s>\n", re.S)


def read_turns(formatted: str) -> Iterator[Turn]:
    """The turns in output of the production template."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        if m.lastgroup == "other":
            yield unescape(m["role"]), unescape(m["other"])
        elif m.lastgroup:
            yield m.lastgroup, unescape(m[m.lastgroup])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    state, done, due = None, [], 0

    def close():
        if state is not None:
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

    def batch_of():
        columns = list(zip(*done, strict=True)) or [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for conv, seq, text, a, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if seq == 0:
                close()
                state, due = [conv, 0, sha256(), 0, sha256(), 0], 0
            if state is None or state[0] != conv or seq != due:
                raise ValueError("formatted rows must stand in turn order: pass what format_turns gives, or sort conversations within partitions")
            due += 1
            for role, said in read_turns(text):
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
            if a is not None:
                learned = unescape(text[a:b])
                state[3] += len(learned)
                state[4].update(learned.encode())
            state[5] += len(text)
        if done:
            yield batch_of()
            done.clear()
    close()
    yield batch_of()


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation what its formatted rows hold: turns, text under the loss mask, and length.

    The rows must stand as ``format_turns`` gives them; rows out of order are an error.
    """
    return formatted.mapInArrow(lean(_read), "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
