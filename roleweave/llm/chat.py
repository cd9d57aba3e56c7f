"""Chat formatting: a finite-state machine over roles, and segments with loss flags from a template.

A template declares how a turn is written (a header for its role, its text, an end mark),
which roles are under the loss, and the machine: which role may follow in which state and
where a conversation may end.  Control strings inside texts are escaped, so that the
formatted text can be read back whatever the texts hold.

Order within a conversation is by turn (null first), then role, then text.  Rows are dealt
by ranges of that order, so a conversation of any length is spread over many tasks.  A
task does not know the state its first rows start in; it gives the machine's end state for
every start state instead, one small row a task, and the start states follow from those.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roleweave.llm.common import ready, saved

#: State after a role that does not fit; no role leads out of it.
BROKEN = "broken"


@dataclass(frozen=True)
class Template:
    """How conversations are written; all of it is data.

    A role without a label is written as ``other`` and its own name.  ``order`` holds
    (state, role, next state); what it does not hold leads to ``broken``.
    """

    opening: str = "### "
    labels: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"), ("tool", "Tool"))
    other: str = "="
    colon: str = ": "
    end: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    order: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "system"),
        ("start", "user", "user"),
        ("system", "user", "user"),
        ("user", "assistant", "assistant"),
        ("assistant", "user", "user"),
        ("assistant", "tool", "tool"),
        ("tool", "tool", "tool"),
        ("tool", "assistant", "assistant"),
    )
    final: tuple[str, ...] = ("assistant",)

    def states(self) -> list[str]:
        return [self.start, *sorted({s for a, _, b in self.order for s in (a, b)} - {self.start, BROKEN}), BROKEN]


#: Three ``#`` open a header, ``</turn>`` ends a turn: no text keeps either as it is.
CHAT = Template()


def escaped(text: Column) -> Column:
    """Reversible: backslashes are doubled, then a backslash parts each ``###`` and ``</turn>``."""
    out = F.regexp_replace(text, r"\\", r"\\\\")
    out = F.regexp_replace(out, "#(?=##)", r"#\\")
    return F.regexp_replace(out, "<(?=/turn>)", r"<\\")


def unescaped(text: str) -> str:
    """What :func:`escaped` was given."""
    return re.sub(r"(?s)\\(.)", r"\1", text) if "\\" in text else text


def _role_written(role: Column, template: Template) -> Column:
    name = F.concat(F.lit(template.other), F.regexp_replace(escaped(role), ":", r"\\:"))
    for known, label in template.labels:
        name = F.when(role == F.lit(known), F.lit(label)).otherwise(name)
    return name


def read_back(formatted: str, template: Template = CHAT) -> list[tuple[str, str]]:
    """``(role, text)`` of each turn of a formatted text; ValueError if it is none."""
    names = {label: role for role, label in template.labels}
    header = re.compile(
        re.escape(template.opening) + "(?:(" + "|".join(map(re.escape, names)) + ")|" + re.escape(template.other) + r"((?:[^\\:]|\\.)*))" + re.escape(template.colon),
        re.DOTALL,
    )
    turns, at = [], 0
    while at < len(formatted):
        found = header.match(formatted, at)
        end = formatted.find(template.end, found.end()) if found else -1
        if end < 0:
            raise ValueError(f"no turn at character {at}")
        role = names[found[1]] if found[1] is not None else unescaped(found[2])
        turns.append((role, unescaped(formatted[found.end() : end])))
        at = end + len(template.end)
    return turns


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())


def _machine(template: Template) -> tuple[list[str], dict]:
    states = template.states()
    number = {s: i for i, s in enumerate(states)}
    return states, {(number[a], role): number[b] for a, role, b in template.order}


def _edges(template: Template, batches: Iterator[pa.RecordBatch], part: int) -> Iterator[dict]:
    """The one small row of a task: its first and last conversation, and where the machine ends."""
    states, step = _machine(template)
    broken, first, last, ends, state, any_row = len(states) - 1, None, None, list(range(len(states))), 0, False
    in_first = True
    for conv, role in _rows(batches):
        if not any_row:
            first = last = conv
            any_row = True
        elif conv != last:
            in_first, last, state = False, conv, 0
        if in_first:
            ends = [step.get((s, role), broken) for s in ends]
        else:
            state = step.get((state, role), broken)
    if any_row:
        yield {"part": part, "one": in_first, "first": first, "last": last, "ends": ends, "state": state}


def _start_states(edges: list, start: int = 0) -> dict[int, int]:
    """Each task's start state: the tasks' functions from state to state, composed in order."""
    starts, conv, state = {}, None, None
    for e in sorted(edges, key=lambda e: e["part"]):
        starts[e["part"]] = state if state is not None and e["first"] == conv else start
        conv, state = e["last"], e["ends"][starts[e["part"]]] if e["one"] else e["state"]
    return starts


def format_turns(conversations: DataFrame, template: Template = CHAT) -> DataFrame:
    """Per row of ``conversations``: ``conv_id, seq, turn, role, state, segments, formatted``.

    ``segments`` (``kind``: header, text or end; ``text``; ``loss``) joined are ``formatted``;
    a conversation's ``formatted``, ordered by ``seq``, joined are its formatted text.
    ``state`` is the machine's state after the turn, ``broken`` from the first turn on that
    does not fit; a conversation is valid if the state after its last turn is one of
    ``template.final``.  Invalid ones are formatted like any other.

    Null text and null role read as empty; a null role or an empty or unknown one fits in
    no state.  Rows of null ``conv_id`` are one conversation.  Repeated turns keep all
    their rows, ordered by role and text.  Columns besides the four are not read.  An empty
    table gives an empty result.

    The ordered rows are kept in the shared checkpoint folder, so a lost executor's share is
    formatted again from there; the driver receives one row a task.
    """
    ready(conversations.sparkSession)
    rows = conversations.select(
        conversations["conv_id"].alias("conv_id"), conversations["turn"].alias("turn"),
        F.coalesce(conversations["role"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(conversations["text"].cast("string"), F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    rows = saved(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def edges(batches):
        from pyspark import TaskContext

        got = list(_edges(template, batches, TaskContext.get().partitionId()))
        yield pa.RecordBatch.from_pylist(got, schema=edge_schema)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(rows.schema["conv_id"].dataType)
    edge_schema = pa.schema([("part", pa.int32()), ("one", pa.bool_()), ("first", kind), ("last", kind), ("ends", pa.list_(pa.int32())), ("state", pa.int32())])
    found = rows.select("conv_id", "role").mapInArrow(edges, f"part int, one boolean, first {id_type}, last {id_type}, ends array<int>, state int")
    starts = _start_states(found.collect())  # one row a task

    def states(batches):
        from pyspark import TaskContext

        names, step = _machine(template)
        state, last, begun = starts.get(TaskContext.get().partitionId(), 0), None, False
        for batch in batches:
            out = []
            for conv, role in _rows([batch]):
                if begun and conv != last:
                    state = 0
                begun, last = True, conv
                state = step.get((state, role), len(names) - 1)
                out.append(names[state])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], [*batch.schema.names, "state"])

    turn_type = rows.schema["turn"].dataType.simpleString()
    walked = rows.select("conv_id", "role", "turn", "text", F.monotonically_increasing_id().alias("seq")).mapInArrow(
        states, f"conv_id {id_type}, role string, turn {turn_type}, text string, seq long, state string"
    )
    header = F.concat(F.lit(template.opening), _role_written(F.col("role"), template), F.lit(template.colon))
    segment = lambda kind, text, loss: F.struct(F.lit(kind).alias("kind"), text.alias("text"), loss.alias("loss"))
    out = walked.withColumn("segments", F.array(
        segment("header", header, F.lit(False)),
        segment("text", escaped(F.col("text")), F.col("role").isin(*template.loss_roles)),
        segment("end", F.lit(template.end), F.lit(False)),
    ))
    return out.select("conv_id", "seq", "turn", "role", "state", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _digests(template: Template, kind: pa.DataType, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", kind), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                        ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])
    here, begun, out = None, False, []
    n = chars = long = 0
    turns = loss = state = None
    done = lambda: (here, n, turns.hexdigest(), chars, loss.hexdigest(), long, state in template.final)
    for batch in batches:
        for conv, formatted, after, segments in zip(*(c.to_pylist() for c in batch.columns)):
            if not begun or conv != here:
                if begun:
                    out.append(done())
                begun, here, n, chars, long, turns, loss = True, conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for role, text in read_back(formatted, template):
                n += 1
                turns.update(f"{role}\n{text}\n".encode())
            for s in segments:
                if s["loss"]:
                    text = unescaped(s["text"])
                    chars += len(text)
                    loss.update(text.encode())
            long += len(formatted)
            state = after
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if begun:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(done()), schema)], schema=schema)


def digests(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Per conversation of :func:`format_turns`, read back from its formatted turns and segments.

    A digest of a whole conversation is one sequential hash, so its rows pass one task in
    order; they pass as a sorted stream of which only the hash states are kept.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = formatted.schema["conv_id"].dataType
    arrow_kind = to_arrow_type(kind)
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq").select("conv_id", "formatted", "state", "segments")
    return rows.mapInArrow(lambda b: _digests(template, arrow_kind, b), f"conv_id {kind.simpleString()}, {_DIGEST}")
