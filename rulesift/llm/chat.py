"""Chat formatting: spans of turns found by rendering successive turn prefixes.

A template is a black box that renders a list of turns.  For each turn the
outputs with and without it are compared: what the longer one adds is the turn's
span; if it does not begin with the shorter one, the template rewrote history
(``kept`` tells how much stayed).  Where a turn's own text lies inside its span
is found by rendering a probe in its place.

Whole prefixes are rendered, which grows with the square of a conversation's turns.  A
template that says on how many earlier turns a turn's rendering depends (``memory``)
is rendered over whole prefixes for a conversation's first ``WHOLE`` turns and over such windows after them.
Within the first ones each turn is rendered both ways, and a template whose windows
do not give what its prefixes give raises: its ``memory`` is wrong.

Rows are shuffled by conversation, sorted by turn and streamed: a task holds one
batch and the window, whatever the length of a conversation.

Defined cases: null texts and roles are empty; rows of one turn number are turns
in the order of role and text, repeated rows too; null conversation ids are one
conversation; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Turn = tuple[str, str]
#: Stands for a turn's text when its place is looked for; private-use characters.
PROBE = "\ue000\ue001"
#: Turns of a conversation that are rendered as whole prefixes whatever a template says.
WHOLE = 32


@dataclass(frozen=True)
class Template:
    """``render`` turns to text; ``unescape`` gives a text back; ``memory``: earlier turns that matter (None: all)."""

    render: Callable[[list[Turn]], str]
    unescape: Callable[[str], str] = lambda text: text
    memory: int | None = None
    loss_roles: tuple[str, ...] = ("assistant",)


#: Strings that formats use as control marks (or that these begin with); inside texts they are escaped.
CONTROL = ("<|im_", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: str) -> str:
    """Doubles backslashes and breaks control strings by one; ``unescape`` undoes it."""
    text = text.replace("\\", "\\\\")
    for mark in CONTROL:
        text = text.replace(mark, mark[0] + "\\" + mark[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def marked(turns: list[Turn]) -> str:
    """Each turn between marks, after its role; control strings inside are escaped."""
    header = lambda role: escape(role).replace("\n", "\\n")
    return "".join(f"<|im_start|>{header(role)}\n{escape(text)}<|im_end|>\n" for role, text in turns)


MARKED = Template(marked, unescape, memory=1)


def read_marked(piece: str) -> Turn:
    """Role and text of one rendered turn of ``MARKED``."""
    found = re.fullmatch(r"<\|im_start\|>([^\n]*)\n(.*)<\|im_end\|>\n", piece, re.DOTALL)
    if not found or "<|im_" in found[2]:
        raise ValueError("not one rendered turn")
    role = re.sub(r"\\([\\n]?)", lambda m: "\n" if m[1] == "n" else m[1], found[1])
    return role, unescape(found[2])


class Renderer:
    """Adds turns of one conversation; each gives (piece, kept, text start, text end) relative to the piece."""

    def __init__(self, template: Template):
        self.template, self.turns, self.size = template, [], 0
        self.before: str | None = ""  # the output so far, while whole prefixes are rendered

    def add(self, role: str, text: str) -> tuple[str, int, int | None, int | None]:
        template, turn = self.template, (role, text)
        window = self.turns if template.memory is None else self.turns[len(self.turns) - min(len(self.turns), max(1, template.memory)):]
        if self.before is not None:
            piece, lost, probed, after = self._difference(self.turns, turn, self.before)
            if template.memory is not None and (piece, lost) != self._difference(window, turn)[:2]:
                raise ValueError(f"a turn's rendering depends on more than {template.memory} earlier turns")
            self.before = after
        else:
            piece, lost, probed, _ = self._difference(window, turn)
        start = end = None
        if probed is not None:
            head, found, tail = probed.partition(PROBE)
            if found and PROBE not in tail and piece.startswith(head) and piece.endswith(tail) and len(piece) >= len(head) + len(tail):
                start, end = len(head), len(piece) - len(tail)
        kept = self.size - lost
        self.size = kept + len(piece)
        self.turns.append(turn)
        if template.memory is not None and len(self.turns) >= WHOLE:
            self.before = None
            del self.turns[:len(self.turns) - max(1, template.memory)]
        return piece, kept, start, end

    def _difference(self, turns: list[Turn], turn: Turn, before: str | None = None) -> tuple[str, int, str | None, str]:
        """What the turn adds, how much of the output before it goes, the same with a probe as its text
        (None: no loss on it), and the output after it."""
        render = self.template.render
        if before is None:
            before = render(turns) if turns else ""
        after = render([*turns, turn])
        same = len(before) if after.startswith(before) else len(commonprefix([before, after]))
        probed = render([*turns, (turn[0], PROBE)])[same:] if turn[0] in self.template.loss_roles else None
        return after[same:], len(before) - same, probed, after


def spans(conversations: DataFrame, template: Template = MARKED, conv_col: str = "conv_id", turn_col: str = "turn",
          role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn, in order within each conversation and partition.

    ``position`` counts turns; ``piece`` is what the turn adds at ``start`` (to ``end``)
    after the first ``kept`` = ``start`` characters; ``rewrites`` marks a turn that changed
    earlier output; ``loss_start``/``loss_end`` enclose the text under the loss mask.
    """
    conv_type = conversations.schema[conv_col].dataType
    schema = T.StructType([T.StructField(conv_col, conv_type), *(T.StructField(n, t) for n, t in (
        ("position", T.LongType()), ("role", T.StringType()), ("piece", T.StringType()), ("start", T.LongType()), ("end", T.LongType()),
        ("rewrites", T.BooleanType()), ("loss_start", T.LongType()), ("loss_end", T.LongType())))])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, current, renderer, position = False, None, None, 0
        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if not open_ or conv != current:
                    open_, current, renderer, position = True, conv, Renderer(template), 0
                size = renderer.size
                piece, kept, start, end = renderer.add(role, text)
                rows.append((conv, position, role, piece, kept, kept + len(piece), kept < size,
                             None if start is None else kept + start, None if end is None else kept + end))
                position += 1
            if rows:
                kinds = [batch.column(0).type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.fieldNames())

    turns = conversations.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turns = turns.repartition(n, "conv").sortWithinPartitions("conv", "turn", "role", "text")
    return turns.select("conv", "role", "text").mapInArrow(render, schema)


def digests(rendered: DataFrame, template: Template = MARKED, read: Callable[[str], Turn] = read_marked, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, read back from the pieces of ``spans`` (in its order): turns, digests, characters."""
    schema = T.StructType([rendered.schema[conv_col], *(T.StructField(n, t) for n, t in (
        ("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()),
        ("formatted_chars", T.LongType()), ("rewrites", T.LongType())))])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names, state, rows = schema.fieldNames(), None, []

        def close():
            conv, turns, all_, chars, loss, end, rewrites = state
            rows.append((conv, turns, all_.hexdigest(), chars, loss.hexdigest(), end, rewrites))

        def flush(kind):
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return out

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for conv, position, piece, start, end, rewrites, loss_start, loss_end in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if position == 0:
                    if state:
                        close()
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, text = read(piece)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if loss_start is not None:
                    under = template.unescape(piece[loss_start - start:loss_end - start])
                    state[3] += len(under)
                    state[4].update(under.encode("utf-8", "surrogatepass"))
                state[5] = end
                state[6] += rewrites
            if rows:
                yield flush(kind)
        if state:
            close()
            yield flush(kind)

    return rendered.select(conv_col, "position", "piece", "start", "end", "rewrites", "loss_start", "loss_end").mapInArrow(digest, schema)
