"""Chat formatting: a state machine over roles and a declarative template.

A template gives each role the strings that open and close its turn and says whether the
turn's text counts for the loss, and lists which role may follow which.  Every turn becomes
three segments, opening, text and closing, of which only texts of loss roles carry the loss
flag.  Inside texts, every character that can begin a control string is followed by a
backslash, as is the backslash itself, so no control string can be formed by a text and
``unescape`` gives the text back.

The machine's state is the role read last.  A turn whose role may not follow the state is
flagged (``in_order`` false) and formatted all the same, and the machine goes on from it, so
no conversation is dropped; ``wanted`` tells what the template allows.

Plan: escaping is row-local SQL; one shuffle by conversation with a sort inside partitions;
the machine and the read-back stream over the sorted rows in Arrow batches and keep a single
turn and two hash states in memory, however long a conversation is.  The digests are SHA-256
over a whole conversation, which can only be computed in order, so one conversation stays in
one task.

Defined results: NULL text and NULL role count as empty strings; a role that the template
lacks gets the ``other`` markup, which carries its (escaped) name; turns order by (turn, role,
text), NULL turns first, repeated rows all kept; rows with a NULL conv_id form one
conversation; other columns are ignored.  An empty table gives no segments.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankline.llm.common import table
from rankline.llm.registry import register

START = "start"


@dataclass(frozen=True)
class Markup:
    opening: str
    closing: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """``roles``: markup by role; ``other``: markup of unknown roles, {role} is the escaped name;
    ``follows``: the roles that may come after a state; ``special``: characters that begin a
    control string."""
    roles: dict[str, Markup]
    other: Markup
    follows: dict[str, tuple[str, ...]]
    special: str = "<["
    accept: tuple[str, ...] = field(default=("assistant",))


INSTRUCT = Template(
    roles={"system": Markup("<<SYS>>\n", "\n<</SYS>>\n\n"),
           "user": Markup("[INST] ", " [/INST]"),
           "assistant": Markup("<s>", "</s>\n", loss=True)},
    other=Markup("[ROLE]{role}[/ROLE]", "[/TURN]\n"),
    follows={START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)


def _class(template: Template) -> str:
    return "[" + "".join("\\" + c for c in "\\" + template.special) + "]"


def escape(text: Column, template: Template = INSTRUCT) -> Column:
    return F.regexp_replace(text, F.lit(f"({_class(template)})"), F.lit(r"$1\\"))


def unescape(text: str, template: Template = INSTRUCT) -> str:
    import re
    return re.sub(f"({_class(template)})\\\\", r"\1", text)


SEGMENTS = ("conv_id long, position long, part int, segment string, loss boolean, role string, "
            "in_order boolean, wanted string")


def format_turns(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Segments of every conversation, three per turn, in order inside each partition.

    ``position`` numbers the turns of a conversation; ``part`` is 0 opening, 1 text, 2 closing.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                     F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("escaped", escape(F.col("text"), template)).withColumn("name", escape(F.col("role"), template))
    t = t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("text", "turn")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        conv, state, position = object(), START, 0
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("conv_id", "position", "part", "segment", "loss", "role", "in_order", "wanted")}
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    conv, state, position = row["conv_id"], START, 0
                role = row["role"]
                allowed = template.follows.get(state, ())
                mark = template.roles.get(role)
                known = mark is not None
                if not known:
                    mark = Markup(template.other.opening.format(role=row["name"]), template.other.closing)
                for part, seg in enumerate((mark.opening, row["escaped"], mark.closing)):
                    for k, v in zip(out, (conv, position, part, seg, mark.loss and part == 1, role,
                                          role in allowed, "|".join(allowed))):
                        out[k].append(v)
                state, position = role, position + 1
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
                [("conv_id", pa.int64()), ("position", pa.int64()), ("part", pa.int32()), ("segment", pa.string()),
                 ("loss", pa.bool_()), ("role", pa.string()), ("in_order", pa.bool_()), ("wanted", pa.string())]))

    return t.select("conv_id", "role", "escaped", "name").mapInArrow(run, SEGMENTS)


class Reader:
    """Turns of one conversation, read from its joined output, which comes piece by piece.

    The output is cut at every control string of the template.  An opening begins a turn, and ends
    one that is still open; a closing ends a turn.  Text or a control string where the template has
    none is a turn without a role, so output that is not well formed reads back as other turns.
    Keeps the current turn and as many characters as a control string has.
    """

    def __init__(self, template: Template = INSTRUCT):
        import re
        self.template = template
        self.head, self.tail = template.other.opening.split("{role}")
        self.opens = {m.opening: role for role, m in template.roles.items()}
        self.closes = {m.closing for m in template.roles.values()} | {template.other.closing}
        marks = sorted({*self.opens, *self.closes, self.head, self.tail}, key=lambda x: (-len(x), x))
        self.mark, self.longest = re.compile("|".join(map(re.escape, marks))), len(marks[0])
        self.rest, self.text = "", []
        self.role, self.open, self.named = "", False, True  # named: false inside the opening of an unknown role

    def _end(self, always: bool) -> Iterator[tuple[str, str]]:
        text, self.text = unescape("".join(self.text), self.template), []
        if always or text:
            yield self.role, text
        self.role, self.open, self.named = "", False, True

    def read(self, piece: str, last: bool = False) -> Iterator[tuple[str, str]]:
        """(role, text) of the turns that end in ``piece``; ``last``: the output ends here."""
        rest, at = self.rest + piece, 0
        # a control string that begins here or later may go on in the next piece
        sure = len(rest) if last else max(0, len(rest) - self.longest + 1)
        for m in self.mark.finditer(rest):
            if m.start() >= sure:
                break
            self.text.append(rest[at:m.start()])
            at, mark = m.end(), m.group()
            if mark in self.opens or mark == self.head:
                yield from self._end(self.open)
                self.role, self.open, self.named = self.opens.get(mark, ""), True, mark in self.opens
            elif mark == self.tail and not self.named:
                self.role, self.text, self.named = unescape("".join(self.text), self.template), [], True
            else:
                yield from self._end(True)
        sure = max(at, sure)
        self.text.append(rest[at:sure])
        self.rest = rest[sure:]
        if last:
            yield from self._end(self.open)


def read_back(segments: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per conversation, read from the formatted strings and the loss mask alone.

    Roles and texts are parsed out of each conversation's joined output by the template's control
    strings; the columns part and in_order of the segments are used for the order report only.
    Expects the partitioning and order of ``format_turns``.
    """
    schema = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
              "formatted_chars long, n_out_of_order long, complete boolean")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        names = [c.split()[0] for c in schema.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
        conv, open_, n, turns, loss, reader = None, False, 0, sha256(), sha256(), Reader(template)
        loss_chars = chars = bad = 0
        role = ""

        def read(piece: str, last: bool = False) -> None:
            nonlocal n, role
            for role, text in reader.read(piece, last):
                turns.update(f"{role}\n{text}\n".encode())
                n += 1

        def done() -> tuple:
            read("", True)
            return (conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, bad, role in template.accept)

        for batch in batches:
            rows = []
            for s in batch.to_pylist():
                if not open_ or s["conv_id"] != conv:
                    if open_:
                        rows.append(done())
                    conv, open_, n, turns, loss, reader = s["conv_id"], True, 0, sha256(), sha256(), Reader(template)
                    loss_chars = chars = bad = 0
                    role = ""
                read(s["segment"])
                chars += len(s["segment"])
                if s["loss"]:
                    text = unescape(s["segment"], template)
                    loss.update(text.encode())
                    loss_chars += len(text)
                bad += s["part"] == 2 and not s["in_order"]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names)
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(done(), types)], names)

    return segments.mapInArrow(run, schema)


def _special(expr: str) -> str:
    return f"(length({expr}) - length(replace(replace(replace({expr}, '\\', ''), '<', ''), '[', '')))"


SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM t),
m AS (SELECT *, CASE role WHEN 'system' THEN 8 + 11 WHEN 'user' THEN 7 + 8 WHEN 'assistant' THEN 3 + 5
                     ELSE 6 + 7 + 8 + length(role) + {_special('role')} END AS markup,
             NOT coalesce(CASE coalesce(prev, 'start') WHEN 'start' THEN role IN ('system', 'user')
                          WHEN 'system' THEN role = 'user' WHEN 'user' THEN role = 'assistant'
                          WHEN 'assistant' THEN role = 'user' END, false) AS bad FROM p)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(markup + length(text) + {_special('text')}) AS BIGINT) AS formatted_chars,
       CAST(count(*) FILTER (bad) AS BIGINT) AS n_out_of_order,
       bool_or(from_end = 1 AND role = 'assistant') AS complete
FROM m GROUP BY conv_id
"""


@register("op1_chat_format", SQL)
def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], turns.schema)
    return read_back(format_turns(turns.unionByName(extra)))
