"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns.

A transcript is plain text. Its lines are the observations; the hidden states say which role speaks and whether
the line begins a turn. A line's features are its speaker marker (none, one of a role, or one that names nobody
known), whether the line before was blank, and whether it ends as a question. Viterbi decoding finds the likeliest
states, and each run of lines from one beginning to the next becomes a turn, rendered as
``<|role|>`` newline, text, newline ``<|end|>``. The model's probabilities are counts with add-one smoothing over
transcripts whose roles are known: half of the conversations, chosen by a hash, and at most MOST_TRAINING.

A long conversation is cut into segments of SEGMENT turns, so no task ever holds a whole hot conversation. Segments
overlap: each is decoded together with the CONTEXT turns before and after it, and keeps the turns that begin among its
own lines, so the state at its edges is that of the conversation. Repeated rows of one turn collapse before they meet
and are given back afterwards; a segment of more than MOST_ROWS different rows (many texts for one turn) is dealt by a hash.

Defined results: null text is an empty turn; a null role, or one of no known name, is unknown and is recovered as one of
ROLES; a row with a null conv_id or a null turn is a conversation of its own; rows that repeat a turn each get the
turn's result. Roles, boundaries and texts are the parser's: a turn whose beginning it misses is part of the one before, and a
line inside a text that looks like a marker opens a turn. Extra columns are ignored. recover() marks the conversations that
the model was fitted on (trained), so that the others tell how well it does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

ROLES = ("system", "user", "assistant", "tool")
SEGMENT, CONTEXT = 64, 8
#: So many different rows of a segment, at most, are decoded together.
MOST_ROWS = 256
MOST_TRAINING = 400
STEP = 10_000
#: Names that mark a speaker, by role.
NAMES = {
    "system": ("system", "instructions", "context"),
    "user": ("user", "human", "q", "question", "customer", "client", "prompter"),
    "assistant": ("assistant", "ai", "a", "answer", "bot", "agent", "model", "gpt"),
    "tool": ("tool", "function", "observation", "result"),
}
NO_TURN = {"turn": None, "role": None, "copies": 1}
ROLE_OF = {name: role for role, names in NAMES.items() for name in names}
MARKER = re.compile(r"^\s*(?:(?:#{1,4}|\*\*|[-–>])\s*)?(?:<\|(?:im_start\|>)?|\[|\()?\s*([A-Za-z]{1,14})\s*(?:\|>|\]|\))?\s*(?:\*\*)?\s*(:|-(?=\s)|(?<=[\]>)])|$)\s*(?:\*\*)?[ \t]*")
#: How the query's transcripts are written: what stands before a turn of each role.
STYLES = (
    {"system": "System: ", "user": "User: ", "assistant": "Assistant: ", "tool": "Tool: "},
    {"system": "[system] ", "user": "[human] ", "assistant": "[ai] ", "tool": "[tool] "},
    {"system": "### Instructions:\n", "user": "### User:\n", "assistant": "### Assistant:\n", "tool": "### Result:\n"},
    {"system": "Context: ", "user": "Q: ", "assistant": "A: ", "tool": "Observation: "},
    {"system": "**System:** ", "user": "**Human:** ", "assistant": "**Bot:** ", "tool": "**Tool:** "},
)

N_MARKS = len(ROLES) + 2
#: States: for each role a line that begins a turn, then a line that goes on.
N_STATES = 2 * len(ROLES)


def marker(line: str) -> tuple[int, int]:
    """Which role a line's marker names (0 none, 1.. a role, last an unknown name), and where the marker ends."""
    found = MARKER.match(line)
    if not found or not (found[2] or line.lstrip()[:1] in "#*<["):
        return 0, 0
    role = ROLE_OF.get(found[1].lower())
    if role is None:
        return (N_MARKS - 1 if found[2] == ":" else 0), 0
    return 1 + ROLES.index(role), found.end()


def observe(lines: list[str]) -> np.ndarray:
    """A feature number for each line."""
    out, blank = np.zeros(len(lines), np.int64), False
    for k, line in enumerate(lines):
        mark, _ = marker(line)
        out[k] = (mark * 2 + (blank or k == 0)) * 2 + line.rstrip().endswith("?")
        blank = not line.strip()
    return out


class RoleModel:
    """A hidden Markov model over line features, fitted by counting."""

    def __init__(self) -> None:
        self.begin = np.ones(N_STATES)
        self.move = np.ones((N_STATES, N_STATES)) * 0.1
        self.show = np.ones((N_STATES, N_MARKS * 4)) * 0.1

    def learn(self, lines: list[str], states: np.ndarray) -> None:
        if len(lines):
            seen = observe(lines)
            self.begin[states[0]] += 1
            np.add.at(self.move, (states[:-1], states[1:]), 1)
            np.add.at(self.show, (states, seen), 1)

    def decode(self, lines: list[str]) -> np.ndarray:
        """The likeliest states, by Viterbi. A turn's later lines keep its role, whatever was counted."""
        seen = observe(lines)
        begin, move, show = (np.log(x / x.sum(-1, keepdims=True)) for x in (self.begin, self.move, self.show))
        roles = len(ROLES)
        move[:, roles:] = np.where(np.arange(N_STATES)[:, None] % roles == np.arange(roles), move[:, roles:], -np.inf)
        begin[roles:] = -np.inf
        best = begin + show[:, seen[0]]
        came = np.zeros((len(lines), N_STATES), np.int64)
        for k in range(1, len(lines)):
            ways = best[:, None] + move
            came[k] = ways.argmax(0)
            best = ways.max(0) + show[:, seen[k]]
        out = np.zeros(len(lines), np.int64)
        out[-1] = best.argmax()
        for k in range(len(lines) - 1, 0, -1):
            out[k - 1] = came[k, out[k]]
        return out

    def turns(self, transcript: str) -> list[tuple[str, str]]:
        """(role, text without markers) of each turn; an empty transcript has none."""
        return [(role, text) for role, text, _ in self.read(transcript)] if transcript else []

    def read(self, transcript: str) -> list[tuple[str, str, int]]:
        """The same with the line at which each turn begins, of a transcript that has a turn: if it is empty, so is the
        turn."""
        lines, out = transcript.split("\n"), []
        for k, (line, state) in enumerate(zip(lines, self.decode(lines))):
            if state < len(ROLES):
                mark, end = marker(line)
                out.append((ROLES[state], [line[end:]] if mark - 1 == state else [line], k))
            else:
                out[-1][1].append(line)
        return [(role, "\n".join(text).strip("\n"), k) for role, text, k in out]


def render(role: str, text: str) -> str:
    return f"<|{role}|>\n{text}\n<|end|>"


def write_transcript(turns: list[tuple[str | None, str]], style: int, unmarked: set[int] = frozenset()) -> tuple[str, np.ndarray]:
    """A transcript and its lines' true states. A turn without marker stands after a blank line."""
    text, states, _ = written(turns, style, unmarked)
    return text, states


def written(turns: list[tuple[str | None, str]], style: int, unmarked: set[int] = frozenset()) -> tuple[str, np.ndarray, list[int]]:
    """write_transcript(), and at which line each turn begins."""
    lines: list[str] = []
    states: list[int] = []
    begins: list[int] = []
    for k, (role, text) in enumerate(turns):
        known = ROLES.index(role) if role in ROLES else None
        plain = k in unmarked or known is None
        if plain and k:
            lines.append("")
            states.append((states[-1] % len(ROLES)) + len(ROLES))
        begins.append(len(lines))
        mine = ((STYLES[style][role] if not plain else "") + text).split("\n")
        lines += mine
        known = known if known is not None else 1
        states += [known] + [known + len(ROLES)] * (len(mine) - 1)
    return "\n".join(lines), np.array(states, np.int64), begins


def style_of(conv: str | None) -> int:
    return sum((conv or "").encode()) % len(STYLES)


def without_marker(place: int, style: int) -> bool:
    """Whether a conversation's turn at a place (0, 1, ...) carries no marker: every seventh, never the first."""
    return place > 0 and (place + style) % 7 == 3


def _training(conversations: DataFrame, most: int) -> DataFrame:
    """conv_id of the conversations that the model is fitted on: the first half by a hash, `most` of them at most."""
    known = conversations.where("conv_id is not null and turn >= 0").select("conv_id").distinct()
    return known.orderBy(F.xxhash64("conv_id"), "conv_id").limit(min(most, -(-known.count() // 2)) if most else 0)


def fit(conversations: DataFrame, most: int = MOST_TRAINING) -> RoleModel:
    """Learns from the first SEGMENT turns of each training conversation."""
    model = RoleModel()
    some = conversations.where("conv_id is not null and turn >= 0").where(F.col("turn") < SEGMENT)
    rows = some.join(F.broadcast(_training(conversations, most)), "conv_id").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("t"))
    found = rows.select(F.col("conv_id").cast("string").alias("c"), "turn", "t.role", "t.text").orderBy("conv_id", "turn").toArrow().to_pylist()
    by: dict[str, list] = {}
    for r in found:
        by.setdefault(r["c"], []).append((r["role"], r["text"] or ""))
    for conv, turns in by.items():
        style = style_of(conv)
        text, states = write_transcript(turns, style, {k for k in range(len(turns)) if without_marker(k, style)})
        model.learn(text.split("\n"), states)
    return model


def segments(conversations: DataFrame) -> DataFrame:
    """One row for each segment: conv_id, segment, part, turns (array of turn, role, text, copies, own in order); own
    tells the segment's turns from its neighbours' beside them. Segments without turns of their own are left out."""
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text"))
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies"))
    alone = F.col("conv_id").isNull() | F.col("turn").isNull()
    place, own = F.pmod(F.col("turn"), F.lit(SEGMENT)), F.floor(F.col("turn") / SEGMENT)
    # A row without a place is a segment of its own, named by a hash below 0 (turns are numbered from 0).
    single = -1 - F.shiftrightunsigned(F.xxhash64("turn", "role", "text"), 1)
    near = F.array_compact(F.array(F.struct(own.alias("segment"), F.lit(True).alias("own")), F.when((place < CONTEXT) & (own > 0), F.struct((own - 1).alias("segment"), F.lit(False).alias("own"))), F.when(place >= SEGMENT - CONTEXT, F.struct((own + 1).alias("segment"), F.lit(False).alias("own")))))
    where = F.when(alone, F.array(F.struct(single.alias("segment"), F.lit(True).alias("own")))).otherwise(near)
    dealt = once.select("conv_id", "turn", "role", "text", "copies", F.inline(where))
    # Many different rows of one segment: dealt by hash. There are few such segments, if any.
    crowded = dealt.groupBy("conv_id", "segment").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ROWS)
    crowded = crowded.select(F.col("conv_id").alias("_c"), F.col("segment").alias("_s"), F.ceil(F.col("n") / MOST_ROWS).alias("parts"))
    dealt = dealt.join(crowded, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("segment") == F.col("_s")), "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("role", "text"), F.col("parts"))).alias("part")
    found = dealt.groupBy("conv_id", "segment", part).agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "copies", "own"))).alias("turns"))
    return found.where(F.exists("turns", lambda t: t["own"]))


def read_segment(model: RoleModel, conv: str | None, turns: list[dict]) -> list[tuple[dict, tuple[str | None, str | None]]]:
    """The turns that a segment's transcript has by the model, matched with the table's by position among its own."""
    style = style_of(conv)
    plain = {k for k, t in enumerate(turns) if k and t["turn"] is not None and without_marker(t["turn"], style)}
    transcript, _, begins = written([(t["role"], t["text"]) for t in turns], style, plain)
    owned = [k for k, t in enumerate(turns) if t["own"]]
    low = begins[owned[0]] if owned[0] else 0
    high = begins[owned[-1] + 1] if owned[-1] + 1 < len(turns) else float("inf")
    # What the parser finds, by position: the table has no say in boundaries, roles or texts.
    found = [(role, text) for role, text, at in model.read(transcript) if low <= at < high]
    return [(t if isinstance(t, dict) else NO_TURN, x) for t, x in zip_longest([turns[k] for k in owned], found, fillvalue=(None, None))]


def recover(conversations: DataFrame, model: RoleModel | None = None) -> DataFrame:
    """The turns that the parser finds in each segment's transcript, matched by position with the table's: conv_id,
    turn, role (as given), recovered, text, rendered (canonical), trained (whether the model was fitted on the
    conversation). Turns of the table beyond those found have null for recovered, text and rendered; found ones beyond the
    table's have null for turn and role."""
    training = _training(conversations, MOST_TRAINING if model is None else 0).select(F.col("conv_id").alias("_t"))
    sent = conversations.sparkSession.sparkContext.broadcast(model or fit(conversations))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, out = [], {k: [] for k in ("turn", "role", "recovered", "text", "rendered", "copies")}
            conv = batch.column("conv_id").cast(pa.string()).to_pylist()
            for k, (c, turns) in enumerate(zip(conv, batch.column("turns").to_pylist())):
                for t, (role, text) in read_segment(sent.value, c, turns):
                    index.append(k)
                    for name, value in (("turn", t["turn"]), ("role", t["role"]), ("recovered", role), ("text", text), ("rendered", render(role, text) if role else None), ("copies", t["copies"])):
                        out[name].append(value)
            kinds = [pa.int64(), *[pa.string()] * 4, pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(index, pa.int64())), *(pa.array(x, kind) for x, kind in zip(out.values(), kinds))], ["conv_id", *out])

    rows = segments(conversations).select("conv_id", "turns")
    schema = rows.select("conv_id").schema.add("turn", "long").add("role", "string").add("recovered", "string").add("text", "string").add("rendered", "string").add("copies", "long")
    found = map_arrow(rows, parse, schema)
    # Copies are given back in steps, so that no row holds more than STEP numbers.
    found = found.withColumn("part", F.explode(F.expr(f"sequence(0, (copies - 1) div {STEP})")))
    found = found.withColumn("copy", F.explode(F.expr(f"sequence(1, least({STEP}, copies - part * {STEP}))")))
    found = found.join(F.broadcast(training), F.col("conv_id") == F.col("_t"), "left")
    return found.select("conv_id", "turn", "role", "recovered", "text", "rendered", F.col("_t").isNotNull().alias("trained"))


def parse_transcripts(transcripts: DataFrame, model: RoleModel, column: str = "transcript") -> DataFrame:
    """Adds turns (array of role, text) and rendered to a table of plain transcripts; null and empty have no turns."""
    sent = transcripts.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = [sent.value.turns(t or "") for t in batch.column(column).to_pylist()]
            more = [pa.array([[{"role": r, "text": x} for r, x in t] for t in turns], kind), pa.array(["\n".join(render(*x) for x in t) for t in turns], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "turns", "rendered"])

    return map_arrow(transcripts, parse, f"{transcripts._jdf.schema().toDDL()}, turns array<struct<role:string,text:string>>, rendered string")
