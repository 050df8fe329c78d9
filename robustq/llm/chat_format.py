"""Chat formatting: event-sourced reconstruction of conversations, then rendering.

A log holds events (conversation, seq, kind, slot, role, text):

* ``message``: opens the slot with a role and text (replaces what the slot held),
* ``delta``: appends text to the slot (a streamed piece),
* ``edit``: replaces the slot's text, the role stays,
* ``regenerate``: drops the slot and every later one; following events fill them again.

The log is range-sorted by conversation and sequence, so a conversation of any length goes over
several partitions. Null slots become numbers in that order: each sort partition gives what it
does to the last open slot of its first and last conversation, and a partition starts from the
effects of those before it. Then events are dealt by (conversation, block of ``BLOCK`` slots) and
folded slot by slot by an Arrow stream that holds one message; a regeneration reaches later
blocks as one row each. One case needs one stream a conversation (kinds and slots only, no
texts): null slots, given slots and regenerations together, over several sort partitions.

The final messages come out one row each, with the rendered segment and the loss mask as
character spans; a conversation's formatted text is its segments in turn order. Read-back is a
stream a conversation (a digest is sequential), so a long one is hashed without joining its text.

Template: every turn is ``<|turn|>role\\n`` text ``<|end|>\\n``. Inside roles and texts the
escape character and the first character of control strings are escaped, so a text can hold
any control string of this or another template and comes back unchanged.

Defined cases: null text is empty, null role is `unknown`, a null kind is `message`; a null
conversation is one conversation of its own; ties of seq are ordered by kind (message first),
slot, role and text; repeated events apply again; an empty log gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from robustq.llm.common import broadcast_if_bounded, saved

# the template (own choice)
TURN, END, ESCAPE = "<|turn|>", "<|end|>", "\\"
# characters that start a control string of this template or of common ones ([INST], </s>)
_ESCAPED = {ESCAPE: "\\\\", "<": "\\l", "[": "\\b"}
_BACK = {"\\": "\\", "l": "<", "b": "[", "n": "\n"}
ASSISTANT = "assistant"
_KIND_ORDER = {"message": 0, "regenerate": 1, "edit": 2, "delta": 3}
BLOCK = 1024      # parameter: slots of a conversation that are folded in one task
_PID_BITS = 33    # of monotonically_increasing_id: rows of a partition
_FAR = 1 << 60
_NOTHING = object()

MESSAGE_SCHEMA = ("conv_id bigint, turn bigint, role string, text string, segment string, "
                  "loss_start bigint, loss_end bigint")


def escape(text: str) -> str:
    for c, e in _ESCAPED.items():  # the escape character itself comes first
        text = text.replace(c, e)
    return text


def unescape(text: str) -> str:
    if ESCAPE not in text:
        return text
    out, at = [], 0
    while True:
        i = text.find(ESCAPE, at)
        if i < 0:
            return "".join([*out, text[at:]])
        out += [text[at:i], _BACK[text[i + 1]]]
        at = i + 2


def render(role: str, text: str) -> tuple[str, int | None, int | None]:
    """(segment, start, end) of one turn; start/end bound the characters under the loss."""
    head = f"{TURN}{escape(role).replace(chr(10), ESCAPE + 'n')}\n"
    body = escape(text)
    segment = f"{head}{body}{END}\n"
    if role == ASSISTANT:
        return segment, len(head), len(head) + len(body)
    return segment, None, None


def parse(segment: str) -> tuple[str, str]:
    """(role, text) of one rendered turn."""
    if not (segment.startswith(TURN) and segment.endswith(END + "\n")):
        raise ValueError("not a rendered turn")
    role, _, body = segment[len(TURN):-len(END) - 1].partition("\n")
    return unescape(role), unescape(body)


class Slots:
    """Open slots of one conversation, as sorted runs [first, last] (a dense conversation is
    one run)."""

    def __init__(self, last: int = -1):
        self.runs: list[list[int]] = [[0, last]] if last >= 0 else []

    def resolve(self, kind: str, slot: int | None) -> int:
        """The event's slot (see ``fold_log`` for a null one); applies the event."""
        if slot is None:
            last = self.runs[-1][1] if self.runs else -1
            slot = last + 1 if kind == "message" else max(last, 0)
        if kind == "regenerate":
            while self.runs and self.runs[-1][0] >= slot:
                self.runs.pop()
            if self.runs:
                self.runs[-1][1] = min(self.runs[-1][1], slot - 1)
        elif kind in _KIND_ORDER:
            self._open(slot)
        else:
            raise ValueError(f"unknown event kind {kind!r}")
        return slot

    def _open(self, slot: int) -> None:
        i = len(self.runs)
        if i and self.runs[-1][0] > slot:
            i = bisect_right(self.runs, slot, key=lambda r: r[0])
        if i and self.runs[i - 1][1] >= slot:
            return
        if i and self.runs[i - 1][1] == slot - 1:
            self.runs[i - 1][1] = slot
        else:
            i += 1
            self.runs.insert(i - 1, [slot, slot])
        if i < len(self.runs) and self.runs[i][0] == slot + 1:
            self.runs[i - 1][1] = self.runs.pop(i)[1]


class LastSlot:
    """What a piece of a log does to the last open slot: x -> min(max(x + add, low), high).
    Exact while all slots are null or none is regenerated (``mixed`` is neither)."""

    def __init__(self, add=0, low=-_FAR, high=_FAR, null=False, opens=False, cuts=False,
                 negative=False):
        self.add, self.low, self.high = add, low, high
        self.null, self.opens, self.cuts, self.negative = null, opens, cuts, negative

    def _at_least(self, s: int) -> None:
        self.low, self.high = max(self.low, s), max(self.high, s)

    def _move(self, by: int) -> None:
        self.add, self.low, self.high = self.add + by, self.low + by, self.high + by

    def see(self, kind: str, slot: int | None) -> None:
        if kind == "regenerate":
            self.cuts = True
            if slot is None:
                self._move(-1)
            else:
                self.low, self.high = min(self.low, slot - 1), min(self.high, slot - 1)
            self._at_least(-1)
        elif slot is not None:
            self.opens = True
            self.negative |= slot < 0
            self._at_least(slot)
        elif kind == "message":
            self._move(1)
        else:
            self._at_least(0)
        self.null |= slot is None

    def after(self, last: int) -> int:
        return min(max(last + self.add, self.low), self.high)

    def join_flags(self, other: LastSlot) -> None:
        for f in ("null", "opens", "cuts", "negative"):
            setattr(self, f, getattr(self, f) or getattr(other, f))

    @property
    def mixed(self) -> bool:
        return self.null and (self.negative or (self.opens and self.cuts))


def conversation_events(rows: DataFrame, conv: str = "conv_id", turn: str = "turn",
                        role: str = "role", text: str = "text") -> DataFrame:
    """Message rows as a log: each row opens its slot and its text follows as a delta. Slots
    are the rows' turns; rows that repeat a turn (or have none) come one after the other, in
    the order of role and text."""
    c = {n: F.col(f"`{x}`") for n, x in
         (("conv", conv), ("turn", turn), ("role", role), ("text", text))}
    base = rows.select(c["conv"].cast("bigint").alias("conv_id"),
                       F.coalesce(c["turn"].cast("bigint"), F.lit(-1)).alias("turn"),
                       F.coalesce(c["role"], F.lit("unknown")).alias("role"),
                       F.coalesce(c["text"], F.lit("")).alias("text"))
    # the row number only keeps the two events of one of several equal rows together
    base = base.withColumn("_row", F.monotonically_increasing_id())
    event = F.array(F.struct(F.lit("message").alias("kind"), F.lit("").alias("piece")),
                    F.struct(F.lit("delta").alias("kind"), F.col("text").alias("piece")))
    return base.withColumn("e", F.explode(event)).select(
        "conv_id", F.col("turn").alias("seq"), "e.kind", F.lit(None).cast("bigint").alias("slot"),
        "role", F.col("e.piece").alias("text"), F.struct("role", "text", "_row").alias("_tie"))


def _sorted_log(events: DataFrame) -> DataFrame:
    """The log in order (conv_id, kind, slot, role, text, _at), written once: a long
    conversation goes over as many sort partitions as its rows fill. ``_at`` grows along the
    log; its bits from ``_PID_BITS`` on are the sort partition."""
    order = F.element_at(F.create_map(*[F.lit(x) for kv in _KIND_ORDER.items() for x in kv]),
                         F.col("kind"))
    tie = [F.col("_tie")] if "_tie" in events.columns else []
    e = events.select("conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"),
                      "slot", F.coalesce("role", F.lit("unknown")).alias("role"),
                      F.coalesce("text", F.lit("")).alias("text"), *tie)
    # the row id only lets equal events go to several sort partitions
    e = e.withColumn("_same", F.monotonically_increasing_id())
    return saved(e.orderBy("conv_id", "seq", *tie, order, "slot", "role", "text", "_same")
                 .select("conv_id", "kind", "slot", "role", "text",
                         F.monotonically_increasing_id().alias("_at")))


def _pieces(log: DataFrame) -> list[tuple[int, object, bool, LastSlot]]:
    """(sort partition, conversation, is the partition's first, effect) of the first and the
    last conversation of every sort partition, in order; the last one of a partition also has
    the flags of those between them."""
    names = ["pid", "conv_id", "first", "add", "low", "high", "null", "opens", "cuts", "negative"]
    types = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.bool_()] * 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, current, piece, first, between = None, None, None, None, LastSlot()
        for rb in batches:
            for conv, kind, slot, at in zip(*[c.to_pylist() for c in rb.columns]):
                if piece is None or conv != current:
                    if piece is not None and first is None:
                        first = (current, piece)
                    elif piece is not None:
                        between.join_flags(piece)
                    pid, current, piece = at >> _PID_BITS, conv, LastSlot()
                piece.see(kind, slot)
        if piece is None:
            return
        ends = [(*first, True), (current, piece, False)] if first else [(current, piece, True)]
        rows = [(pid, c, f, p.add, p.low, p.high, p.null, p.opens, p.cuts, p.negative)
                for c, p, f in ends]
        if first:  # flags alone: a null conversation of no sort partition's end
            rows.append((pid, None, None, 0, -_FAR, _FAR, between.null, between.opens,
                         between.cuts, between.negative))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                         names=names)

    schema = ("pid bigint, conv_id bigint, first boolean, add bigint, low bigint, high bigint, "
              "null boolean, opens boolean, cuts boolean, negative boolean")
    rows = log.select("conv_id", "kind", "slot", "_at").mapInArrow(run, schema).collect()
    return [(r["pid"], r["conv_id"], r["first"], LastSlot(*r[3:])) for r in
            sorted(rows, key=lambda r: (r["pid"], r["first"] is None, not r["first"]))]


def _resolver(last: dict[int, int]):
    """Arrow map that puts the slots of events (conv_id, kind, slot, ...) in log order into
    their column; ``last`` has the last open slot at the start of a sort partition whose first
    conversation began in an earlier one (the last column is ``_at``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, slots = None, None
        for rb in batches:
            conv, kind, slot = (rb.column(i).to_pylist() for i in range(3))
            found = []
            for i in range(rb.num_rows):
                if slots is None:
                    pid = rb.column(rb.num_columns - 1)[0].as_py() >> _PID_BITS
                    current, slots = conv[i], Slots(last.get(pid, -1))
                elif conv[i] != current:
                    current, slots = conv[i], Slots()
                found.append(slots.resolve(kind[i], slot[i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(found, pa.int64()) if i == 2 else c for i, c in enumerate(rb.columns)],
                names=rb.schema.names)

    return run


def fold_log(events: DataFrame) -> DataFrame:
    """Events (conv_id, seq, kind, slot, role, text) -> final messages (``MESSAGE_SCHEMA``).
    A null slot means: a message opens the next free slot, others go to the last one."""
    log = _sorted_log(events)
    pieces = _pieces(log)
    seen = LastSlot()
    for *_, piece in pieces:
        seen.join_flags(piece)

    # conversations that go over the end of a sort partition: last slot at each start
    ends = [p for p in pieces if p[2] is not None]
    whole: dict = {}
    for _, conv, _, piece in ends:
        whole.setdefault(conv, LastSlot()).join_flags(piece)
    start, before, last, crossing = {}, _NOTHING, -1, set()
    for pid, conv, _, piece in ends:
        if conv != before:
            before, last = conv, -1
        else:
            crossing.add(conv)
            if not whole[conv].mixed:
                start[pid] = last
        last = piece.after(last)
    mixed = [c for c in crossing if whole[c].mixed]

    cols = ["conv_id", "kind", "slot", "role", "text", "_at"]
    schema = "conv_id bigint, kind string, slot bigint, role string, text string, _at bigint"
    is_mixed = F.lit(False)
    for c in mixed:
        is_mixed = is_mixed | F.col("conv_id").eqNullSafe(F.lit(c).cast("bigint"))
    e = (log.where(~is_mixed) if mixed else log).select(*cols).mapInArrow(_resolver(start), schema)
    if mixed:  # their slots from one stream each, without roles and texts
        some = log.where(is_mixed)
        found = (some.select("conv_id", "kind", "slot", "_at").repartition("conv_id")
                 .sortWithinPartitions("conv_id", "_at")
                 .mapInArrow(_resolver({}), "conv_id bigint, kind string, slot bigint, _at bigint"))
        e = e.unionByName(some.drop("slot").join(found.select("slot", "_at"), "_at").select(*cols))
    e = e.withColumn("_block", F.floor(F.col("slot") / BLOCK).cast("bigint"))
    if seen.cuts:  # a regeneration also drops what later blocks had: their newest one, as a row
        w = Window.partitionBy("conv_id").orderBy("_block") \
            .rowsBetween(Window.unboundedPreceding, -1)
        cut = F.max(F.when(F.col("kind") == "regenerate", F.col("_at")))
        cuts = e.groupBy("conv_id", "_block").agg(cut.alias("_c")) \
            .select("conv_id", "_block", F.max("_c").over(w).alias("_at")).where("_at is not null")
        e = e.unionByName(cuts.select(
            "conv_id", F.lit("regenerate").alias("kind"), (F.col("_block") * BLOCK).alias("slot"),
            F.lit("").alias("role"), F.lit("").alias("text"), "_at", "_block"))
    e = (e.repartition("conv_id", "_block")
         .sortWithinPartitions("conv_id", "_block", "slot", F.col("kind") != "regenerate", "_at")
         .select("conv_id", "_block", "slot", "kind", "role", "text", "_at"))
    m = e.mapInArrow(_fold_slots, "_block bigint, _slot bigint, " + MESSAGE_SCHEMA)
    names = [f.split()[0] for f in MESSAGE_SCHEMA.split(", ")]
    if not seen.opens:  # only next free slots: they are the turns
        return m.select(*[F.col("_slot").alias(n) if n == "turn" else F.col(n) for n in names])
    w = Window.partitionBy("conv_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = saved(m.groupBy("conv_id", "_block").agg(F.count(F.lit(1)).alias("_n"))
                    .select(F.col("conv_id").alias("_c"), F.col("_block").alias("_b"),
                            F.sum("_n").over(w).alias("_off")).where("_off is not null"))
    m = m.join(broadcast_if_bounded(offsets, 24),
               F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_block") == F.col("_b")), "left")
    return m.select(*[(F.col("turn") + F.coalesce("_off", F.lit(0))).alias(n) if n == "turn"
                      else F.col(n) for n in names])


def _fold_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Events by conversation, block and slot, regenerations of a slot first and then in log
    order -> messages; turns count from 0 in each block. What is held is one message."""
    block, dead, turn, at_slot, role, pieces = None, -1, 0, None, None, None
    out, size = [], 0
    names = ["_block", "_slot", *[f.split()[0] for f in MESSAGE_SCHEMA.split(", ")]]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(),
             pa.string(), pa.int64(), pa.int64()]

    def batch(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def message():
        text = "".join(pieces)
        seg, lo, hi = render(role, text)
        return block[1], at_slot, block[0], turn, role, text, seg, lo, hi

    for rb in batches:
        for conv, b, slot, kind, r, text, at in zip(*[c.to_pylist() for c in rb.columns]):
            if (conv, b) != block or slot != at_slot:
                if pieces is not None:
                    out.append(message())
                    size += len(out[-1][5]) + len(out[-1][6])
                    turn += 1
                    if size > 1 << 20:
                        yield batch(out)
                        out, size = [], 0
                if (conv, b) != block:
                    block, dead, turn = (conv, b), -1, 0
                at_slot, role, pieces = slot, None, None
            if kind == "regenerate":
                dead = max(dead, at)
            elif at < dead:
                continue
            elif kind == "message":
                role, pieces = r, [text]
            elif kind == "delta":
                if pieces is None:
                    role, pieces = r, []
                pieces.append(text)
            else:
                role, pieces = r if pieces is None else role, [text]
    if pieces is not None:
        out.append(message())
    if out:
        yield batch(out)


def format_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """Message rows -> final messages with rendered segments, through the event log."""
    return fold_log(conversation_events(rows, conv, turn, role, text))


def formatted_text(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted): the training text of each conversation as one row (a file's
    row; use the segments themselves where a conversation may be too long for that)."""
    return messages.groupBy("conv_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("turn", "segment"))), lambda s: s["segment"]), "")
        .alias("formatted"))


def read_back(messages: DataFrame) -> DataFrame:
    """Digest of the formatted text, from the segments and loss spans alone, streamed in turn
    order: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    s = (messages.select("conv_id", "turn", "segment", "loss_start", "loss_end")
         .repartition("conv_id").sortWithinPartitions("conv_id", "turn")
         .drop("turn"))
    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, "
              "loss_sha256 string, formatted_chars bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None

        def result(conv, st):
            n, turns, chars, loss, total = st
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([n], pa.int64()),
                 pa.array([turns.hexdigest()]), pa.array([chars], pa.int64()),
                 pa.array([loss.hexdigest()]), pa.array([total], pa.int64())],
                names=[f.split()[0] for f in schema.split(", ")])

        for rb in batches:
            done = []
            for conv, seg, lo, hi in zip(*[c.to_pylist() for c in rb.columns]):
                if state is None or conv != current:
                    if state is not None:
                        done.append(result(current, state))
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse(seg)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if lo is not None:
                    learnt = unescape(seg[lo:hi])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode("utf-8", "surrogatepass"))
                state[4] += len(seg)
            if done:
                yield from pa.Table.from_batches(done).combine_chunks().to_batches()
        if state is not None:
            yield result(current, state)

    return s.mapInArrow(run, schema)
