"""Packing token sequences into windows of a fixed length with bounded memory.

Every document is encoded, closed with an end id and laid into windows online: a partition
keeps a fixed number of windows open, a piece goes where it leaves the least room, and when
it fits nowhere the fullest window is filled with the head of the piece and emitted. What is
still open at the end of the partitions is merged by the same packer, ``fan_in`` partitions a task,
so no task ever sees more than ``fan_in`` times ``open_windows`` windows. What a merging task has
open at its end is laid out in a row and cut into full windows and, at last, powers of two, which
need no padding.

``min_piece``: a cut leaves no piece below that many ids beside it; the fullest window is emitted
with that little room (less than twice as much) instead.

The pieces of a partition are written to shared storage once, so its windows are decided once:
a lost executor replays at most the partition it was in, and reruns over the same files give the
same windows.

Defined cases: null and empty texts are the end id alone; texts of any length are encoded whole
and cut; null and repeated ids are packed row by row like any others; an empty table gives an
empty result; extra columns are not read. The library's treatment of a special token's name
inside a text (it becomes that token) is kept.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustq.llm.bpe_stream import CHAR_BYTE
from robustq.llm.common import row_slices, saved

# Parameters
WINDOW = 1024        # ids of a sequence
OPEN_WINDOWS = 64    # windows a task keeps open
FAN_IN = 32          # partitions whose open windows one merging task gets
MIN_PIECE = 8        # ids
SEEN = 20_000        # stretches with other characters a worker remembers
# sequence ids: merged or not, partition (merged: group of partitions), running number
_MERGED_BIT, _GROUP_BITS = 58, 34
# fixed value: how byte-level BPE of this kind cuts a text before merging
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SCHEMA = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint, ids binary, open boolean")


class Packer:
    """Best-fit over a fixed number of open windows. ``add`` takes (doc, start, total, ids) and
    yields the windows that it closes as lists of such pieces; ``rest`` yields the open ones.

    ``rooms`` is the sorted list of (free ids, window number) of the open windows."""

    def __init__(self, size: int = WINDOW, keep: int = OPEN_WINDOWS, min_piece: int = MIN_PIECE):
        self.size, self.keep, self.min_piece = size, keep, min_piece
        self.rooms: list[tuple[int, int]] = []
        self.windows: dict[int, list] = {}
        self._next = 0

    def add(self, doc, start: int, total: int, ids: np.ndarray) -> Iterator[list]:
        while len(ids) >= self.size:  # a window of its own
            yield [(doc, start, total, ids[:self.size])]
            start, ids = start + self.size, ids[self.size:]
        while len(ids):
            at = bisect_left(self.rooms, (len(ids), -1))
            if at < len(self.rooms):
                yield from self._put(at, (doc, start, total, ids))
                return
            if len(self.rooms) < self.keep:
                self.windows[self._next] = [(doc, start, total, ids)]
                insort(self.rooms, (self.size - len(ids), self._next))
                self._next += 1
                return
            head = self._head(self.rooms[0][0], len(ids))
            if head:
                room, w = self.rooms.pop(0)
                self.windows[w].append((doc, start, total, ids[:head]))
                start, ids = start + head, ids[head:]
            else:
                w = self.rooms.pop(0)[1]
            yield self.windows.pop(w)

    def _head(self, room: int, n: int) -> int:
        """Ids of a piece of ``n`` that go into ``room`` (less than ``n``): all that leave
        neither part below ``min_piece``, or none."""
        head = min(room, n - self.min_piece)
        return head if head >= self.min_piece else 0

    def _put(self, at: int, piece) -> Iterator[list]:
        room, w = self.rooms.pop(at)
        self.windows[w].append(piece)
        if room == len(piece[3]):
            yield self.windows.pop(w)
        else:
            insort(self.rooms, (room - len(piece[3]), w))

    def rest(self) -> Iterator[list]:
        for _, w in self.rooms:
            yield self.windows[w]
        self.rooms, self.windows = [], {}


def fill_exactly(windows: Iterator[list], size: int) -> Iterator[list]:
    """The pieces of ``windows`` in a row, cut into full windows; the end into powers of two."""
    pieces = [p for w in windows for p in w]
    left = sum(len(p[3]) for p in pieces)
    at, used = 0, 0
    while left:
        room = size if left >= size else 1 << (left.bit_length() - 1)
        left -= room
        out = []
        while room:
            doc, start, total, ids = pieces[at]
            take = min(room, len(ids) - used)
            out.append((doc, start + used, total, ids[used:used + take]))
            room, used = room - take, used + take
            if used == len(ids):
                at, used = at + 1, 0
        yield out


_ARROW = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in (
    "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
    ("ids", pa.binary()), ("open", pa.bool_())])


def _rows(windows: Iterator[tuple[int, list, bool]], merged: int, keep_ids: bool
          ) -> Iterator[pa.RecordBatch]:
    """Arrow batches of the pieces of (group, window, still open); the windows of a group come
    together and are numbered from 0. Ids only where asked for or still needed."""
    rows: list[tuple] = []
    held, now, k = 0, None, 0
    for group, w, is_open in windows:
        now, k = group, (k + 1 if group == now else 0)
        number = (merged << _MERGED_BIT) + (group << _GROUP_BITS) + k
        offset = 0
        for doc, start, total, ids in w:
            raw = ids.astype("<u4").tobytes()
            with_ids = keep_ids or is_open
            rows.append((doc, start, len(ids), zlib.crc32(raw), total, number, offset,
                         raw if with_ids else None, is_open))
            offset += len(ids)
            held += 64 + (len(raw) if with_ids else 0)
        if held > 1 << 20:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)],
                                      schema=_ARROW)


# Letters whose class no Unicode version of the last twenty years has changed (Latin, Greek, Cyrillic,
# Han), with ASCII: both libraries cut them alike.
_LETTERS = ("\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u04ff"
            "\u4e00-\u9fa5")
OTHER = re.compile(f"[^\x00-\x7f{_LETTERS}]+")
CUT = re.compile(f"(?<=[!-~{_LETTERS}]) (?=[!-~{_LETTERS}])")


class ByteBpe:
    """Ids of texts as the ``tokenizers`` library gives them, without special tokens of its own,
    truncation or padding.

    ASCII and common letters are encoded by ``tiktoken`` from the same vocabulary, which is several
    times faster: both use the same classes for these characters, and the vocabulary's ids are the
    ranks of its merges. Other characters, whose classes depend on a library's Unicode version, go
    to ``tokenizers`` with their surroundings up to the next safe cut: a single space between two
    characters that are no white space in any version always opens a new part of the pattern, so
    what stands before it and what stands from it on are encoded apart. A text that names an
    added token is encoded by ``tokenizers`` whole."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker has the core of its task
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.seen: dict[str, np.ndarray] = {}
        self.added = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(CHAR_BYTE[c] for c in t): i for t, i in spec["model"]["vocab"].items()
                 if t not in self.added}
        self.fast = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _plain(self, text: str) -> np.ndarray:
        return self.fast.encode_to_numpy(text, disallowed_special=())

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def _island(self, text: str) -> np.ndarray:
        ids = self.seen.get(text)
        if ids is None:
            ids = self._whole(text)
            if len(text) <= 64:
                if len(self.seen) >= SEEN:
                    self.seen.clear()
                self.seen[text] = ids
        return ids

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [self.encode(t) for t in texts]

    def encode(self, text: str) -> np.ndarray:
        if any(t in text for t in self.added):
            return self._whole(text)
        out, at = [], 0
        for start, end in islands(text):
            if at < start:
                out.append(self._plain(text[at:start]))
            out.append(self._island(text[start:end]))
            at = end
        if not out:
            return self._plain(text)
        if at < len(text):
            out.append(self._plain(text[at:]))
        return np.concatenate(out)


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of ``text`` between safe cuts that hold other characters than ASCII and common
    letters; all else ends at safe cuts."""
    end = 0
    for m in OTHER.finditer(text):
        if m.start() < end:
            continue
        start = text.rfind(" ", end, m.start())
        while start > end and not CUT.match(text, start):
            start = text.rfind(" ", end, start)
        start = max(start, end)  # the stretch before ended at a safe cut (or is the text's start)
        cut = CUT.search(text, m.end())
        end = cut.start() if cut else len(text)
        yield start, end


def library_encoder(path: str) -> ByteBpe:
    """One encoder per Python worker."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


_LOADED: dict = {}


def pack(docs: DataFrame, encoder: Callable[[], Callable[[list[str]], Sequence]], text: str = "text",
         id_col: str = "doc_id", end_id: int = 0, size: int = WINDOW, keep: int = OPEN_WINDOWS,
         min_piece: int = MIN_PIECE, fan_in: int = FAN_IN, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (ids of its document before it), ``length``,
    ``ids_crc32`` (of the ids as little-endian unsigned 32-bit numbers), ``doc_tokens``,
    ``sequence_id``, ``offset`` there and, with ``with_ids``, ``ids`` (those bytes).

    ``encoder()`` is called in the task and returns a function from texts to their ids."""
    inp = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"),
                      F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def lay(batches):
        from pyspark import TaskContext
        encode, packer = encoder(), Packer(size, keep, min_piece)
        part = TaskContext.get().partitionId()

        def windows():
            for rb in row_slices(batches, "text"):
                ids = encode(rb.column(1).to_pylist())
                for doc, one in zip(rb.column(0).to_pylist(), ids):
                    a = np.empty(len(one) + 1, np.uint32)
                    a[:-1], a[-1] = one, end_id
                    for w in packer.add(doc, 0, len(a), a):
                        yield part, w, False
            for w in packer.rest():
                yield part, w, True
        yield from _rows(windows(), 0, with_ids)

    pieces = saved(inp.mapInArrow(lay, SCHEMA))
    merged = _merge(pieces.where("open"), pieces.rdd.getNumPartitions(), size, keep, min_piece, fan_in, with_ids)
    out = pieces.where(~F.col("open")).unionByName(merged)
    return out.drop("open") if with_ids else out.drop("open", "ids")


def _merge(left: DataFrame, parts: int, size: int, keep: int, min_piece: int, fan_in: int,
           with_ids: bool) -> DataFrame:
    """Lay the open windows of every ``fan_in`` partitions into windows again, in one task; long
    pieces first. Nothing stays open."""
    group = F.floor(F.shiftright("sequence_id", _GROUP_BITS) / fan_in).cast("bigint")
    # a task may get several groups or none: each is packed by itself, so that the result does
    # not depend on how they are dealt
    g = left.withColumn("_g", group).repartitionByRange(max(1, -(-parts // fan_in)), "_g")
    order = ["_g", F.col("length").desc(), "sequence_id", "offset"]
    g = g.sortWithinPartitions(*order).select("doc_id", "start", "doc_tokens", "ids", "_g")

    def lay(batches):
        def windows():
            packer, now = Packer(size, keep, min_piece), 0

            def rest():
                return ((now, w, False) for w in fill_exactly(packer.rest(), size))

            for rb in batches:
                for doc, start, total, raw, group in zip(*[c.to_pylist() for c in rb.columns]):
                    if group != now:
                        yield from rest()
                        now = group
                    for w in packer.add(doc, start, total, np.frombuffer(raw, "<u4")):
                        yield now, w, False
            yield from rest()
        yield from _rows(windows(), 1, with_ids)

    return g.mapInArrow(lay, SCHEMA)
