"""BPE encoding as a streaming transducer with bounded lookahead, and incremental decoding.

Sufficient lookahead. Apply the merge rules in order, each over the whole word from left to
right (for a list whose parts are built by earlier rules this is what popping the best pair
does). Compare the runs on u and on u followed by any v: they agree left of a border that
starts at the end of u. A rule (x, y) moves the border left only if x is the last agreed token
and merges with what follows in one run only; the border then moves by len(x). The next move,
by a later rule (x', y'), needs y' to begin at the border, where one of the runs has x or
something grown from x: x lies on the left spine of y'. So the longest chain

    reach(x', y') = len(x') + max(0, reach(x, .) of an earlier rule with x on y's left spine)

bounds how far unseen text can reach back. It is computed once from the merge list. A token
that ends at least that far before the end of what has been read is stable and is emitted;
the text behind an emitted token encodes on its own, so the buffer stays of constant size
however long a word is. Ordinary words are shorter than the buffer and are encoded at once.

Text is cut at white space first (no token crosses it) and encodings of chunks are kept in a
two-generation cache of bounded size.

Defined cases: null is the empty text (no tokens); strings of added tokens are recognised in
the raw text, longest and leftmost first; characters without a vocabulary entry are dropped.
"""

from __future__ import annotations

import codecs
import contextlib
import gc
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from robustq.llm.common import map_texts

# fixed values: printable stand-ins of the 256 bytes in byte-level vocabularies
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHAR = {b: chr(b) for b in _PRINT}
BYTE_CHAR |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _PRINT)}
CHAR_BYTE = {c: b for b, c in BYTE_CHAR.items()}

CACHE_ENTRIES = 120_000  # parameter: chunks per cache generation
WORD_ENTRIES = 30_000    # parameter: words whose ids are kept
SEGMENT_CHARS = 1 << 19   # parameter: characters normalised and cut into chunks at a time
SPACE = regex.compile(r"\s+")


class Vocabulary:
    """What a tokenizer file says: ids, ranked merges, patterns. Small and picklable."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1))
                 for m in model["merges"]]
        self.ranks: dict[tuple[str, str], int] = {p: i for i, p in enumerate(pairs)}
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.added.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern: str = split["pattern"]["Regex"]
        self.lookahead = sufficient_lookahead(pairs, self.suffix)
        self._number(pairs)
        self.names = {i: str(i) for i in self.tokens}
        # what the decoding machine reads of an id: its bytes, and whether a word ends there
        self.bytes: dict[int, bytes] = {}
        self.ends: set[int] = set()
        for t, i in self.ids.items():
            if self.suffix and t.endswith(self.suffix):
                self.ends.add(i)
                t = t[:-len(self.suffix)]
            self.bytes[i] = bytes(CHAR_BYTE[c] for c in t if c in CHAR_BYTE)
        self.plain = set(self.added.values())
        self.closing = self.ends | self.plain


    def _number(self, pairs: list[tuple[str, str]]) -> None:
        """Symbols as numbers, for ordinary words: a pair is one number, its rank and what it becomes
        are looked up without building strings."""
        number: dict[str, int] = {}
        def of(x: str) -> int:
            return number.setdefault(x, len(number))
        self.first = [of(BYTE_CHAR[b]) for b in range(256)]
        self.last = [of(BYTE_CHAR[b] + self.suffix) for b in range(256)]
        joins = [(of(x), of(y), of(x + y)) for x, y in pairs]
        self.width = len(number)
        self.joins: dict[int, int] = {}
        for rank, (x, y, _) in enumerate(joins):
            self.joins.setdefault(x * self.width + y, rank)
        self.made = [z for _, _, z in joins]
        # ranks of two bytes that are not the last ones of their word: where every merge starts
        get, none = self.joins.get, len(joins)
        self.pairs = [[get(x * self.width + y, none) for y in self.first] for x in self.first]
        self.id_of = [self.ids.get(x, -1) for x in number]


def sufficient_lookahead(merges: Iterable[tuple[str, str]], suffix: str = "") -> int:
    """Characters of lookahead after which a token cannot change (see the module's text)."""
    left: dict[str, str] = {}
    reach: dict[str, int] = {}   # by left part, over the rules so far
    worst = 0
    for x, y in merges:
        best, s = 0, y
        while s is not None:     # the left spine of y
            best = max(best, reach.get(s, 0))
            s = left.get(s)
        value = len(x) + best
        reach[x] = max(reach.get(x, 0), value)
        left.setdefault(x + y, x)
        worst = max(worst, value)
    return worst + 1             # the word's last character is another symbol than within


class Encoder:
    def __init__(self, vocab: Vocabulary, buffer: int | None = None):
        self.v = vocab
        self.piece = regex.compile(vocab.pattern)
        self.special = regex.compile("|".join(
            regex.escape(t) for t in sorted(vocab.added, key=len, reverse=True)) or r"(?!)")
        self.buffer = buffer or max(256, 4 * vocab.lookahead)
        self.cache = _Cache(self.encode_chunk)
        self.words: dict[str, list[int]] = {}
        self.machine = TextDecoder(vocab)

    # -- merging ---------------------------------------------------------------------
    def _merge_short(self, sym: list[str]) -> list[str]:
        ranks = self.v.ranks
        get = ranks.get
        none = len(ranks)
        r = [get(p, none) for p in zip(sym, sym[1:])]
        while r:
            low = min(r)
            if low == none:
                break
            i = r.index(low)
            sym[i:i + 2] = [sym[i] + sym[i + 1]]
            del r[i]
            if i:
                r[i - 1] = get((sym[i - 1], sym[i]), none)
            if i < len(r):
                r[i] = get((sym[i], sym[i + 1]), none)
        return sym

    def _merge(self, sym: list[str]) -> list[str]:
        """Best pair first, leftmost first among equals."""
        if len(sym) < 48:
            return self._merge_short(sym)
        ranks = self.v.ranks
        nxt = list(range(1, len(sym) + 1))
        prev = list(range(-1, len(sym) - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(sym, sym[1:])) if p in ranks]
        heapq.heapify(heap)
        live: list = list(sym)
        n = len(sym)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = nxt[i]
            if live[i] != a or j >= n or live[j] != b:
                continue
            live[i], live[j] = a + b, None
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for k in (prev[i], i):
                if k >= 0 and nxt[k] < n:
                    p = (live[k], live[nxt[k]])
                    if p in ranks:
                        heapq.heappush(heap, (ranks[p], k, p))
        return [t for t in live if t is not None]

    def stream(self, chars: Iterable[str]) -> Iterator[str]:
        """Tokens of one word from an iterable of its byte characters, each emitted as soon
        as it is stable; holds at most ``buffer`` characters."""
        held: list[str] = []
        ahead = None
        for c in chars:
            if ahead is not None:
                held.append(ahead)
                if len(held) >= self.buffer:
                    limit, at = len(held) - self.v.lookahead, 0
                    for t in self._merge(list(held)):
                        if at + len(t) > limit:
                            break
                        at += len(t)
                        yield t
                    if at == 0:  # no token is stable yet: read on
                        self.buffer *= 2
                    held = held[at:]
            ahead = c
        if ahead is not None:
            yield from self._merge([*held, ahead + self.v.suffix])

    # -- text ------------------------------------------------------------------------
    def _ordinary(self, data: bytes) -> list[int]:
        """Ids of a short word: the best pair first, leftmost first among equals, on numbers."""
        v = self.v
        first, made, width, get, none = v.first, v.made, v.width, v.joins.get, len(v.made)
        pairs = v.pairs
        sym = [first[b] for b in data]
        sym[-1] = v.last[data[-1]]
        r = [pairs[a][b] for a, b in zip(data, data[1:])]
        if r:
            r[-1] = get(sym[-2] * width + sym[-1], none)
        while r:
            low = min(r)
            if low == none:
                break
            i = r.index(low)
            sym[i] = made[low]
            del sym[i + 1], r[i]
            if i:
                r[i - 1] = get(sym[i - 1] * width + sym[i], none)
            if i < len(r):
                r[i] = get(sym[i] * width + sym[i + 1], none)
        id_of = v.id_of
        return [id_of[x] for x in sym if id_of[x] >= 0]

    def _word(self, word: str) -> list[int]:
        data = word.encode("utf-8", "surrogatepass")
        if len(data) < 48:
            return self._ordinary(data)
        ids, chars = self.v.ids, [BYTE_CHAR[b] for b in data]
        if len(chars) <= self.buffer:
            chars[-1] += self.v.suffix
            tokens = self._merge(chars)
        else:
            tokens = self.stream(chars)
        return [ids[t] for t in tokens if t in ids]

    def encode_chunk(self, chunk: str) -> tuple[int, str, str, str | None]:
        """(number of ids, ids joined by spaces, their tokens joined by spaces, the text that the
        decoding machine makes of them) of a chunk without white space. The machine is fed the ids
        from its starting state; the text is None if it does not end between two words, where
        the machine has no memory."""
        ids: list[int] = []
        known = self.words
        # letters of ASCII alone are one part of the pattern
        whole = chunk.isascii() and chunk.isalpha()
        if whole and len(chunk) < 48:  # kept as a chunk, not as a word as well
            ids = self._ordinary(chunk.encode())
        for word in () if ids else (chunk,) if whole else self.piece.findall(chunk):
            got = known.get(word)
            if got is None:
                got = self._word(word)
                if len(word) <= 32:
                    if len(known) >= WORD_ENTRIES:
                        known.clear()
                    known[word] = got
            ids += got
        machine = self.machine
        text = machine.feed_all(ids)
        if not machine.between_words():
            text = None
        machine.reset()
        names, tokens = self.v.names, self.v.tokens
        return (len(ids), " ".join([names[i] for i in ids]), " ".join([tokens[i] for i in ids]),
                chunk if text == chunk else text)

    def normalised(self, text: str) -> list[str]:
        """Chunks between white space of NFC, lower-cased text (character by character)."""
        if text.isascii():
            text = text.lower()
        else:
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return SPACE.split(text) if _odd(text) else text.split()

    def parts(self, text: str | None) -> Iterator[list[tuple[int, str, str, str | None]]]:
        """Lists of encoded chunks, in order; added tokens come as chunks of their own."""
        text, at = text or "", 0
        if "<" in text:
            for m in self.special.finditer(text):
                yield from self._segments(text[at:m.start()])
                yield [(1, str(self.v.added[m.group()]), m.group(), m.group())]
                at = m.end()
        yield from self._segments(text[at:] if at else text)

    def _segments(self, text: str) -> Iterator[list[tuple[int, str, str, str | None]]]:
        """Encode in segments cut before white space, so that no long list is held."""
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > SEGMENT_CHARS:
                gap = SPACE.search(text, at + SEGMENT_CHARS)
                end = gap.start() if gap else end
            found = [h for h in map(self.cache.__getitem__, self.normalised(text[at:end])) if h[0]]
            if found:
                yield found
            at = end

    def ids(self, text: str | None) -> list[int]:
        return [int(i) for part in self.parts(text) for h in part for i in h[1].split(" ")]


class _Cache(dict):
    """Chunk encodings of two generations: a full one becomes the old one, whose entries come
    back when they are asked for again."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.old = encode, {}

    def __missing__(self, chunk: str):
        hit = self.old.get(chunk)
        if hit is None:
            hit = self.encode(chunk)
        if len(chunk) <= 64:
            if len(self) >= CACHE_ENTRIES:
                self.old = dict(self)
                self.clear()
            self[chunk] = hit
        return hit


def _odd(text: str) -> bool:
    """Separators that str.split() takes for white space and the pattern does not."""
    return any(c in text for c in "\x1c\x1d\x1e\x1f")


def decode(vocab: Vocabulary, ids: Iterable[int]) -> str:
    """Decoding without a decoder component: the tokens joined by one space."""
    return " ".join(vocab.tokens[i] for i in ids if i in vocab.tokens)


class TextDecoder:
    """Incremental byte-to-text machine: feed ids, get the text that is final. The state is the open
    part of one UTF-8 sequence and whether a word just ended."""

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        self.gap = False

    def reset(self) -> None:
        self.machine.reset()
        self.gap = False

    def feed(self, i: int) -> str:
        return self.feed_all((i,))

    def feed_all(self, ids: Sequence[int]) -> str:
        """The ids one after the other; the bytes of one word are decoded together."""
        v = self.v
        if not self.gap and ids and ids[-1] in v.ends and v.closing.isdisjoint(ids[:-1]) \
                and not self.machine.getstate()[0]:
            try:  # one whole word from a clean state: the usual case
                text = b"".join([v.bytes[i] for i in ids]).decode()
                self.gap = True
                return text
            except UnicodeDecodeError:  # it ends within a character, or has none
                pass
        out, data = [], []
        for i in ids:
            if self.gap:
                out.append(" ")
                self.gap = False
            if i in v.plain:
                out.append(self.machine.decode(b"".join(data)) + self.machine.decode(b"", True) + v.tokens[i])
                data, self.gap = [], True
                continue
            data.append(v.bytes.get(i, b""))
            if i in v.ends:
                out.append(self.machine.decode(b"".join(data)))
                data, self.gap = [], True
        if data:
            out.append(self.machine.decode(b"".join(data)))
        return "".join(out)

    def between_words(self) -> bool:
        """A word just ended and no character is open: what follows is read as from the start,
        behind one space."""
        return self.gap and not self.machine.getstate()[0]

    def join(self, texts: Sequence[str]) -> str:
        """Feed chunks by the texts they have from the starting state. Only at the start or
        between words."""
        out = " ".join(texts)
        out, self.gap = (" " + out if self.gap else out), True
        return out

    def close(self) -> str:
        return self.machine.decode(b"", True)


_ENCODERS: dict = {}


def encoder(vocab_broadcast) -> Encoder:
    """One encoder (and cache) per Python worker while a task runs: workers stay after their task, and
    an executor has more of them than cores, so what they keep is dropped with the task."""
    key = id(vocab_broadcast.value)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(vocab_broadcast.value)
    return _ENCODERS[key]


def _drop() -> None:
    _ENCODERS.clear()


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """No search for reference cycles: encodings have none, and every chunk that is kept would be
    looked through again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id",
               text: str = "text") -> DataFrame:
    """DataFrame (id, ids array<int>, decoded string) of every text."""
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def fn(col):
        enc = encoder(vocab)
        with uncollected():
            ids = [enc.ids(t) for t in col.to_pylist()]
        return [pa.array(ids, pa.list_(pa.int32())),
                pa.array([decode(enc.v, i) for i in ids], pa.string())]
    return map_texts(docs, text, [id_col], [("ids", "array<int>"), ("decoded", "string")], fn, _drop)


def bpe_digest(docs: DataFrame, path: str, carry: list[str] | None = None,
               text: str = "text") -> DataFrame:
    """The ``carry`` columns (default: all), n_tokens, ids_sha256, decoded_sha256 (the tokens joined
    by spaces, which is what the library returns for a file without a decoder) and text_xxh64
    (of the text that the byte-to-text machine makes of the ids): the encoding of every text hashed
    while it streams, so that no text's ids are held at once."""
    vocab = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def fn(col):
        enc = encoder(vocab)
        with uncollected():
            rows = [digest(enc, t) for t in col.to_pylist()]
        return [list(x) for x in zip(*rows)] if rows else [[], [], [], []]
    carry = list(docs.columns) if carry is None else carry
    return map_texts(docs, text, carry, [("n_tokens", "bigint"), ("ids_sha256", "string"),
                                          ("decoded_sha256", "string"), ("text_xxh64", "string")], fn, _drop)


def digest(enc: Encoder, text: str | None) -> tuple[int, str, str, str]:
    """(number of tokens, sha256 of the ids and of the tokens joined by spaces, XXH64 of the text that
    the decoding machine makes of the ids), hashed as they come."""
    n, hashes, first = 0, (hashlib.sha256(), hashlib.sha256()), True
    machine, out = TextDecoder(enc.v), xxhash.xxh64()
    start = True  # the machine is in its starting state
    for part in enc.parts(text):
        counts, ids, tokens, texts = zip(*part)
        n += sum(counts)
        for h, held in zip(hashes, (ids, tokens)):
            if not first:
                h.update(b" ")
            h.update(" ".join(held).encode())
        if None not in texts and (start or machine.between_words()):
            out.update(machine.join(texts).encode("utf-8", "surrogatepass"))
        else:
            for i, known in zip(ids, texts):
                if known is not None and (start or machine.between_words()):
                    piece = machine.join([known])
                else:
                    piece = machine.feed_all([int(x) for x in i.split(" ")])
                out.update(piece.encode("utf-8", "surrogatepass"))
                start = False
        first = start = False
    out.update(machine.close().encode("utf-8", "surrogatepass"))
    return n, hashes[0].hexdigest(), hashes[1].hexdigest(), out.hexdigest()
