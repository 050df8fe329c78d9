"""Language ID by cross-parsing entropy over suffix automata.

For each language a bounded sample of labelled text (whole texts in hash order while they fit
into ``sample_chars``; where a language has too few that fit, passages of its longer texts, cut at
the end of a paragraph) becomes a suffix automaton. A text is cross-parsed against every
language: from each phrase start the longest match in the sample is one phrase, an unseen
character is a phrase of its own. The language with the fewest phrases per character wins
(ties: the smallest name).

Letters are lower-cased and every letter that any sample holds is a class of its own, whatever
their number; letters that none holds are one class, everything else between letters is one
separator. The transitions of all automata lie interleaved in one array (a state's row is shifted to
where its entries meet free places), so the model grows with the samples, not with states
times letters. Parsing restarts every ``block`` characters (a parameter; whole texts are parsed),
so one chunk of texts is parsed as many lanes side by side: per step a few table lookups for all
lanes and languages in numpy, no per-character Python.

Defined cases: null texts and texts without a letter give `und` with score 0; without any
labelled text every text is `und`; repeated rows are predicted alike; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustq.llm.common import map_texts

SAMPLE_CHARS = 32_768   # parameter: labelled characters per language
SAMPLE_TEXTS = 64       # parameter: labelled texts looked at per language
MARGIN = 4              # parameter: expected hashes below the first threshold, in SAMPLE_TEXTS
BLOCK = 512             # parameter: characters after which the parse restarts


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Model:
    """A state is the place of its row in ``cells``: the cell at state + class holds (state << 32) +
    next state if there is a transition by the class; if it holds another state's, the phrase ends.
    ``opening[l, class]`` is the state of language l after the first character of a phrase."""

    langs: list[str]
    classes: np.ndarray   # code point -> 0 separator, 1.. letter classes
    letter: np.ndarray    # code point -> is a letter
    opening: np.ndarray
    cells: np.ndarray


def sequence(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Classes with runs of separators collapsed to one and none at the start."""
    c = classes[points]
    keep = c != 0
    keep[1:] |= c[:-1] != 0
    return c[keep]


def suffix_automaton(seq: np.ndarray) -> list[dict[int, int]]:
    """Transitions {class: state} of every state; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in seq.tolist():
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def interleave(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of every row, cells) of sparse rows over ``width`` classes: rows of several entries,
    the longest first, go to the next place where all their cells are free; rows of one entry
    fill most of the cells that are left. No two rows have one place, but rows without entries
    share the last one, which no cell names."""
    size = 2 * width + 2 * sum(map(len, rows)) + 1024
    owner = np.full(size, -1, np.int64)   # row of each cell
    taken = np.zeros(size, bool)          # places of rows
    place = np.full(len(rows), -1, np.int64)
    low = width  # cells below are never used, so that no place is negative
    for i in sorted((i for i, r in enumerate(rows) if len(r) > 1), key=lambda i: -len(rows[i])):
        cs = np.array(sorted(rows[i]), np.int64)
        while owner[low] >= 0:
            low += 1
        at, look = low, 64
        while place[i] < 0:
            if at + look + width >= len(owner):
                owner = np.concatenate((owner, np.full(size, -1, np.int64)))
                taken = np.concatenate((taken, np.zeros(size, bool)))
            d = np.arange(at, at + look)[owner[at:at + look] < 0] - cs[0]
            fits = (owner[d[:, None] + cs] < 0).all(axis=1) & ~taken[d]
            if fits.any():
                place[i] = d[fits.argmax()]
            else:  # a crowded stretch: later rows need not look there
                at, low = at + look, at + look
        owner[place[i] + cs] = i
        taken[place[i]] = True
    singles = [(i, next(iter(r))) for i, r in enumerate(rows) if len(r) == 1]
    more = 4 * len(singles) + width
    owner = np.concatenate((owner, np.full(more, -1, np.int64)))
    taken = np.concatenate((taken, np.zeros(more, bool)))
    free = iter((width + np.flatnonzero(owner[width:] < 0)).tolist())
    used, left = taken.tolist(), deque(maxlen=16)  # free cells that did not suit an earlier row
    for i, c in singles:
        f = next((f for f in left if not used[f - c]), None)
        if f is not None:
            left.remove(f)
        else:
            f = next(free)
            while used[f - c]:
                left.append(f)
                f = next(free)
        place[i], owner[f], used[f - c] = f - c, i, True
    last = int(max(place.max(initial=0), np.flatnonzero(owner >= 0).max(initial=0))) + 1
    place[place < 0] = last
    cells = np.full(last + width, -1, np.int64)
    for i, r in enumerate(rows):
        for c, t in r.items():
            cells[place[i] + c] = (int(place[i]) << 32) + int(place[t])
    return place, cells


def build(samples: dict[str, list[str]]) -> Model:
    """Model of whole sample texts per language."""
    letter = letters()
    langs = sorted(x for x, texts in samples.items()
                   if any(c.isalpha() for t in texts for c in t))
    lowered = {lang: code_points("\n".join(samples[lang]).lower()) for lang in langs}
    seen = np.unique(np.concatenate([p[letter[p]] for p in lowered.values()])) if langs \
        else np.zeros(0, np.uint32)
    # a class per letter, one for letters never seen
    of_low = np.full(0x110000, len(seen) + 1, np.int32)
    of_low[seen] = np.arange(1, len(seen) + 1)
    every = np.flatnonzero(letter)
    low = np.fromiter((ord(chr(i).lower()[0]) for i in every.tolist()), np.int64, len(every))
    classes = np.zeros(0x110000, np.int32)
    classes[every] = of_low[low]
    width = len(seen) + 2
    rows: list[dict[int, int]] = []
    opening = np.zeros((len(langs), width), np.int64)
    for k, lang in enumerate(langs):
        at = len(rows)
        nxt = suffix_automaton(sequence(lowered[lang], classes))
        # state 0, the root, is never looked up: it stands for the state after an unseen
        # character, where any character opens a phrase
        opening[k] = at
        for c, t in nxt[0].items():
            opening[k, c] = at + t
        rows.append({})
        rows += [{c: at + t for c, t in r.items()} for r in nxt[1:]]
    place, cells = interleave(rows, width)
    return Model(langs, classes, letter, place[opening] if langs else opening, cells)


def passage(text: Column, limit: int) -> Column:
    """The text if it has at most ``limit`` characters, otherwise its first paragraphs that fit (the
    first words, or characters, where no paragraph ends in time)."""
    head = F.substring(text, 1, limit)
    line = F.length(head) - F.instr(F.reverse(head), "\n") + 1
    word = F.length(head) - F.instr(F.reverse(head), " ") + 1
    end = F.when(F.instr(head, "\n") > 1, line).when(F.instr(head, " ") > 1, word).otherwise(F.lit(limit))
    return F.when(F.length(text) <= limit, text).otherwise(F.substring(head, F.lit(1), end))


def _smallest(rows: DataFrame, n: int) -> dict[str, list[tuple[bool, int]]]:
    """Per language the (long, hash) pairs of its ``n`` first texts, fitting ones before long
    ones and by hash within them. Hashes are spread evenly, so a threshold for about ``MARGIN``
    times ``n`` of them comes from the counted distinct hashes; only what lies below is grouped
    (pre-aggregated in each task) and looked at, again with a higher threshold where too few do."""
    first: dict[tuple, float] = {}
    for r in rows.groupBy("lang", "long").agg(F.approx_count_distinct("h").alias("d")).collect():
        first[r["lang"], r["long"]] = min(1.0, MARGIN * n / max(r["d"], 1))
    found: dict[tuple, list[int]] = {}
    todo = dict(first)
    while todo:
        share = F.create_map(*[F.lit(x) for key, t in todo.items() for x in (f"{int(key[1])}{key[0]}", t)])
        limit = F.try_element_at(share, F.concat(F.col("long").cast("int").cast("string"), F.col("lang")))
        below = rows.where((F.col("h").cast("double") + 2.0 ** 63) / 2.0 ** 64 <= limit)
        got: dict[tuple, list[int]] = {}
        # a few times n hashes a language
        for r in below.groupBy("lang", "long", "h").agg(F.count(F.lit(1)).alias("c")).collect():
            got.setdefault((r["lang"], r["long"]), []).append(r["h"])
        again = {}
        for key, t in todo.items():
            found[key] = sorted(got.get(key, []))[:n]
            if len(found[key]) < n and t < 1.0:
                again[key] = min(1.0, 8 * t)
        todo = again
    out: dict[str, list[tuple[bool, int]]] = {}
    for lang, long in sorted(found, key=lambda k: (k[0], k[1])):
        out.setdefault(lang, []).extend((long, h) for h in found[lang, long])
    return {lang: pairs[:n] for lang, pairs in out.items()}


def fit(docs: DataFrame, train: Column, lang: str = "lang", text: str = "text",
        id_col: str = "doc_id", sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learn from the rows where ``train`` holds and the label is known. The sample is at most
    ``SAMPLE_TEXTS`` texts and ``sample_chars`` characters per language, in the order of a hash
    of the text (equal texts count once); texts longer than that come after all others, as
    passages."""
    rows = (docs.where(train & F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) > 0))
            .select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
                    (F.length(text) > sample_chars).alias("long"), F.xxhash64(F.col(text)).alias("h")))
    # hashes first: the texts of the chosen few are fetched by a second, filtered scan
    chosen = [(x, long, h) for x, pairs in _smallest(rows.select("lang", "long", "h"), SAMPLE_TEXTS).items()
              for long, h in pairs]
    few = docs.sparkSession.createDataFrame(chosen, "lang string, long boolean, h bigint")
    picked = (rows.join(F.broadcast(few), ["lang", "long", "h"])  # SAMPLE_TEXTS a language at most
              .select("lang", "long", "h", passage(F.col("text"), sample_chars).alias("text"))
              .groupBy("lang", "long", "h").agg(F.min("text").alias("text")).collect())
    samples: dict[str, list[str]] = {}
    left: dict[str, int] = {}
    for r in sorted(picked, key=lambda r: (r["lang"], r["long"], r["h"])):
        room = left.setdefault(r["lang"], sample_chars)
        if len(r["text"]) <= room:
            samples.setdefault(r["lang"], []).append(r["text"])
            left[r["lang"]] = room - len(r["text"])
    return build(samples)


def phrases(model: Model, texts: list[str | None], block: int = BLOCK) -> tuple:
    """(phrases per text and language, characters parsed, has a letter) of a chunk."""
    n, k = len(texts), len(model.langs)
    counts = np.zeros((n, k), np.int64)
    chars = np.zeros(n, np.int64)
    has = np.zeros(n, bool)
    lanes: list[np.ndarray] = []
    owner: list[int] = []
    for i, t in enumerate(texts):
        if not t:
            continue
        points = code_points(t)
        has[i] = bool(model.letter[points].any())
        if not has[i]:
            continue
        seq = sequence(points, model.classes)
        chars[i] = len(seq)
        for at in range(0, len(seq), block):
            lanes.append(seq[at:at + block])
            owner.append(i)
    if not lanes or not k:
        return counts, chars, has
    lens = np.array([len(x) for x in lanes])
    order = np.argsort(-lens, kind="stable")
    lens = lens[order]
    grid = np.zeros((len(lanes), int(lens[0])), np.int32)
    for row, j in enumerate(order.tolist()):
        grid[row, :lens[row]] = lanes[j]
    grid = np.ascontiguousarray(grid.T)
    active = len(lens) - np.searchsorted(lens[::-1], np.arange(grid.shape[0]), side="right")
    state = model.opening[:, grid[0]]  # a lane's first character opens its first phrase
    found = np.ones((k, len(lens)), np.int64)
    for step in range(1, grid.shape[0]):
        a = int(active[step])
        c, now = grid[step, :a], state[:, :a]
        cell = model.cells[now + c]
        on = (cell >> 32) == now
        found[:, :a] += ~on
        state[:, :a] = np.where(on, cell & 0xFFFFFFFF, model.opening[:, c])
    np.add.at(counts, np.array(owner)[order], found.T)
    return counts, chars, has


def predict(model: Model, texts: list[str | None], block: int = BLOCK) -> tuple[list, list]:
    counts, chars, has = phrases(model, texts, block)
    if not model.langs:
        return ["und"] * len(texts), [0.0] * len(texts)
    h = counts / np.maximum(chars, 1)[:, None]
    best = h.argmin(axis=1)
    low = np.sort(h, axis=1)
    second = low[:, 1] if low.shape[1] > 1 else np.full(len(texts), np.inf)
    score = np.where(np.isinf(second), 1.0, second / np.maximum(low[:, 0] + second, 1e-12))
    langs = [model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), has.tolist())]
    return langs, np.where(has, score, 0.0).tolist()


def identify(docs: DataFrame, model: Model, text: str = "text",
             carry: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """The ``carry`` columns (default: all) plus lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(col: pa.Array) -> list:
        return list(predict(shared.value, col.to_pylist(), block))
    carry = list(docs.columns) if carry is None else carry
    return map_texts(docs, text, carry, [("lang_pred", "string"), ("score", "double")], fn)
