"""Fill-in-the-middle: documents cut at two token borders and reordered for infilling.

A text is a sequence of units (optional white space and a word, or trailing white space). One
full match of ``(unit)*`` by the ``regex`` library keeps every repetition of the group, so the
ends of its captures are all borders at once: their number is ``n``, and both cuts are looked up
in them. Only these three numbers are computed in Python (Arrow batches, row-local, no shuffle);
the draws, the form and the reordered text are column expressions.

Draws depend on ``seed`` and the id alone, so copies of a row are cut alike, and neither
partitioning nor a retried task changes a result.

Defined cases: a null text is an empty one; an empty text is plain with ``n`` 0; a text that
contains a sentinel is plain, because it could not be told from the markers; a null id draws like
the empty string; repeated rows give repeated rows; an empty table gives an empty one; extra
columns are carried (those with the name of a new one are replaced). Texts are matched whole,
one at a time; what a task holds grows with its longest text only.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustq.llm.common import row_slices

# fixed values of the contract
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
NEW = ("n", "form", "prefix_chars", "middle_chars", "output")

_UNITS = None


def unit_ends(text: str) -> list[int]:
    """Ends of all units of ``text`` in code points, by one full match. A unit never gives back
    what it took, so the repetition is possessive and keeps no backtracking states."""
    global _UNITS
    if _UNITS is None:
        import regex
        _UNITS = regex.compile(rf"({UNIT})*+")
    return _UNITS.fullmatch(text).ends(1)


def draws(id_col: str | Column, seed: int = 42) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of ``seed:id`` as unsigned integers."""
    c = F.col(f"`{id_col}`") if isinstance(id_col, str) else id_col
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(c.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def cut(docs: DataFrame, text: str = "text", id_col: str = "doc_id", seed: int = 42,
        carry: Sequence[str] | None = None) -> DataFrame:
    """The ``carry`` columns (default: all), the text (null: empty) as ``__text``, ``n``, and the
    two cuts in code points ``__a`` <= ``__b``."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("n", "__a", "__b")]
    h1, h2, _, _ = draws(id_col, seed)
    inp = docs.select(*[F.col(f"`{c}`") for c in carry],
                      F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"),
                      h1.alias("__h1"), h2.alias("__h2"))
    kept = inp.columns[:-2]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in inp.schema.fields[:-2]]
                       + ["n bigint", "__a bigint", "__b bigint"])

    def run(batches):
        for rb in row_slices(batches, "__text"):
            cols = [rb.column(i) for i in range(rb.num_columns)]
            out: list[tuple[int, int, int]] = []
            for t, a, b in zip(cols[-3], cols[-2].to_pylist(), cols[-1].to_pylist()):
                ends = unit_ends(t.as_py())
                n = len(ends)
                i, j = sorted((a % (n + 1), b % (n + 1)))
                out.append((n, ends[i - 1] if i else 0, ends[j - 1] if j else 0))
            new = [pa.array([r[k] for r in out], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(cols[:-2] + new, names=[*kept, "n", "__a", "__b"])

    return inp.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, text: str = "text", id_col: str = "doc_id", seed: int = 42,
                   plain_percent: int = 50, spm_percent: int = 80,
                   carry: Sequence[str] | None = None) -> DataFrame:
    """The ``carry`` columns (default: all) with ``n`` (units), ``form`` (plain, psm or spm),
    ``prefix_chars``, ``middle_chars`` (code points; null if plain) and ``output``.

    Prefix ends after the smaller of two drawn unit counts, middle after the larger. psm is
    ``<P>prefix<S>suffix<M>middle``, spm ``<S>suffix<P>prefix<M>middle``, plain the text."""
    names = [c for c in (docs.columns if carry is None else carry) if c not in NEW]
    # the id under a name of its own: the caller may not carry it
    d = docs.select("*", F.col(f"`{id_col}`").alias("__id"))
    d = cut(d, text, "__id", seed, [*names, "__id"])
    _, _, h3, h4 = draws("__id", seed)
    t, a, b = F.col("__text"), F.col("__a").cast("int"), F.col("__b").cast("int")
    marked = F.contains(t, F.lit(PREFIX)) | F.contains(t, F.lit(SUFFIX)) | F.contains(t, F.lit(MIDDLE))
    form = F.when((t == "") | marked | (h3 % 100 >= plain_percent), "plain") \
        .when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    d = d.withColumn("form", form)
    prefix = F.substring(t, F.lit(1), a)
    middle = F.substring(t, a + 1, b - a)
    suffix = F.substring(t, b + 1, F.length(t) - b)
    out = F.when(F.col("form") == "plain", t) \
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)) \
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    cut_up = F.col("form") != "plain"
    return d.select(*[F.col(f"`{c}`") for c in names], "n", "form",
                    F.when(cut_up, F.col("__a")).alias("prefix_chars"),
                    F.when(cut_up, F.col("__b") - F.col("__a")).alias("middle_chars"),
                    out.alias("output"))


def restore(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that ``output`` was made of. The pieces hold no sentinel, and a sentinel begins
    with ``<`` and ends with ``>``, so none can begin in a piece and end in a marker: the first
    three found are the markers."""
    o = F.col(output) if isinstance(output, str) else output
    f = F.col(form) if isinstance(form, str) else form
    parts = F.split(o, "|".join((PREFIX, SUFFIX, MIDDLE)), 4)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(f == "psm", psm).when(f == "spm", spm).otherwise(o)
