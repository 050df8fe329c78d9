"""Prompt construction (C): column expressions evaluated per row, no shuffles."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustq.functions.bind import bind, bind2

# fixed values
AP_TEMPLATE = "<s> {sentence_A} [P] [T] {sentence_B} </s>"
SLOT = "[T]"
PREDICT = "[P]"
MASK = "<mask>"
MP_TEMPLATE = '{"placeholder":"text_b"}T0 T1 {"mask"}T2 {"placeholder":"text_a"}'
MP_TOKENS = ["?", "|", ","]
MP_LABEL_WORDS = ["yes", "no", "maybe"]  # entailment, contradiction, neutral


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.lit(x)


def expand_slots(template, n) -> Column:
    """Replace the ``[T]`` slot by ``n`` space-separated ``[T]`` slots."""
    return F.replace(_c(template), F.lit(SLOT),
                     F.array_join(F.array_repeat(F.lit(SLOT), _c(n).cast("int")), " "))


def _interleave(parts: Column, values: Column, missing) -> Column:
    """parts[0] values[0] parts[1] values[1] ... parts[n]: the literal parts of a template around
    its values; ``missing`` where there are fewer values than gaps. Both arrays are bound."""
    def fill(ps: Column, vs: Column) -> Column:
        n = F.size(ps)
        return F.array_join(F.transform(ps, lambda p, i: F.concat(p, F.when(
            i < n - 1, F.coalesce(F.get(vs, i), F.lit(missing))).otherwise(F.lit("")))), "")
    return bind2(parts, values, fill)


def fill_slots(template, tokens) -> Column:
    """Fill ``[T]`` slots left to right with ``tokens``; surplus tokens are ignored,
    surplus slots stay ``[T]``. Tokens are inserted literally (never re-scanned)."""
    return _interleave(F.split(_c(template), re.escape(SLOT), -1), _c(tokens), SLOT)


def fill_prompt(template, tokens) -> Column:
    """C1 as used by the AP experiments: expand the slot to len(tokens), then fill."""
    return bind(_c(tokens), lambda t: fill_slots(expand_slots(template, F.size(t)), t))


def render_pairs(df: DataFrame, template: str, fields: dict[str, str] | None = None,
                 out: str = "rendered") -> DataFrame:
    """Substitute ``{field}`` names of ``template`` with row columns (label excluded).
    The template is cut into literal parts on the driver once; values are concatenated,
    never re-parsed, so braces inside data are safe."""
    fields = fields or {"sentence_A": "sentence_a", "sentence_B": "sentence_b"}
    pieces = re.split(r"(\{[^{}]+\})", template)
    cols = []
    for p in pieces:
        if p.startswith("{") and p.endswith("}") and p[1:-1] in fields:
            cols.append(F.coalesce(F.col(fields[p[1:-1]]), F.lit("")))
        elif p:
            cols.append(F.lit(p))
    return df.withColumn(out, F.concat(*cols))


def manual_template(tokens, template: str = MP_TEMPLATE) -> Column:
    """C3 (first half): replace T0, T1, ... by the prompt tokens (every occurrence, in
    index order)."""
    t = F.lit(template)
    n = len(re.findall(r"T\d", template))
    for i in range(n):
        t = F.replace(t, F.lit(f"T{i}"), F.coalesce(F.try_element_at(_c(tokens), F.lit(i + 1)), F.lit("")))
    return t


def render_manual(filled_template, text_a: str = "sentence_a", text_b: str = "sentence_b") -> Column:
    """C3 (second half): placeholders -> text_b, mask, text_a (hypothesis first)."""
    parts = F.split(_c(filled_template), r'\{"placeholder":"text_b"\}|\{"mask"\}|\{"placeholder":"text_a"\}', -1)
    kinds = F.regexp_extract_all(_c(filled_template),
                                 F.lit(r'\{"(?:placeholder":"(text_[ab])"|(mask)")\}'), 0)
    val = F.transform(kinds, lambda k: F.when(k.contains("text_b"), F.col(text_b))
                      .when(k.contains("text_a"), F.col(text_a)).otherwise(F.lit(MASK)))
    return _interleave(parts, val, "")


def render_fields(template, fields: dict[str, str]) -> Column:
    """C2 with a per-row template column: ``{name}`` placeholders -> row columns. The
    template is cut on the placeholders and the values are concatenated (never re-scanned)."""
    alt = "|".join(re.escape("{" + k + "}") for k in fields)
    t = _c(template)
    parts = F.split(t, alt, -1)
    kinds = F.regexp_extract_all(t, F.lit("(" + alt + ")"), 1)
    val = F.transform(kinds, lambda k: F.coalesce(*[F.when(k == "{" + name + "}", F.col(c)) for name, c in fields.items()],
                                                  F.lit("")))
    return _interleave(parts, val, "")
