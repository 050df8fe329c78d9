"""Column expressions for whitespace words and lines.

Fixed values (must agree with the DuckDB twins used by the oracle): the word separator is
the explicit class ``[ \\t\\n\\r]+`` (not ``\\s``, whose Unicode reach differs between
engines), empty pieces are dropped, and lines split on ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values
WORD_SPLIT = r"[ \t\n\r]+"
LINE_SPLIT = "\n"

# SQL twins (DuckDB dialect), ``{x}`` is the argument expression
SQL_WORDS = "list_filter(regexp_split_to_array({x}, '[ \\t\\n\\r]+'), lambda w: w <> '')"
SQL_LINES = "string_split({x}, chr(10))"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(c) -> Column:
    """Whitespace tokens of a string column, empties dropped (array<string>)."""
    return F.filter(F.split(_col(c), WORD_SPLIT), lambda w: w != "")


def split_pieces(c) -> Column:
    """Raw split on the word separator; may contain '' pieces (at a leading separator).
    ``explode(split_pieces(x))`` followed by a ``!= ''`` filter yields exactly the words of
    ``words(x)`` and is cheaper than filtering inside a lambda before the explode."""
    return F.split(_col(c), WORD_SPLIT)


def normalize(c) -> Column:
    """Words joined by single spaces: only separators other than one space are rewritten."""
    return F.btrim(F.regexp_replace(_col(c), r"[\t\n\r][ \t\n\r]*| [ \t\n\r]+", " "), F.lit(" "))


def line(c, n: int) -> Column:
    """1-based line ``n`` of a text, or NULL when the text has fewer lines.

    Splits with a limit of ``n + 1`` so only the head of the text is cut into pieces; the
    rest of the text stays one piece (no work proportional to the document length)."""
    return F.get(F.split(_col(c), LINE_SPLIT, n + 1), n - 1)


def sql_words(x: str) -> str:
    return SQL_WORDS.format(x=x)


def sql_normalize(x: str) -> str:
    return f"array_to_string({sql_words(x)}, ' ')"


def sql_line(x: str, n: int) -> str:
    return f"{SQL_LINES.format(x=x)}[{n}]"
