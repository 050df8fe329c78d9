"""DuckDB twins of the fixture views, as CTE snippets.

The oracle registers only base tables, so every oracle SQL text carries the CTEs it needs.
``with_views(["v1"], "SELECT ...")`` prepends the named views and their dependencies.
"""

from __future__ import annotations

from robustq.functions.hashing import sql_hkey, sql_hnum
from robustq.functions.text import sql_normalize, sql_words

_W_AB = sql_words("sentence_a || ' ' || sentence_b")

# name -> (dependencies, body)
VIEWS: dict[str, tuple[list[str], str]] = {
    "labels_c": ([], """
        SELECT * FROM (VALUES ('entailment', 0), ('contradiction', 1), ('neutral', 2))
            AS t(label, class_id)"""),
    "seeds": ([], "SELECT CAST(unnest(range(4)) AS INTEGER) AS seed"),
    "v1l": ([], f"""
        SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
                 lambda ln: {sql_normalize('ln')}), lambda ln: ln <> '') AS lines
        FROM documents"""),
    "v1a": (["v1l"], """
        SELECT doc_id || ':' || i AS ex_id, lines[i + 1] AS sentence_a, lines[i + 2] AS sentence_b, label
        FROM (SELECT d.doc_id, d.lines, unnest(range(len(d.lines) - 1)) AS i,
                     CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.toxic = 1 THEN 'contradiction'
                          WHEN l.quality = 1 THEN 'entailment' ELSE 'neutral' END AS label
              FROM v1l d LEFT JOIN labels l ON d.doc_id = l.doc_id) t"""),
    "v1": (["v1a"], "SELECT * FROM v1a WHERE label IS NOT NULL"),
    "v1t": ([], f"SELECT doc_id AS ex_id, {sql_normalize("coalesce(text, '')")} AS text FROM documents"),
    "v2c": ([], f"SELECT conv_id, turn, role, {sql_normalize('text')} AS text FROM conversations"),
    "v2e": (["v2c"], """
        SELECT u.conv_id, u.turn, u.text AS sentence_a, a.text AS sentence_b
        FROM v2c u JOIN v2c a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'"""),
    "v2n": (["v2c"], """
        SELECT conv_id, turn, sentence_a, sentence_b FROM (
          SELECT conv_id, turn, text AS sentence_a,
                 lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS sentence_b,
                 lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nt
          FROM v2c WHERE role = 'user') t
        WHERE nt IS NOT NULL"""),
    "v2f": (["v2e"], """
        SELECT conv_id, min(turn) AS turn, arg_min(sentence_a, turn) AS sentence_a,
               arg_min(sentence_b, turn) AS reply
        FROM v2e GROUP BY conv_id"""),
    "v2x": (["v2f"], """
        SELECT conv_id, turn, sentence_a, sentence_b FROM (
          SELECT conv_id, turn, sentence_a,
                 lead(reply) OVER (ORDER BY conv_id) AS sentence_b,
                 lead(conv_id) OVER (ORDER BY conv_id) AS nc
          FROM v2f) t
        WHERE nc IS NOT NULL"""),
    "v2": (["v2e", "v2n", "v2x"], """
        SELECT conv_id || ':' || turn || ':1' AS ex_id, sentence_a, sentence_b,
               'entailment' AS label FROM v2e
        UNION ALL SELECT conv_id || ':' || turn || ':2', sentence_a, sentence_b, 'neutral'
        FROM v2n
        UNION ALL SELECT conv_id || ':' || turn || ':3', sentence_a, sentence_b,
               'contradiction' FROM v2x"""),
    "v3": ([], """
        SELECT c.c_name AS sub_label, n.n_name AS obj_label, o.o_orderkey AS ev_id,
               n.n_name AS obj_surface,
               '[MASK] order ' || CAST(o.o_orderkey AS VARCHAR) || ' ' || o.o_orderpriority
                 || ' ' || o.o_orderstatus AS masked_sentence
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
        JOIN orders o ON o.o_custkey = c.c_custkey"""),
    "wc": ([], f"""
        SELECT token, count(*) AS freq
        FROM (SELECT unnest({sql_words('text')}) AS token FROM documents) t
        GROUP BY token"""),
    "v4": (["wc"], """
        SELECT token, CAST(4 + row_number() OVER (ORDER BY freq DESC, token) AS BIGINT)
               AS token_id, freq FROM wc"""),
    "v5t": (["wc", "seeds"], f"""
        SELECT seed, list(token ORDER BY h) AS tokens FROM (
          SELECT seed, token, h, row_number() OVER (PARTITION BY seed ORDER BY h) AS rn
          FROM (SELECT s.seed, t.token, {sql_hkey('s.seed', 't.token')} AS h
                FROM (SELECT token FROM wc ORDER BY freq DESC, token LIMIT 500) t
                CROSS JOIN seeds s) x) y
        WHERE rn <= 10 GROUP BY seed"""),
    "v5l": (["v1", "labels_c"], f"""
        SELECT label, CAST(rn - 1 AS INTEGER) AS pos, token FROM (
          SELECT label, token, cnt,
                 row_number() OVER (PARTITION BY label ORDER BY cnt DESC, token) AS rn
          FROM (
            SELECT token, label, cnt FROM (
              SELECT lw.*, row_number() OVER (PARTITION BY token
                                              ORDER BY cnt DESC, class_id) AS r
              FROM (SELECT label, token, count(*) AS cnt
                    FROM (SELECT label, unnest({_W_AB}) AS token FROM v1) a
                    GROUP BY label, token) lw
              JOIN labels_c USING (label)) b
            WHERE r = 1) c) d
        WHERE rn <= 10"""),
    "v7": ([], """
        SELECT user_id AS run,
               (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 10 AS epoch,
               row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step,
               value AS loss
        FROM events"""),
    "v8": ([], "SELECT vec_id, embedding, label FROM embeddings"),
}


def adversarial_sql(src: str) -> str:
    """V6 twin over a pairs CTE named ``src``."""
    wb = sql_words("sentence_b")
    return f"""
        SELECT 'original' AS set, ex_id, sentence_a, sentence_b, label FROM {src}
        UNION ALL
        SELECT 'no_change', ex_id, sentence_a,
               CASE WHEN len({wb}) >= 2 THEN array_to_string(
                 list_concat([{wb}[2], {wb}[1]], list_slice({wb}, 3, len({wb}))), ' ')
               ELSE sentence_b END, label FROM {src}
        UNION ALL
        SELECT 'change', ex_id, sentence_a, 'not ' || sentence_b,
               CASE WHEN label = 'entailment' THEN 'contradiction' ELSE 'entailment' END
        FROM {src}"""


VIEWS["v6"] = (["v1"], adversarial_sql("v1"))
VIEWS["v6t"] = (["v2"], adversarial_sql("v2"))


def register(name: str, deps: list[str], body: str) -> None:
    VIEWS[name] = (deps, body)


def with_views(names: list[str], final_sql: str, extra: list[tuple[str, str]] | None = None
               ) -> str:
    """Build ``WITH <views...>, <extra...> <final_sql>`` including dependencies in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in VIEWS[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({VIEWS[n][1]}\n)" for n in order]
    parts += [f"{n} AS ({body}\n)" for n, body in (extra or [])]
    if not parts:
        return final_sql
    return "WITH " + ",\n".join(parts) + "\n" + final_sql
