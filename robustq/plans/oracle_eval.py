"""DuckDB twins of the experiment plans (variants, additive scorer, results).

Builders return ``(name, body)`` CTE pairs to pass as ``extra`` to
:func:`robustq.plans.oracle_views.with_views`.
"""

from __future__ import annotations

from robustq.functions.hashing import sql_hkey
from robustq.functions.text import sql_words
from robustq.operators.prompts import AP_TEMPLATE, MP_TEMPLATE, MP_TOKENS

K = 3  # classes
W_AB = sql_words("sentence_a || ' ' || sentence_b")


def _vid(exp: str = "exp_name") -> str:
    return (f"concat_ws(':', {exp}, CAST(seed AS VARCHAR), method, "
            "coalesce(CAST(rep AS VARCHAR), '-'), CAST(n_del AS VARCHAR), coalesce(del_idx, 'n/a'))")


def _finish(body: str, exp_name: str) -> str:
    return f"""SELECT seed, {_vid("'" + exp_name + "'")} AS variant_id, '{exp_name}' AS exp_name,
               method, CAST(rep AS INTEGER) AS rep, tokens, del_idx, CAST(n_del AS INTEGER) AS n_del
        FROM ({body}) q"""


def _drawn(key: str, n: str, rep: str = "rep") -> str:
    h = sql_hkey(key, rep, n, "p")
    return (f"list_slice(list_transform(list_sort(list_transform(range(len(tokens)), "
            f"lambda p: {{'h': {h}, 'p': p}})), lambda s: s.p), 1, {n})")


def deletion_variants(trig: str, exp_name: str = "ap-deletion") -> str:
    body = f"""
        SELECT seed, 'original' AS method, 0 AS rep, CAST(NULL AS VARCHAR) AS del_idx, 0 AS n_del, tokens
        FROM {trig}
        UNION ALL
        SELECT seed, 'single', 0, CAST(d AS VARCHAR), 1, list_filter(tokens, lambda t, i: i - 1 <> d)
        FROM (SELECT seed, tokens, unnest(range(len(tokens))) AS d FROM {trig}) e
        UNION ALL
        SELECT seed, 'multiple', rep, array_to_string(drawn, '-'), len(drawn),
               list_filter(tokens, lambda t, i: NOT list_contains(drawn, i - 1))
        FROM (SELECT seed, tokens, rep, n, {_drawn('seed', 'n')} AS drawn
              FROM {trig} CROSS JOIN (SELECT unnest(range(10)) AS rep) r
              CROSS JOIN (SELECT unnest([3, 5, 7]) AS n) ns) x"""
    return _finish(body, exp_name)


def _perm(key: str, rep: str = "rep") -> str:
    h = sql_hkey(key, rep, "p")
    return (f"list_transform(list_sort(list_transform(range(len(tokens)), "
            f"lambda p: {{'h': {h}, 'p': p}})), lambda s: tokens[s.p + 1])")


def reorder_variants(trig: str, exp_name: str = "ap-reordering") -> str:
    body = f"""
        SELECT seed, 'reorder' AS method, rep, CAST(NULL AS VARCHAR) AS del_idx, 0 AS n_del,
               {_perm('seed')} AS tokens
        FROM {trig} CROSS JOIN (SELECT unnest(range(10)) AS rep) r"""
    return _finish(body, exp_name)


def original_variants(trig: str, exp_name: str = "ap-original-acc") -> str:
    body = f"""SELECT seed, 'original' AS method, 0 AS rep, CAST(NULL AS VARCHAR) AS del_idx,
               0 AS n_del, tokens FROM {trig}"""
    return _finish(body, exp_name)


MP_LIST = "[" + ", ".join("'" + t + "'" for t in MP_TOKENS) + "]"


def mp_deletion_variants(trig: str, exp_name: str = "mp-deletion") -> str:
    n = len(MP_TOKENS)
    body = f"""
        SELECT seed, 'blank' AS method, 0 AS rep,
               array_to_string(list_filter(range({n}), lambda p: (m >> p) & 1 = 1), '-') AS del_idx,
               len(list_filter(range({n}), lambda p: (m >> p) & 1 = 1)) AS n_del,
               list_transform(range({n}), lambda p: CASE WHEN (m >> p) & 1 = 1 THEN ''
                                                        ELSE {MP_LIST}[p + 1] END) AS tokens
        FROM {trig} CROSS JOIN (SELECT unnest(range(1, {2 ** n})) AS m) b"""
    return _finish(body, exp_name)


def mp_original_variants(trig: str, exp_name: str) -> str:
    body = f"""SELECT seed, 'original' AS method, 0 AS rep, CAST(NULL AS VARCHAR) AS del_idx,
               0 AS n_del, {MP_LIST} AS tokens FROM {trig}"""
    return _finish(body, exp_name)


def mp_reorder_variants(trig: str, exp_name: str = "mp-reordering") -> str:
    import itertools
    perms = list(itertools.permutations(range(len(MP_TOKENS))))[1:]
    lit = "[" + ", ".join("[" + ", ".join(str(i) for i in p) + "]" for p in perms) + "]"
    body = f"""
        SELECT seed, 'permute' AS method, rep, CAST(NULL AS VARCHAR) AS del_idx, 0 AS n_del,
               list_transform(perm, lambda i: {MP_LIST}[i + 1]) AS tokens
        FROM {trig} CROSS JOIN (SELECT unnest({lit}) AS perm, generate_subscripts({lit}, 1) AS rep) p"""
    return _finish(body, exp_name)


def ap_template_sql(tokens: str = "v.tokens") -> str:
    expanded = (f"replace('{AP_TEMPLATE}', '[T]', array_to_string(list_transform(range(len({tokens})), "
                f"lambda x: '[T]'), ' '))")
    parts = f"string_split({expanded}, '[T]')"
    return (f"array_to_string(list_transform(range(1, len({parts}) + 1), lambda i: {parts}[i] || "
            f"CASE WHEN i < len({parts}) THEN coalesce({tokens}[i], '[T]') ELSE '' END), '')")


def mp_template_sql(tokens: str = "v.tokens") -> str:
    t = f"'{MP_TEMPLATE}'"
    for i in range(len(MP_TOKENS)):
        t = f"replace({t}, 'T{i}', coalesce({tokens}[{i + 1}], ''))"
    return t


def _w(c: str, i: int) -> str:
    return f"CAST(round(CAST(1000000 AS DOUBLE) * ln(({c} + 1) / (n{i} + nf))) AS BIGINT)"


def scorer(p: str, examples: str, variants: str, train: str | None = None,
           train_rows: int = 200, key: tuple[str, ...] = ("ex_id",), on: tuple[str, ...] = (),
           eps: bool = True) -> list[tuple[str, str]]:
    """Additive scorer CTEs ending in ``{p}_pr`` (variant_id, ex_id, gold, score, pred,
    correct) and ``{p}_acc`` (variant_id, acc, n_examples)."""
    train = train or examples
    cnt = ", ".join(f"sum(CASE WHEN cid = {i} THEN 1 ELSE 0 END) AS {c}{i}" for c in ("c",)
                    for i in range(K))
    tot = ", ".join(f"sum(CASE WHEN cid = {i} THEN 1 ELSE 0 END) AS n{i}" for i in range(K))
    s_sum = ", ".join(f"sum(CASE WHEN e.token IS NULL THEN 0 ELSE coalesce(w.w[{i + 1}], p.w0[{i + 1}]) END) AS s{i}"
                      for i in range(K))
    s_co = ", ".join(f"coalesce(x.s{i}, 0) AS s{i}" for i in range(K))
    t_sum = ", ".join(
        f"coalesce(sum(CASE WHEN x.token IS NULL OR x.token = '' THEN 0 "
        f"ELSE coalesce(w.w[{i + 1}], p.w0[{i + 1}]) * (x.n - x.i) END), 0) AS t{i}" for i in range(K))
    score = ", ".join(f"e.s{i} + t.t{i}" for i in range(K))
    ge = " + ".join(f"CAST(score[{i + 1}] >= score[gi] AS INTEGER)" for i in range(K))
    kl = ", ".join(key)
    ek = ", ".join(f"e.{c}" for c in key)
    vk = ", ".join(f"v.{c}" for c in key)
    xk = " AND ".join(f"x.{c} = v.{c}" for c in key)
    gon = "".join(f" AND v.{c} = e.{c}" for c in on)
    denom = "(count(*) + 1e-13)" if eps else "count(*)"
    return [
        (f"{p}_tr", f"""SELECT * FROM (
            SELECT s.seed, t.ex_id, t.label, t.sentence_a, t.sentence_b,
                   row_number() OVER (PARTITION BY s.seed ORDER BY {sql_hkey('s.seed', 't.ex_id')}, t.ex_id) AS rn
            FROM {train} t CROSS JOIN seeds s) x WHERE rn <= {train_rows}"""),
        (f"{p}_tw", f"""SELECT t.seed, c.class_id AS cid, unnest({W_AB}) AS token
            FROM {p}_tr t JOIN labels_c c ON c.label = t.label"""),
        (f"{p}_tot", f"SELECT seed, count(DISTINCT token) AS nf, {tot} FROM {p}_tw GROUP BY seed"),
        (f"{p}_pri", f"SELECT seed, [{', '.join(_w('0', i) for i in range(K))}] AS w0 FROM {p}_tot"),
        (f"{p}_wt", f"""SELECT c.seed, c.token, [{', '.join(_w('c' + str(i), i) for i in range(K))}] AS w
            FROM (SELECT seed, token, {cnt} FROM {p}_tw GROUP BY seed, token) c
            JOIN {p}_tot t ON t.seed = c.seed"""),
        (f"{p}_exw", f"SELECT {kl}, unnest({W_AB}) AS token FROM {examples}"),
        (f"{p}_exs", f"""SELECT s.seed, {ek}, {s_sum}
            FROM {p}_exw e CROSS JOIN seeds s JOIN {p}_pri p ON p.seed = s.seed
            LEFT JOIN {p}_wt w ON w.seed = s.seed AND w.token = e.token
            GROUP BY s.seed, {ek}"""),
        (f"{p}_es", f"""SELECT s.seed, {vk}, v.label AS gold, {s_co}
            FROM {examples} v CROSS JOIN seeds s
            LEFT JOIN {p}_exs x ON x.seed = s.seed AND {xk}"""),
        (f"{p}_vw", f"""SELECT variant_id, seed, len(tokens) AS n, unnest(tokens) AS token,
                   generate_subscripts(tokens, 1) - 1 AS i FROM {variants}"""),
        (f"{p}_vs", f"""SELECT v.variant_id, {t_sum}
            FROM {variants} v LEFT JOIN {p}_vw x ON x.variant_id = v.variant_id
            LEFT JOIN {p}_pri p ON p.seed = v.seed
            LEFT JOIN {p}_wt w ON w.seed = v.seed AND w.token = x.token
            GROUP BY v.variant_id"""),
        (f"{p}_g", f"""SELECT v.variant_id, v.seed, {ek}, e.gold, [{score}] AS score,
                   list_position(['entailment', 'contradiction', 'neutral'], e.gold) AS gi
            FROM {p}_es e JOIN {variants} v ON v.seed = e.seed{gon}
            JOIN {p}_vs t ON t.variant_id = v.variant_id"""),
        (f"{p}_pr", f"""SELECT variant_id, seed, {kl}, gold, score,
                   ['entailment', 'contradiction', 'neutral'][list_position(score, list_max(score))] AS pred,
                   coalesce(({ge}) <= 1, false) AS correct
            FROM {p}_g"""),
        (f"{p}_acc", f"""SELECT variant_id, round(sum(CAST(correct AS INTEGER)) / {denom}, 6) AS acc,
                   count(*) AS n_examples FROM {p}_pr GROUP BY variant_id"""),
    ]


def results(p: str, variants: str, task: str, family: str = "ap") -> tuple[str, str]:
    tmpl = mp_template_sql() if family == "mp" else ap_template_sql()
    return (f"{p}_res", f"""SELECT v.exp_name, '{task}' AS task, 'additive' AS model, v.seed,
               {tmpl} AS template, coalesce(a.acc, CAST(0 AS DOUBLE)) AS acc, v.del_idx, v.n_del,
               coalesce(a.n_examples, 0) AS n_examples
        FROM {variants} v LEFT JOIN {p}_acc a ON a.variant_id = v.variant_id""")


def experiment(p: str, examples: str, variants_body: str, task: str, family: str = "ap",
               train: str | None = None, key: tuple[str, ...] = ("ex_id",), on: tuple[str, ...] = (),
               eps: bool = True) -> list[tuple[str, str]]:
    """Variants + scorer + results CTEs; the results CTE is ``{p}_res``."""
    return [(f"{p}_v", variants_body), *scorer(p, examples, f"{p}_v", train, key=key, on=on, eps=eps),
            results(p, f"{p}_v", task, family)]
