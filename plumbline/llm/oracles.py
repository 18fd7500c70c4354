"""Reference SQL (DuckDB) of the operators that SQL can express over whole tables."""

from __future__ import annotations

from plumbline.llm import quality_rules, secret_scan

_BLANK = r"\x20\x09-\x0D"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans(rank: int, rule: secret_scan.Rule) -> str:
    """Spans of one rule: gaps and matches alternate, so their running lengths are the places."""
    pattern = _quoted(rule.pattern)
    group = f"regexp_extract_all(t, {pattern}, {rule.group})"
    return f"""SELECT r, {rank} AS rank, {_quoted(rule.kind)} AS kind, e - n AS s, e FROM (
      SELECT r, v, length(m) AS n, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS e FROM (
        SELECT r, unnest(range(len(m))) AS i, unnest(g[1:len(m)]) AS g, unnest(m) AS m, unnest(v) AS v FROM (
          SELECT r, string_split_regex(t, {pattern}) AS g, regexp_extract_all(t, {pattern}) AS m, {group} AS v FROM d)))
      WHERE length(v) >= {rule.least}"""


def secrets_sql() -> str:
    parts = "\nUNION ALL ".join(_spans(rank, rule) for rank, rule in enumerate(secret_scan.RULES))
    base = len(secret_scan.BASE_RULES)
    written = "string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank)"
    counts = ", ".join(f"count(*) FILTER (kind = '{rule.kind}') AS n_{rule.kind}" for rule in secret_scan.BASE_RULES)
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), s AS ({parts})
    SELECT doc_id, {counts}, sha256(coalesce({written} FILTER (rank < {base}), '')) AS base_sha256, coalesce({written}, '') AS spans
    FROM d LEFT JOIN s USING (r) GROUP BY r, doc_id"""


def decontamination_sql(window: int = 10) -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    b AS (SELECT item_id::VARCHAR AS item, w, least({window}, len(w)) AS k FROM (SELECT item_id, {words} AS w FROM benchmark)),
    bw AS (SELECT DISTINCT item, k, w[a:a + k - 1] AS win FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS a FROM b WHERE k > 0)),
    dw AS (SELECT r, k, a, w[a:a + k - 1] AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM d, (SELECT DISTINCT k FROM bw))),
    hits AS (SELECT r, a, dw.k, item FROM dw JOIN bw USING (k, win)),
    places AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(a, a + k)) AS p FROM (SELECT DISTINCT r, a, k FROM hits)) GROUP BY r),
    found AS (SELECT r, count(item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
    FROM d LEFT JOIN places USING (r) LEFT JOIN found USING (r)"""


def quality_rules_sql(policy: str = "web-v1") -> str:
    bits = {
        "too_few_words": "n_words < 20",
        "repeated_windows": "100 * n_repeat_words > 30 * n_words",
        "symbols": "100 * n_symbols > 30 * n_words",
        "duplicate_lines": "2 * n_dup_lines > n_lines",
        "upper_case": "2 * n_upper > n_letters",
        "shouting": "100 * n_shouts > 30 * n_words",
        "stutter": "100 * n_stutters > 20 * n_words",
        "long_words": "word_chars > 15 * n_words",
        "short_words": "word_chars < 2 * n_words",
        "no_letters": "n_letters = 0",
    }
    failed = " + ".join(f"CASE WHEN {bits[rule.name]} THEN {1 << place} ELSE 0 END" for place, rule in enumerate(quality_rules.RULES))
    base = quality_rules.policy_mask(quality_rules.BASE)
    kept = quality_rules.policy_mask(quality_rules.POLICIES[policy])
    size = quality_rules.WINDOW
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    p AS (SELECT *, regexp_extract_all(t, '[^{_BLANK}]+') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^{_BLANK}]')) AS l, regexp_replace(t, '\\P{{L}}+', '', 'g') AS c FROM d),
    win AS (SELECT r, a, w[a:a + {size - 1}] AS win FROM (SELECT r, w, unnest(range(1, len(w) - {size - 2})) AS a FROM p)),
    twice AS (SELECT r, a FROM (SELECT r, a, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1),
    rep AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(a, a + {size})) AS q FROM twice) GROUP BY r),
    same AS (SELECT r, count(*) AS n FROM (SELECT r, unnest(w) AS x, unnest(w[2:]) AS y FROM p) WHERE x = y GROUP BY r),
    m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[{_BLANK}]+', '', 'g'))::BIGINT AS word_chars,
      (length(t) - length(regexp_replace(t, '[{quality_rules.SYMBOLS}]+', '', 'g')))::BIGINT AS n_symbols,
      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
      length(c) AS n_letters, length(c) - length(regexp_replace(c, '\\p{{Lu}}+', '', 'g')) AS n_upper,
      len(regexp_extract_all(t, '!!+')) AS n_shouts, coalesce(same.n, 0) AS n_stutters
      FROM p LEFT JOIN rep USING (r) LEFT JOIN same USING (r)),
    f AS (SELECT *, ({failed})::BIGINT AS failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & {base} <> 0 AS base_failed,
      failed & {kept} = 0 AS kept, failed FROM f"""


def filter_audit_sql() -> str:
    """Walks through every order, without the closed form that the operator uses for the sum over orders."""
    letters = "(VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) f(l, b)"
    order = ", ".join(f"(SELECT * FROM {letters}) f{k}" for k in range(5))
    once = " + ".join(f"(1 << f{k}.b)" for k in range(5)) + f" = {sum(1 << b for b in (1, 2, 4, 8, 16))}"
    return f"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
      regexp_extract_all(coalesce(text, ''), '[^{_BLANK}]+') AS w FROM documents),
    m AS (SELECT doc_id, part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
      + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS mask FROM w),
    l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
    c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
    o AS (SELECT [f0.l, f1.l, f2.l, f3.l, f4.l] AS l, [f0.b, f1.b, f2.b, f3.b, f4.b] AS b FROM {order} WHERE {once}),
    s AS (SELECT array_to_string(l, '') AS filter_order, i::INT AS step, l[i] AS letter, b[i]::INT AS bit, coalesce(list_sum(b[1:i - 1]), 0)::INT AS before
      FROM o, (SELECT unnest(range(1, 6)) AS i)),
    a AS (SELECT part, filter_order, step, letter,
      coalesce(sum(n) FILTER (mask & bit = 0 AND mask & before = 0), 0)::BIGINT AS kept,
      coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
      coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
      coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
      FROM c, s GROUP BY part, filter_order, step, letter)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
      (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM a"""


ORACLES = {
    "op2_secret_scan": secrets_sql(),
    "op3_decontamination": decontamination_sql(),
    "op6_quality_rules": quality_rules_sql(),
    "op12_filter_audit": filter_audit_sql(),
}
