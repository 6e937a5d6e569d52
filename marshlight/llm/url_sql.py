"""The URL verdicts of ``url_filter`` as one SQL text."""

from __future__ import annotations

from .url_filter import BINS, END, FLAT, LOWER, START, UPPER, Rule


def _rules(rules: list[Rule], what: str) -> str:
    cases = []
    for r in sorted(rules, key=lambda r: (len(r.text), r.text), reverse=True):
        value = r.text if what == "rule" else r.verdict
        cases.append(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{value}'")
    return f"CASE {' '.join(cases)} END"


def verdict_sql(rules: list[Rule], order: int, limit: int) -> str:
    smooth = lambda n, t, d, p: f"CASE WHEN {t} + {d} > 0 THEN ({n} + {d} * {p}) / ({t} + {d}) ELSE {p} END"
    levels = [f"l0 AS (SELECT gram, {smooth('na', 'ta', 'da', FLAT)} AS pa, {smooth('nb', 'tb', 'db', FLAT)} AS pb FROM kept JOIN st ON st.ctx = kept.ctx WHERE k = 0)"]
    for k in range(1, order + 1):
        levels.append(
            f"l{k} AS (SELECT kept.gram, {smooth('na', 'ta', 'da', 's.pa')} AS pa, {smooth('nb', 'tb', 'db', 's.pb')} AS pb "
            f"FROM kept JOIN st ON st.ctx = kept.ctx JOIN l{k - 1} s ON s.gram = substr(kept.gram, 2) WHERE k = {k})"
        )
    joins, a, b = "", f"{FLAT}", f"{FLAT}"
    for k in range(order + 1):
        gram = f"CASE WHEN i > {k} THEN substr(s, i - {k}, {k + 1}) END"
        joins += f" LEFT JOIN l{k} n{k} ON n{k}.gram = {gram} LEFT JOIN esc e{k} ON length(e{k}.ctx) = {k} AND e{k}.ctx = left({gram}, {k})"
        a, b = f"coalesce(n{k}.pa, coalesce(e{k}.ea, 1e0) * {a})", f"coalesce(n{k}.pb, coalesce(e{k}.eb, 1e0) * {b})"
    return f"""
    WITH p AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT row_number() OVER () AS rid, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
    w AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN left(url, strpos(url, '://') + 2) || host || substr(url, strpos(url, '://') + 3 + length(host)) ELSE url END AS whole FROM h),
    u AS (SELECT *, {_rules(rules, 'rule')} AS rule, {_rules(rules, 'verdict')} AS ruled, substr(md5(whole), 1, 1) IN ('0', '1', '2') AS asks,
                 chr({ord(START)}) || whole || chr({ord(END)}) AS s FROM w),
    pos AS (SELECT rid, ruled, asks, s, unnest(range(2, length(s) + 1)) AS i FROM u),
    cnt AS (SELECT gram, count(*) FILTER (ruled = 'allow') AS na, count(*) FILTER (ruled = 'block') AS nb
            FROM (SELECT ruled, substr(s, i - k, k + 1) AS gram FROM pos, range(0, {order + 1}) AS o(k) WHERE i > k AND ruled IS NOT NULL AND NOT asks) GROUP BY gram),
    tot AS (SELECT coalesce(sum(na), 0) AS all_a, coalesce(sum(nb), 0) AS all_b FROM cnt WHERE length(gram) = 1),
    kept AS (SELECT *, length(gram) - 1 AS k, left(gram, length(gram) - 1) AS ctx FROM cnt, tot WHERE na >= greatest(1, ceil(2 * tot.all_a / {limit})) OR nb >= greatest(1, ceil(2 * tot.all_b / {limit}))),
    st AS (SELECT ctx, sum(na) AS ta, count(*) FILTER (na > 0) AS da, sum(nb) AS tb, count(*) FILTER (nb > 0) AS db FROM kept GROUP BY ctx),
    esc AS (SELECT ctx, CASE WHEN ta > 0 THEN da / (ta + da) ELSE 1e0 END AS ea, CASE WHEN tb > 0 THEN db / (tb + db) ELSE 1e0 END AS eb FROM st),
    {', '.join(levels)},
    sc AS (SELECT rid, avg(ln({a}) - ln({b})) AS score FROM pos{joins} GROUP BY rid),
    lab AS (SELECT greatest(-10 * {BINS}, least(10 * {BINS}, floor(score * {BINS}))) AS bin, ruled FROM sc JOIN u ON u.rid = sc.rid WHERE ruled IS NOT NULL AND asks),
    both_ AS (SELECT count(*) FILTER (ruled = 'allow') AS ta, count(*) FILTER (ruled = 'block') AS tb FROM lab),
    cand AS (SELECT bin AS b FROM lab UNION SELECT bin + 1 FROM lab UNION SELECT 0),
    gain AS (SELECT b, round(count(*) FILTER (ruled = 'block' AND bin < b) / any_value(tb) - count(*) FILTER (ruled = 'allow' AND bin < b) / any_value(ta), 12) AS g
             FROM cand, lab, both_ WHERE ta > 0 AND tb > 0 GROUP BY b UNION ALL SELECT 0, 0),
    best AS (SELECT b / {BINS} AS t FROM gain ORDER BY g DESC, abs(b), b DESC LIMIT 1)
    SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= t THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) + 0e0 AS score
    FROM u JOIN sc ON sc.rid = u.rid, best
    """
