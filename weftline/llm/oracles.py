"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op4_top_k"] = """
WITH bits AS (
  SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS b FROM embeddings
), codes AS (
  SELECT vec_id, list_reduce(list_transform(range(1, 33), lambda i: CASE WHEN b[i] = '1' THEN 1::BIGINT << (i - 1)::INT ELSE 0 END), lambda x, y: x + y) AS lo,
         list_reduce(list_transform(range(33, 65), lambda i: CASE WHEN b[i] = '1' THEN 1::BIGINT << (i - 33)::INT ELSE 0 END), lambda x, y: x + y) AS hi
  FROM bits
), ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id AS id, (bit_count(xor(q.lo, c.lo)) + bit_count(xor(q.hi, c.hi)))::BIGINT AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.lo, c.lo)) + bit_count(xor(q.hi, c.hi)), c.vec_id) AS rank
  FROM codes q JOIN codes c ON q.vec_id % 50 = 0
)
SELECT query_id, rank::INTEGER AS rank, id, distance FROM ranked WHERE rank <= 10
"""

_METRICS = {"symbols": ("1000 * n_symbols // greatest(n_words, 1)", 1000, 20), "dup_lines": ("1000 * n_dup_lines // greatest(n_lines, 1)", 1000, 60), "repeats": ("1000 * n_repeat_words // greatest(n_words, 1)", 1000, 60), "word_len": ("10 * word_chars // greatest(n_words, 1)", 400, 10)}
_LEVELS = (("s", "lang, source"), ("l", "lang"), ("c", "1 + 1"))


def _fence(metric: str, level: str, by: str) -> str:
    floor = _METRICS[metric][2]
    return f"""fence_{metric}_{level} AS (
      SELECT {by if level != 'c' else '0 AS one'}, max(total) AS total,
        min(bin) FILTER (2 * rn >= total) + 5 * greatest(min(bin) FILTER (4 * rn >= 3 * total) - min(bin) FILTER (2 * rn >= total), {floor}) AS fence
      FROM (SELECT lang, source, {metric} AS bin, row_number() OVER (PARTITION BY {by} ORDER BY {metric}) AS rn, count(*) OVER (PARTITION BY {by}) AS total FROM binned WHERE NOT base_failed)
      GROUP BY {by if level != 'c' else 'one'})"""


def _quality_sql() -> str:
    fences = ",\n".join(_fence(m, level, by) for m in _METRICS for level, by in _LEVELS)
    joins, tests = [], []
    for m in _METRICS:
        s, lang, c = (f"fence_{m}_{level}" for level in "slc")
        joins.append(
            f"LEFT JOIN {s} ON b.lang IS NOT DISTINCT FROM {s}.lang AND b.source IS NOT DISTINCT FROM {s}.source LEFT JOIN {lang} ON b.lang IS NOT DISTINCT FROM {lang}.lang LEFT JOIN {c} ON true"
        )
        tests.append(f"coalesce({m} <= CASE WHEN {s}.total >= 200 THEN {s}.fence WHEN {lang}.total >= 200 THEN {lang}.fence ELSE {c}.fence END, true)")
    bins = ", ".join(f"least({e}, {top}) AS {m}" for m, (e, top, _) in _METRICS.items())
    return f"""
    WITH split AS (
      SELECT doc_id, lang, source, coalesce(text, '') AS text,
        list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
      FROM documents
    ), windows AS (
      SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM split)
    ), twice AS (
      SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
    ), repeats AS (
      SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY 1
    ), counted AS (
      SELECT s.doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
      FROM split s LEFT JOIN repeats r ON s.doc_id = r.doc_id
    ), binned AS (
      SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {bins} FROM counted
    ), {fences}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept
    FROM binned b {' '.join(joins)}"""


ORACLES["op7_quality_rules"] = _quality_sql()

ORACLES["op12_gap_sessions"] = """
WITH RECURSIVE base AS (
  SELECT click_id, client_id, epoch_us(ts) AS us, epoch_us(arrived_at) - epoch_us(ts) > 900000000 AS late,
    coalesce(floor(100 * value + 0.5), 0)::BIGINT AS cents, coalesce(value >= 60 AND kind IN ('purchase', 'signup'), false) AS final
  FROM (SELECT *, row_number() OVER (PARTITION BY click_id ORDER BY ts, client_id, arrived_at, value) AS rn FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL) WHERE rn = 1
), timely AS (
  SELECT *, row_number() OVER w AS i, coalesce(lag(final) OVER w OR us - lag(us) OVER w >= 900000000, true) AS broken FROM base WHERE NOT coalesce(late, false) WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)
), runs AS (
  SELECT *, sum(broken::BIGINT) OVER (PARTITION BY client_id ORDER BY i) AS run FROM timely
), jumps AS (
  SELECT a.client_id, a.i, min(b.i) AS j FROM runs a JOIN runs b ON a.client_id = b.client_id AND a.run = b.run AND a.us + 3600000000 < b.us GROUP BY ALL
), starts AS (
  SELECT client_id, i FROM runs WHERE broken
  UNION
  SELECT s.client_id, j.j FROM starts s JOIN jumps j ON s.client_id = j.client_id AND s.i = j.i
), held AS (
  SELECT r.*, max(s.i) OVER (PARTITION BY r.client_id ORDER BY r.i) AS s, lead(r.us) OVER (PARTITION BY r.client_id ORDER BY r.i) AS next_us
  FROM runs r LEFT JOIN starts s ON r.client_id = s.client_id AND r.i = s.i
), found AS (
  SELECT client_id, s, min_by(click_id, i) AS session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks, sum(cents)::BIGINT AS value_cents,
    CASE WHEN max_by(final, i) THEN 'end' WHEN max(next_us) IS NULL OR max_by(coalesce(next_us, -1), i) = -1 THEN 'none' WHEN max_by(next_us, i) - max(us) >= 900000000 THEN 'gap' ELSE 'length' END AS closed_by,
    sha256(string_agg(click_id::VARCHAR, ',' ORDER BY i)) AS path_sha256
  FROM held GROUP BY client_id, s
), spans AS (
  SELECT *, lead(start_us) OVER (PARTITION BY client_id ORDER BY s) AS until FROM found
)
SELECT f.client_id, session_id, start_us, end_us, n_clicks, count(b.us) AS n_late, value_cents, closed_by, path_sha256
FROM spans f LEFT JOIN (SELECT client_id, us FROM base WHERE late) b ON b.client_id = f.client_id AND b.us >= f.start_us AND (f.until IS NULL OR b.us < f.until)
GROUP BY ALL
"""
