"""The query catalogue in DuckDB SQL.  Every query may use the views of VIEWS."""

from __future__ import annotations

N = "(SELECT greatest(count(*), 1) AS n FROM supplier)"
TOKENS = "regexp_extract_all(lower({}), '[a-z]{{2,}}')"
COUNT = "CAST(len(regexp_extract_all({}, '[A-Za-z]{{2,}}')) AS BIGINT)"
BME = "({0} - CAST(greatest(isodow({0}) - 5, 0) AS INTEGER))"
MIN_NAMES = "(SELECT CASE WHEN count(*) >= 100 THEN 50 ELSE 5 END FROM supplier)"


def _lags(term: str, n: int = 6) -> str:
    """Bartlett-weighted sums of term(lag), doubled weights left to the caller."""
    return " + ".join(f"{1 - k / (n + 1)!r} * coalesce(sum({term.format(k=k)}), 0)" for k in range(1, n + 1))


VIEWS = f"""WITH filings AS (
  SELECT cik, 'T' || lpad(CAST(cik AS VARCHAR), 6, '0') AS ticker, CAST(doc_id AS VARCHAR) AS accession,
         make_date(k + 1993, 12, 31) AS report_date, make_date(k + 1994, 1 + doc_id * 7 % 12, 1 + doc_id * 13 % 28) AS filing_date, doc_id % 11 = 0 AS bad
  FROM (SELECT doc_id, doc_id % n AS cik, row_number() OVER (PARTITION BY doc_id % n ORDER BY doc_id) AS k FROM documents, {N})
), sections AS (
  SELECT CAST(doc_id AS VARCHAR) AS accession, unnest(['full', 'item1a', 'item7']) AS section,
         unnest([text, array_to_string(l[1:3], chr(10)), array_to_string(l[4:], chr(10))]) AS text
  FROM (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents)
), counts AS (
  SELECT cik, accession, bad, CASE WHEN NOT bad THEN {COUNT.format("max(text) FILTER (section = 'full')")} END AS n_words_full,
         CASE WHEN NOT bad THEN {COUNT.format("max(text) FILTER (section = 'item1a')")} END AS n_words_item1a,
         CASE WHEN NOT bad THEN {COUNT.format("max(text) FILTER (section = 'item7')")} END AS n_words_item7
  FROM filings JOIN sections USING (accession) GROUP BY cik, accession, bad
), qa AS (
  SELECT cik, accession, CASE WHEN bad THEN 'ValueError: made up' ELSE '' END AS error, n_words_full, n_words_item1a, n_words_item7,
         coalesce(n_words_full >= 100, false) AS full_ok,
         coalesce(n_words_item1a >= 20 AND n_words_full > 0 AND n_words_item1a <= 0.75 * n_words_full, false) AS item1a_ok,
         coalesce(n_words_item7 >= 20 AND n_words_full > 0 AND n_words_item7 <= 0.75 * n_words_full, false) AS item7_ok
  FROM counts
), pairs AS (
  SELECT * FROM (
    SELECT *, lag(accession) OVER w AS prev_accession, lag(filing_date) OVER w AS prev_filing_date, lag(report_date) OVER w AS prev_period
    FROM filings WHERE NOT bad WINDOW w AS (PARTITION BY cik ORDER BY report_date)
  ) WHERE date_diff('day', prev_period, report_date) BETWEEN 300 AND 430
), usable AS (
  SELECT accession, section, text FROM sections JOIN qa USING (accession)
  WHERE CASE section WHEN 'full' THEN full_ok WHEN 'item1a' THEN item1a_ok ELSE item7_ok END
), all_bags AS (
  SELECT accession, section, term, count(*) AS tf, bool_or(ok) AS ok
  FROM (SELECT s.accession, s.section, u.accession IS NOT NULL AS ok, unnest({TOKENS.format('s.text')}) AS term FROM sections s LEFT JOIN usable u USING (accession, section))
  GROUP BY ALL
), sums AS (
  SELECT accession, section, sum(tf * tf) AS norm, count(*) AS terms, sum(tf) AS words, bool_or(ok) AS ok FROM all_bags GROUP BY ALL
), dots AS (
  SELECT p.accession, a.section, sum(a.tf * b.tf) AS dot, count(*) AS common
  FROM pairs p JOIN all_bags a USING (accession) JOIN all_bags b ON b.accession = p.prev_accession AND b.section = a.section AND b.term = a.term
  GROUP BY ALL
), measures AS (
  SELECT p.accession, a.section, a.ok AND b.ok AS ok,
         coalesce(dot, 0) / (sqrt(CAST(a.norm AS DOUBLE)) * sqrt(CAST(b.norm AS DOUBLE))) AS cosine,
         CAST(coalesce(common, 0) AS DOUBLE) / (a.terms + b.terms - coalesce(common, 0)) AS jaccard
  FROM pairs p JOIN sums a USING (accession) JOIN sums b ON b.accession = p.prev_accession AND b.section = a.section
  LEFT JOIN dots d ON d.accession = p.accession AND d.section = a.section
), panel AS (
  SELECT cik, ticker, p.accession, prev_accession, filing_date, report_date, prev_filing_date,
         {', '.join(f"CAST(coalesce((SELECT words FROM sums s WHERE s.accession = p.{k} AND s.section = '{s}' AND ok), 0) AS BIGINT) AS {s}_{w}" for s in ('full', 'item1a', 'item7') for k, w in (('accession', 'words'), ('prev_accession', 'prev_words')))},
         {', '.join(f"(SELECT {m} FROM measures x WHERE x.accession = p.accession AND x.section = '{s}' AND ok) AS {s}_{m}" for s in ('full', 'item1a', 'item7') for m in ('cosine', 'jaccard'))}
  FROM pairs p
), signals AS (
  SELECT cik, ticker, accession, filing_date, unnest(['full_cosine', 'full_jaccard']) AS signal, unnest([cosine, jaccard]) AS value
  FROM pairs JOIN measures USING (accession) WHERE section = 'full'
), closes AS (
  SELECT 'T' || lpad(CAST(l_suppkey % n AS VARCHAR), 6, '0') AS ticker, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity) AS close
  FROM lineitem, {N} GROUP BY 1, 2
), monthly AS (
  SELECT ticker, last_day(date) AS date, arg_max(close, date) AS close FROM closes, (SELECT max(date) AS d, last_day(max(date)) AS e FROM closes)
  WHERE NOT (d < {BME.format('e')} AND last_day(date) = e) GROUP BY 1, 2
), returns AS (
  SELECT date, ticker, close / prev - 1 AS ret
  FROM (SELECT *, lag(date) OVER w AS prev_date, lag(close) OVER w AS prev FROM monthly WINDOW w AS (PARTITION BY ticker ORDER BY date))
  WHERE prev_date = last_day(date - INTERVAL 1 MONTH)
), calendar AS (
  SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM returns)
), factors AS (
  SELECT date, avg(ret) AS MKT_RF, {', '.join(f"avg(ret) FILTER (k % {m} = 0) - avg(ret) FILTER (k % {m} = 1) AS {f}" for f, m in (('SMB', 2), ('HML', 3), ('RMW', 5), ('CMA', 7), ('MOM', 4)))}, 0.002 AS RF
  FROM (SELECT *, CAST(substring(ticker, 2) AS INTEGER) AS k FROM returns) GROUP BY date
), formation AS (
  SELECT *, CASE WHEN filing_date <= b - (CASE WHEN isodow(b) = 1 THEN 3 ELSE 1 END) THEN e ELSE last_day(filing_date + INTERVAL 1 MONTH) END AS formed
  FROM (SELECT *, last_day(filing_date) AS e, {BME.format('last_day(filing_date)')} AS b FROM signals)
), starts AS (
  SELECT f.*, h.hold, (SELECT count(*) FROM calendar c WHERE c.date < f.formed) AS start, (SELECT count(*) FROM calendar) AS months
  FROM formation f, (SELECT unnest([3, 6, 12]) AS hold) h WHERE ticker IN (SELECT ticker FROM returns)
), live AS (
  SELECT hold, signal, pos, ticker, value FROM (
    SELECT *, row_number() OVER (PARTITION BY hold, signal, pos, ticker ORDER BY filing_date DESC, accession DESC) AS rn
    FROM (SELECT *, unnest(range(start, least(start + hold, months))) AS pos FROM starts WHERE start < months)
  ) WHERE rn = 1
), quantiles AS (
  SELECT hold, signal, pos, ticker, (rn * 5 + n_names - 1) // n_names AS q, n_names
  FROM (SELECT *, row_number() OVER (PARTITION BY hold, signal, pos ORDER BY value, ticker) AS rn, count(*) OVER (PARTITION BY hold, signal, pos) AS n_names FROM live)
  WHERE n_names >= {MIN_NAMES}
), members AS (
  SELECT q.*, r.ret, c.date FROM quantiles q JOIN calendar c ON c.pos = q.pos + 1 JOIN returns r ON r.date = c.date AND r.ticker = q.ticker
), tops AS (
  SELECT hold, signal, max(q) AS top FROM quantiles GROUP BY ALL
), legs AS (
  SELECT *, 1.0 / count(*) OVER (PARTITION BY hold, signal, leg, pos) AS w
  FROM (SELECT m.*, 'short' AS leg FROM members m WHERE q = 1 UNION ALL SELECT m.*, 'long' AS leg FROM members m JOIN tops USING (hold, signal) WHERE q = top)
), old AS (
  SELECT hold, signal, leg, pos + 1 AS pos, ticker, w * (1 + ret) / sum(w * (1 + ret)) OVER (PARTITION BY hold, signal, leg, pos) AS w FROM legs
), formed AS (
  SELECT hold, signal, q.pos, max(n_names) AS n_names, c.date FROM quantiles q JOIN calendar c ON c.pos = q.pos + 1 GROUP BY hold, signal, q.pos, c.date
), turnover AS (
  SELECT hold, signal, pos, leg, coalesce(sum(abs(new - before)), 0) AS turnover
  FROM (SELECT hold, signal, pos, leg FROM formed, (SELECT unnest(['short', 'long']) AS leg)) s
  LEFT JOIN (SELECT hold, signal, pos, leg, ticker, sum(new) AS new, sum(before) AS before
             FROM (SELECT hold, signal, pos, leg, ticker, w AS new, 0 AS before FROM legs UNION ALL SELECT hold, signal, pos, leg, ticker, 0, w FROM old) GROUP BY ALL) m
  USING (hold, signal, pos, leg) GROUP BY ALL
), qreturns AS (
  SELECT hold, signal, pos, date, q, avg(ret) AS ret, count(*) AS names FROM members GROUP BY ALL
), portfolios AS (
  SELECT f.hold, f.signal, f.date, f.n_names,
         {', '.join(f'max(ret) FILTER (q = {q}) AS Q{q}' for q in range(1, 6))},
         max(ret) FILTER (q = top) - max(ret) FILTER (q = 1) AS LS, s.turnover AS turnover_short, l.turnover AS turnover_long
  FROM formed f JOIN tops USING (hold, signal) LEFT JOIN qreturns r USING (hold, signal, pos)
  JOIN turnover s ON (s.hold, s.signal, s.pos, s.leg) = (f.hold, f.signal, f.pos, 'short') JOIN turnover l ON (l.hold, l.signal, l.pos, l.leg) = (f.hold, f.signal, f.pos, 'long')
  GROUP BY ALL
), nets AS (
  SELECT *, LS - (turnover_long + turnover_short) * 10.0 / 1e4 AS LS_net FROM portfolios
), samples AS (
  SELECT 'Full sample' AS sample, DATE '0001-01-01' AS a, DATE '9999-12-31' AS b
  UNION ALL SELECT 'Through 1998', DATE '0001-01-01', DATE '1998-12-31' UNION ALL SELECT '1999 onward', DATE '1999-01-01', DATE '9999-12-31'
), series AS (
  SELECT hold, signal, sample, series, date, ret
  FROM (SELECT hold, signal, date, unnest(['LS', 'LS_net']) AS series, unnest([LS, LS_net]) AS ret FROM nets) JOIN samples ON date BETWEEN a AND b WHERE ret IS NOT NULL
), wealth AS (
  SELECT *, product(1 + ret) OVER (PARTITION BY hold, signal, sample, series ORDER BY date ROWS UNBOUNDED PRECEDING) AS wealth FROM series
), peaks AS (
  SELECT *, max(wealth) OVER (PARTITION BY hold, signal, sample, series ORDER BY date ROWS UNBOUNDED PRECEDING) AS peak FROM wealth
), hac AS (
  SELECT hold, signal, sample, series, count(*) AS months,
         CASE WHEN count(*) >= 8 THEN avg(ret) * count(*) / sqrt(sum(u * u) + 2 * ({_lags('u * u{k}')})) END AS t_stat
  FROM (SELECT *, {', '.join(f'lag(u, {k}) OVER (PARTITION BY hold, signal, sample, series ORDER BY date) AS u{k}' for k in range(1, 7))}
        FROM (SELECT *, ret - avg(ret) OVER (PARTITION BY hold, signal, sample, series) AS u FROM series)) GROUP BY ALL
), perf AS (
  SELECT p.hold, p.signal, p.sample, p.series, count(*) AS months, avg(ret) AS mean, stddev_samp(ret) AS sd, min(wealth / peak - 1) AS dd, avg(CAST(ret > 0 AS INTEGER)) AS hit, max(t_stat) AS t_stat
  FROM peaks p JOIN hac h ON (h.hold, h.signal, h.sample, h.series) = (p.hold, p.signal, p.sample, p.series) GROUP BY ALL
), performance AS (
  SELECT hold, signal, sample, series, months, CASE WHEN months >= 12 THEN mean * 1e4 END AS mean_monthly_bps, CASE WHEN months >= 12 THEN mean * 12 END AS ann_return,
         CASE WHEN months >= 12 THEN sd * sqrt(12) END AS ann_vol, CASE WHEN months >= 12 THEN mean / nullif(sd, 0) * sqrt(12) END AS sharpe, CASE WHEN months >= 12 THEN t_stat END AS t_stat,
         CASE WHEN months >= 12 THEN dd END AS max_drawdown, CASE WHEN months >= 12 THEN hit END AS hit_rate
  FROM perf
), best AS (
  SELECT a.label AS firm, a.vec_id % 5 AS edition, a.vec_id AS passage_no, 20 + a.vec_id % 100 AS words,
         max(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS match_score
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 5 = b.vec_id % 5 + 1 GROUP BY ALL
)
"""

_PORT = "signal, date, n_names"
_QS = [f"Q{i}" for i in range(1, 6)]
_PERF = ["mean_monthly_bps", "ann_return", "ann_vol", "sharpe", "t_stat", "max_drawdown", "hit_rate"]


def _r(names: list[str]) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


_CAPM = f"""SELECT signal, sample, series, n AS months, {_r(['alpha_monthly_bps', 'alpha_t', 'beta_MKT_RF', 'r2'])} FROM (
  SELECT signal, sample, series, count(*) AS n, (max(my) - max(b) * max(mx)) * 1e4 AS alpha_monthly_bps, max(b) AS beta_MKT_RF, regr_r2(ret, x) AS r2,
         (max(my) - max(b) * max(mx)) / sqrt(
           (sum(s0 * s0) + 2 * ({_lags('s0 * s0_{k}')})) / count(*) ** 2
           - 2 * max(mx) / sum((x - mx) ** 2) * (sum(s0 * s1) + ({_lags('s0 * s1_{k} + s1 * s0_{k}')})) / count(*)
           + (max(mx) / sum((x - mx) ** 2)) ** 2 * (sum(s1 * s1) + 2 * ({_lags('s1 * s1_{k}')}))) AS alpha_t
  FROM (SELECT *, {', '.join(f'lag(s{i}, {k}) OVER (PARTITION BY signal, sample, series ORDER BY date) AS s{i}_{k}' for k in range(1, 7) for i in (0, 1))}
        FROM (SELECT *, ret - my - b * (x - mx) AS s0, (ret - my - b * (x - mx)) * (x - mx) AS s1
              FROM (SELECT s.*, MKT_RF AS x, regr_slope(ret, MKT_RF) OVER w AS b, avg(MKT_RF) OVER w AS mx, avg(ret) OVER w AS my
                    FROM series s JOIN factors USING (date) WHERE hold = 12 WINDOW w AS (PARTITION BY signal, sample, series))))
  GROUP BY ALL HAVING count(*) >= 9)"""


def _orthogonal(names: tuple[str, ...], key: str, where: str) -> str:
    """Residuals of the return (y) and of the constant (c) on these factors, one factor
    after the other, each cleared of those before it."""
    w = f"OVER (PARTITION BY {key})"
    sql = f"SELECT {key}, date, ret, ret AS y, CAST(1 AS DOUBLE) AS c, {', '.join(names)} FROM series JOIN factors USING (date) WHERE {where}"
    for i, f in enumerate(names):
        rest = ["y", "c", *names[i + 1 :]]
        sql = f"SELECT {key}, date, ret, {', '.join(f'{x} - {f} * (sum({x} * {f}) {w}) / (sum({f} * {f}) {w}) AS {x}' for x in rest)} FROM ({sql})"
    return sql


def _model(name: str, names: tuple[str, ...], key: str = "signal, sample, series", where: str = "hold = 12") -> str:
    w = f"OVER (PARTITION BY {key})"
    enough = f"count(*) >= {len(names) + 8}"
    return f"""SELECT {key}, '{name}' AS model, count(*) AS months,
         CASE WHEN {enough} THEN round(max(alpha) * 1e4, 6) + 0.0 END AS alpha_monthly_bps,
         CASE WHEN {enough} THEN round(max(alpha) / sqrt(sum(u * u) + 2 * ({_lags('u * u{k}')})), 6) + 0.0 END AS alpha_t,
         CASE WHEN {enough} THEN round(1 - sum(e * e) / (var_pop(ret) * count(*)), 6) + 0.0 END AS r2
  FROM (SELECT *, {', '.join(f'lag(u, {k}) OVER (PARTITION BY {key} ORDER BY date) AS u{k}' for k in range(1, 7))}
        FROM (SELECT *, (y - alpha * c) AS e, c / cc * (y - alpha * c) AS u
              FROM (SELECT *, sum(y * c) {w} / sum(c * c) {w} AS alpha, sum(c * c) {w} AS cc FROM ({_orthogonal(names, key, where)}))))
  GROUP BY ALL"""


_MODELS = {"FF3": ("MKT_RF", "SMB", "HML"), "FF5": ("MKT_RF", "SMB", "HML", "RMW", "CMA"), "FF5+MOM": ("MKT_RF", "SMB", "HML", "RMW", "CMA", "MOM")}
_MEASURES = [f"{s}_{m}" for s in ("full", "item1a", "item7") for m in ("cosine", "jaccard")]

#: Without VIEWS in front.
BODIES: dict[str, str] = {
    "universe_dedup": f"SELECT cik, ticker, name, sector, replace(ticker, '.', '-') AS yahoo_ticker FROM (SELECT s_suppkey % 7 AS cik, 'S.' || s_suppkey AS ticker, s_name AS name, n_name AS sector, row_number() OVER (PARTITION BY s_suppkey % 7 ORDER BY s_suppkey) AS rn FROM supplier JOIN nation ON s_nationkey = n_nationkey) WHERE rn = 1",
    "form_filter_index": "SELECT cik, accession, filing_date, form, url FROM (SELECT o_custkey AS cik, 'A-' || o_orderkey AS accession, CAST(o_orderdate AS DATE) AS filing_date, ['10-K', '10-K405', '10-K/A', '8-K'][o_orderkey % 4 + 1] AS form, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/A' || o_orderkey || '/' || CASE WHEN o_orderkey % 3 = 0 THEN 'A-' || o_orderkey || '.txt' ELSE 'd' || o_orderkey || '.htm' END AS url FROM orders) WHERE form IN ('10-K', '10-K405') AND filing_date >= '1997-06-01'",
    "filing_url": "SELECT o_orderkey AS accession, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/A' || o_orderkey || '/' || CASE WHEN o_orderkey % 3 = 0 THEN 'A-' || o_orderkey || '.txt' ELSE 'd' || o_orderkey || '.htm' END AS url FROM orders",
    "semi_anti_incremental": "SELECT accession FROM filings WHERE ticker IN (SELECT ticker FROM returns) AND accession NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)",
    "token_counts": f"SELECT doc_id, CAST(len({TOKENS.format('text')}) AS BIGINT) AS tokens, {COUNT.format('text')} AS words FROM documents",
    "term_frequency": f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL",
    "cosine_pairs": f"SELECT accession, prev_accession, {_r(['cosine'])} FROM pairs JOIN measures USING (accession) WHERE section = 'full'",
    "jaccard_pairs": f"SELECT accession, prev_accession, {_r(['jaccard'])} FROM pairs JOIN measures USING (accession) WHERE section = 'full'",
    "consecutive_pairs_orders": "SELECT cik, filing_date, prev AS prev_filing_date FROM (SELECT *, lag(filing_date) OVER (PARTITION BY cik ORDER BY filing_date) AS prev FROM (SELECT DISTINCT o_custkey AS cik, CAST(o_orderdate AS DATE) AS filing_date FROM orders)) WHERE date_diff('day', prev, filing_date) BETWEEN 300 AND 430",
    "similarity_panel_wide": f"SELECT cik, ticker, accession, prev_accession, filing_date, report_date, prev_filing_date, {', '.join(f'{s}_words, {s}_prev_words' for s in ('full', 'item1a', 'item7'))}, {_r([f'{s}_{m}' for s in ('full', 'item1a', 'item7') for m in ('cosine', 'jaccard')])} FROM panel",
    "similarity_trend_median": f"SELECT year(filing_date) AS year, {', '.join(f'round(median({s}_cosine), 6) AS {s}_cosine' for s in ('full', 'item1a', 'item7'))} FROM panel GROUP BY 1",
    "qa_gates": "SELECT * REPLACE (coalesce(n_words_full, -1) AS n_words_full, coalesce(n_words_item1a, -1) AS n_words_item1a, coalesce(n_words_item7, -1) AS n_words_item7) FROM qa",
    "qa_summary_by_year": "SELECT year(filing_date) AS year, count(*) AS filings, CAST(sum(CAST(error <> '' AS INTEGER)) AS BIGINT) AS parse_errors, round(avg(CAST(full_ok AS INTEGER)), 6) AS full_ok, round(avg(CAST(item1a_ok AS INTEGER)), 6) AS item1a_ok, round(avg(CAST(item7_ok AS INTEGER)), 6) AS item7_ok, median(n_words_full) AS median_words FROM qa JOIN filings USING (accession) GROUP BY 1",
    "passage_best_match": f"SELECT firm, edition, passage_no, words, {_r(['match_score'])} FROM best",
    "semantic_scores": "SELECT firm, edition, round(sum(match_score * words) / sum(words), 6) AS semantic, round(sum(CASE WHEN match_score < 0.6 THEN words ELSE 0 END) / sum(words), 6) AS novel_share FROM best GROUP BY ALL",
    "top_changes": f"SELECT firm, edition, passage_no, {_r(['match_score'])}, rank FROM (SELECT *, row_number() OVER (PARTITION BY firm, edition ORDER BY match_score, passage_no) AS rank FROM best) WHERE rank <= 3",
    "month_end_close": f"SELECT ticker, date, {_r(['close'])} FROM monthly",
    "monthly_returns": f"SELECT date, ticker, {_r(['ret'])} FROM returns",
    "returns_pivot": f"SELECT date, {', '.join(f'round(max(ret) FILTER (ticker = {t!r}), 6) + 0.0 AS {t}' for t in ('T000000', 'T000001', 'T000002', 'T000003'))} FROM returns GROUP BY date",
    "returns_melt": "SELECT date, ticker, ret FROM (SELECT date, unnest(['T000000', 'T000001', 'T000002', 'T000003']) AS ticker, unnest([" + ", ".join(f"round(max(ret) FILTER (ticker = {t!r}), 6) + 0.0" for t in ("T000000", "T000001", "T000002", "T000003")) + "]) AS ret FROM returns GROUP BY date) WHERE ret IS NOT NULL",
    "factor_means": f"SELECT date, {_r(['MKT_RF', 'SMB', 'HML', 'RMW', 'CMA', 'MOM', 'RF'])} FROM factors",
    "formation_dates": "SELECT accession, filing_date, formed FROM formation WHERE signal = 'full_cosine'",
    "live_signal": f"SELECT signal, pos, ticker, {_r(['value'])} FROM live WHERE hold = 12",
    "quantile_assignment": "SELECT signal, pos, ticker, q, n_names FROM quantiles WHERE hold = 12",
    "quantile_returns": f"SELECT signal, pos, date, q, {_r(['ret'])}, names FROM qreturns WHERE hold = 12",
    "long_short": f"SELECT {_PORT}, {_r([*_QS, 'LS'])} FROM nets WHERE hold = 12",
    "turnover_net": f"SELECT signal, date, {_r(['turnover_short', 'turnover_long', 'LS', 'LS_net'])} FROM nets WHERE hold = 12",
    "performance_stats": f"SELECT signal, sample, series, months, {_r(_PERF)} FROM performance WHERE hold = 12",
    "drawdown": "SELECT signal, sample, series, date, round(wealth / peak - 1, 6) + 0.0 AS drawdown FROM peaks WHERE hold = 12",
    "growth_curve": "SELECT signal, sample, series, date, round(sign(wealth) * ln(abs(wealth)), 6) + 0.0 AS growth FROM wealth WHERE hold = 12",
    "newey_west_t": f"SELECT signal, sample, series, months, {_r(['t_stat'])} FROM hac WHERE hold = 12",
    "capm_regression": _CAPM,
    "sample_slices": "SELECT signal, sample, series, min(date) AS first, max(date) AS last, count(*) AS months FROM series WHERE hold = 12 GROUP BY ALL",
    "quintile_means": f"SELECT signal, sample, {', '.join(f'round(avg({q}) * 1e4, 6) AS {q}' for q in _QS)}, round(avg(n_names), 6) AS avg_names, round(avg(turnover_long + turnover_short) / 2, 6) AS avg_monthly_turnover FROM nets JOIN samples ON date BETWEEN a AND b WHERE hold = 12 GROUP BY ALL",
    "hold_robustness": f"SELECT signal, CAST(hold AS INTEGER) AS hold_months, months, {_r(_PERF)}, (SELECT round(avg(n_names), 6) FROM nets n WHERE n.hold = p.hold AND n.signal = p.signal) AS avg_names FROM performance p WHERE sample = 'Full sample' AND series = 'LS'",
    "research_tables_long": f"SELECT signal, sample, series, statistic, round(value, 6) + 0.0 AS value FROM (SELECT signal, sample, series, unnest([{', '.join(repr(x) for x in _PERF)}]) AS statistic, unnest([{', '.join(_PERF)}]) AS value FROM performance WHERE hold = 12) WHERE value IS NOT NULL",
    "meta_row": "SELECT (SELECT count(DISTINCT cik) FROM filings WHERE NOT bad) AS companies, (SELECT count(*) FROM qa WHERE error = '') AS filings_parsed, (SELECT count(*) FROM pairs) AS year_over_year_pairs, (SELECT min(filing_date) FROM filings WHERE NOT bad) AS first_filing, (SELECT max(filing_date) FROM filings WHERE NOT bad) AS last_filing",
    "company_history": f"SELECT ticker, filing_date, {_r(['full_cosine', 'full_jaccard'])} FROM panel WHERE ticker = 'T000003'",
    "status_counts": "SELECT status, count(*) AS filings FROM (SELECT CASE WHEN error = '' THEN 'ok' ELSE string_split(error, ':')[1] END AS status FROM qa) GROUP BY ALL",
    "signal_labels": "SELECT DISTINCT signal, string_split(signal, '_')[1] || ' (' || substring(signal, strpos(signal, '_') + 1) || ')' AS label FROM signals",
    "factor_block_parse": "SELECT * FROM (VALUES ('196307', 'Mkt-RF', -0.0039), ('196307', 'SMB', -0.0041), ('196307', 'RF', 0.0027), ('196308', 'Mkt-RF', 0.0507), ('196308', 'SMB', -0.008), ('196308', 'RF', NULL), ('196309', 'Mkt-RF', -0.0157), ('196309', 'SMB', -0.0052), ('196309', 'RF', 0.0027)) t(yyyymm, factor, value)",
    "normalize_lines": r"""SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\f\v]+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:-?\s*\d{1,3}\s*-?|page\s+\d{1,3}(?:\s+of\s+\d+)?|table\s+of\s+contents)$', 'i')), chr(10)) AS lines FROM documents""",
}

#: Fixed pattern: page furniture.
_NOISE = r"^(?:-?\s*\d{1,3}\s*-?|page\s+\d{1,3}(?:\s+of\s+\d+)?|table\s+of\s+contents)$"


def _clean_lines(text: str) -> str:
    """List of the trimmed, single-spaced lines of a text, less empty ones and page furniture."""
    return rf"list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(regexp_replace(x, '[ \t\f\v]+', ' ', 'g'))), lambda x: x <> '' AND NOT regexp_matches(x, '{_NOISE}', 'i'))"


_BLOCKS = "p|div|br|tr|li|h1|h2|h3|h4|h5|h6|table|ul|ol|blockquote|pre|hr|section|article|title|center|dd|dt|caption"
_TAGLESS = rf"""regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(head|script|style|noscript)\b.*?</(head|script|style|noscript)\s*>', '', 'gis'), chr(10), ' '), '</?({_BLOCKS})\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g')"""
_ENTITIES = ("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")


def _unescaped(text: str) -> str:
    for name, char in _ENTITIES:
        text = f"replace({text}, '&{name};', '{char}')"
    return text


#: As BODIES, VIEWS in front.
BODIES_2 = {
    "factor_models": " UNION ALL ".join(_model(name, names) for name, names in _MODELS.items()),
    "hold_alpha": f"SELECT signal, CAST(hold AS INTEGER) AS hold_months, months, alpha_monthly_bps, alpha_t FROM ({_model('FF5+MOM', _MODELS['FF5+MOM'], 'hold, signal, sample, series', 'sample = ' + repr('Full sample') + ' AND series = ' + repr('LS'))})",
    "similarity_describe": f"SELECT measure, count(value) AS count, {', '.join(f'round({f}, 6) + 0.0 AS {n}' for n, f in (('mean', 'avg(value)'), ('std', 'stddev_samp(value)'), ('min', 'min(value)'), ('p25', 'quantile_cont(value, 0.25)'), ('p50', 'quantile_cont(value, 0.5)'), ('p75', 'quantile_cont(value, 0.75)'), ('max', 'max(value)')))} FROM (SELECT unnest([{', '.join(map(repr, _MEASURES))}]) AS measure, unnest([{', '.join(_MEASURES)}]) AS value FROM panel) WHERE value IS NOT NULL GROUP BY measure",
    "missing_tickers": "SELECT DISTINCT 'T' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS ticker FROM customer WHERE 'T' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') NOT IN (SELECT ticker FROM returns)",
    "meta_months": BODIES["meta_row"] + ", (SELECT coalesce(concat_ws(' to ', CAST(min(date) AS VARCHAR), CAST(max(date) AS VARCHAR)), '') FROM nets WHERE hold = 12 AND signal = 'full_cosine') AS return_months",
}

#: Standing alone, with names of their own in front.
WHOLE_SQL = {
    "html_to_text": f"SELECT page_id, array_to_string({_clean_lines(_unescaped(_TAGLESS))}, chr(10)) AS text, '' AS error FROM pages",
    "split_passages": r"""WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents
), worded AS (
  SELECT doc_id, i, regexp_extract_all(line, '[^ 	

]+') AS w FROM lines
), pieces AS (
  SELECT doc_id, j < k AS is_full, w[180 * j + 1 : CASE WHEN j < k THEN 180 * j + 180 ELSE len(w) END] AS w, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS seq
  FROM (SELECT *, unnest(range(k + 1)) AS j FROM (SELECT *, CASE WHEN len(w) > 180 THEN (len(w) - 1) // 180 ELSE 0 END AS k FROM worded))
), fold AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS seq, 0 AS passage, 0 AS open_passage, CAST(0 AS BIGINT) AS held FROM documents
  UNION ALL
  SELECT doc_id, seq, passage, passage + CASE WHEN is_full OR new_held >= 120 THEN 1 ELSE 0 END, CASE WHEN is_full OR new_held >= 120 THEN 0 ELSE new_held END
  FROM (
    SELECT p.doc_id, p.seq, p.is_full, open_passage + CASE WHEN held > 0 AND (p.is_full OR held + len(p.w) > 180) THEN 1 ELSE 0 END AS passage,
           CASE WHEN p.is_full THEN 0 WHEN held + len(p.w) > 180 THEN len(p.w) ELSE held + len(p.w) END AS new_held
    FROM fold f JOIN pieces p ON p.doc_id = f.doc_id AND p.seq = f.seq + 1
  )
), passages AS (
  SELECT doc_id, passage, sum(len(w)) AS n, string_agg(array_to_string(w, ' '), ' ' ORDER BY seq) FILTER (len(w) > 0) AS passage_text
  FROM fold JOIN pieces USING (doc_id, seq) GROUP BY ALL HAVING sum(len(w)) >= 8
)
SELECT CAST(doc_id AS VARCHAR) AS accession, 'full' AS section, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY passage) - 1 AS INTEGER) AS passage_no, CAST(n AS INTEGER) AS words, passage_text AS passage
FROM passages""",
    "extract_sections": rf"""WITH made AS (
  SELECT CAST(doc_id AS VARCHAR) AS accession, concat_ws(chr(10), l[1], 'Item 1A. Risk Factors', array_to_string(l[2:3], chr(10)), 'Item 1B. Comments', l[4], 'ITEM 7 - MANAGEMENT''S DISCUSSION', array_to_string(l[5:], chr(10)), 'Item 8. Statements') AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
), lines AS (
  SELECT accession, unnest({_clean_lines('text')}) AS line, generate_subscripts({_clean_lines('text')}, 1) AS i FROM made
), read AS (
  SELECT *, len(regexp_extract_all(line, '[A-Za-z]{{2,}}')) AS n,
         CASE WHEN length(line) <= 200 THEN lower(regexp_extract(line, '(?i)^(?:part\s+[iv]{{1,3}}\s*[.,:;\-–—]*\s*)?items?\s*(\d{{1,2}})\s*\(?([abc])?\)?(?:[^a-z0-9].*)?$', 1)
           || regexp_extract(line, '(?i)^(?:part\s+[iv]{{1,3}}\s*[.,:;\-–—]*\s*)?items?\s*(\d{{1,2}})\s*\(?([abc])?\)?(?:[^a-z0-9].*)?$', 2)) ELSE '' END AS code
  FROM lines
), headings AS (
  SELECT accession, i, code, regexp_replace(lower(regexp_extract(line, '(?i)items?\s*\d{{1,2}}\s*\(?[abc]?\)?((?:[^a-z0-9].*)?)$', 1)), '^(?:\s*(?:and|&|,)\s*\d{{1,2}}[abc]?)*[^a-z0-9]*', '') AS title FROM read WHERE code <> ''
), rules AS (
  SELECT * FROM (VALUES ('item1a', '1a', ['1b', '1c', '2', '3'], ['risk']), ('item7', '7', ['7a', '8'], ['management', 'md&a'])) r(name, code, ends, titles)
), spans AS (
  SELECT h.accession, r.name, h.i AS first, min(e.i) AS last
  FROM rules r JOIN headings h ON h.code = r.code AND (h.title = '' OR list_bool_or(list_transform(r.titles, lambda t: starts_with(h.title, t))))
  JOIN headings e ON e.accession = h.accession AND e.i > h.i AND list_contains(r.ends, e.code) GROUP BY ALL
), rated AS (
  SELECT s.*, NOT EXISTS (SELECT 1 FROM headings x, rules r WHERE x.accession = s.accession AND x.i > s.first AND x.i < s.last AND r.name = s.name AND x.code <> r.code) AS clean,
         (SELECT coalesce(sum(n), 0) FROM read l WHERE l.accession = s.accession AND l.i > s.first AND l.i < s.last) AS words
  FROM spans s
), best AS (
  SELECT *, row_number() OVER (PARTITION BY accession, name ORDER BY clean DESC, words DESC, first) AS rn FROM rated
), texts AS (
  SELECT b.accession, b.name, string_agg(l.line, chr(10) ORDER BY l.i) AS text
  FROM best b JOIN read l ON l.accession = b.accession AND l.i > b.first AND l.i < b.last AND l.code = '' WHERE rn = 1 GROUP BY ALL
)
SELECT accession, coalesce((SELECT text FROM texts t WHERE t.accession = m.accession AND name = 'item1a'), '') AS item1a,
       coalesce((SELECT text FROM texts t WHERE t.accession = m.accession AND name = 'item7'), '') AS item7, '' AS error
FROM made m""",
}

ORACLE_SQL = {name: (VIEWS + body if name not in ("universe_dedup", "form_filter_index", "filing_url", "token_counts", "term_frequency", "factor_block_parse", "normalize_lines", "consecutive_pairs_orders") else body) for name, body in BODIES.items()}
ORACLE_SQL |= {name: VIEWS + body for name, body in BODIES_2.items()} | WHOLE_SQL
