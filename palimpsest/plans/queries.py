"""The query catalogue over the test tables: name -> function of (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.dates import formation_month_end
from palimpsest.functions.words import normalized_lines, tokens, word_count
from palimpsest.operators import filings as filing_ops
from palimpsest.operators import market, portfolio, semantic, similarity
from palimpsest.operators import performance as perf
from palimpsest.plans import research
from palimpsest.sources.views import Views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: The whole job where the SQL beside a query of QUERIES names only a part of it; no SQL of their own.
WHOLE: dict[str, Query] = {}
SAMPLES = (("Full sample", None, None), ("Through 1998", None, "1998-12-31"), ("1999 onward", "1999-01-01", None))
GATES = {"min_full": 100, "min_section": 20}
FIRM = ["firm", "edition"]


def query(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
    return f


def whole(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    WHOLE[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _min_names(v: Views) -> int:
    """Of the queries with SQL, which has the same switch; whole ones take the reference's 50 on any table."""
    return 50 if v.firms() >= 100 else 5


def _texts(v: Views) -> DataFrame:
    return v.sections().filter("section = 'full'")


def _measures(v: Views) -> DataFrame:
    pairs = similarity.consecutive_pairs(v.filings())
    return pairs.join(similarity.cosine_jaccard(pairs, _texts(v), ("full",)).filter("cosine is not null"), "accession")


def _signals(v: Views) -> DataFrame:
    both = F.array(*[F.struct(F.lit(f"full_{m}").alias("signal"), F.col(m).alias("value")) for m in ("cosine", "jaccard")])
    return v.once("signals", lambda: _measures(v).select("cik", "ticker", "accession", "filing_date", F.inline(both)))


def _every_signal(v: Views) -> DataFrame:
    """Every measure of every section that passes its gate, and the semantic ones: 11 signals."""

    def make() -> DataFrame:
        panel = v.settled("panel-edit", lambda: _panel(v, with_edit=True))
        keys = ["cik", "ticker", "accession", "filing_date"]
        scores = semantic.semantic_panel(panel, v.sections())[0].filter("semantic is not null")
        rows = scores.join(panel.select(*keys), "accession").select(*keys, F.concat("section", F.lit("_semantic")).alias("signal"), F.col("semantic").alias("value"))
        return similarity.long_signals(panel).unionByName(rows)

    return v.settled("every-signal", make)


def _every_portfolio(v: Views, min_names: int = portfolio.MIN_NAMES) -> DataFrame:
    return v.once(f"every-portfolio-{min_names}", lambda: portfolio.run_sort(_every_signal(v), v.returns(), min_names=min_names))


def _every_series(v: Views) -> DataFrame:
    return perf.in_samples(perf.long_series(_every_portfolio(v)), SAMPLES)


def _every_quantile(v: Views) -> DataFrame:
    return v.once("every-quantile", lambda: portfolio.quantiles(portfolio.live_signal(_every_signal(v), v.returns())))


def _qa(v: Views) -> DataFrame:
    return filing_ops.quality_gates(v.parsed(), **GATES)


def _panel(v: Views, with_edit: bool = False) -> DataFrame:
    return similarity.similarity_panel(v.filings(), _qa(v), v.sections(), with_edit)


def _live(v: Views) -> DataFrame:
    return portfolio.live_signal(_signals(v), v.returns())


def _quantiles(v: Views) -> DataFrame:
    return v.once("quantiles", lambda: portfolio.quantiles(_live(v), min_names=_min_names(v)))


def _portfolios(v: Views, hold: int = portfolio.HOLD_MONTHS) -> DataFrame:
    return v.once(f"portfolios-{hold}", lambda: portfolio.run_sort(_signals(v), v.returns(), hold, min_names=_min_names(v)))


def _series(v: Views) -> DataFrame:
    return perf.in_samples(perf.long_series(_portfolios(v)), SAMPLES)


def _order_index(v: Views) -> DataFrame:
    key = F.col("o_orderkey")
    form = F.element_at(F.array(*map(F.lit, ("10-K", "10-K405", "10-K/A", "8-K"))), (key % 4 + 1).cast("int"))
    return v.table("orders").select(
        F.col("o_custkey").alias("cik"), F.lit("").alias("ticker"), key.alias("position"), F.concat(F.lit("A-"), key).alias("accessionNumber"), F.col("o_orderdate").cast("date").cast("string").alias("filingDate"),
        F.lit("").alias("reportDate"), F.lit("").alias("acceptanceDateTime"), form.alias("form"), F.when(key % 3 == 0, "").otherwise(F.concat(F.lit("d"), key, F.lit(".htm"))).alias("primaryDocument"),
    )


@query
def universe_dedup(v: Views) -> DataFrame:
    raw = v.table("supplier").join(v.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    raw = raw.select(F.col("s_suppkey").alias("position"), F.concat(F.lit("S."), "s_suppkey").alias("Symbol"), F.col("s_name").alias("Security"), F.col("n_name").alias("GICS Sector"), (F.col("s_suppkey") % 7).alias("CIK"))
    return market.universe(raw)


@query
def form_filter_index(v: Views) -> DataFrame:
    return market.annual_filings(_order_index(v), "1997-06-01").select("cik", "accession", "filing_date", "form", "url")


@query
def filing_url(v: Views) -> DataFrame:
    rows = _order_index(v)
    return rows.select(F.col("position").alias("accession"), market.filing_url(F.col("cik"), F.col("accessionNumber"), F.col("primaryDocument")).alias("url"))


@query
def semi_anti_incremental(v: Views) -> DataFrame:
    done = v.table("labels").select(F.col("doc_id").cast("string").alias("accession"))
    return v.all_filings().join(v.returns().select("ticker"), "ticker", "left_semi").join(done, "accession", "left_anti").select("accession")


@query
def token_counts(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("tokens"), word_count(F.col("text")).alias("words"))


@query
def term_frequency(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query
def cosine_pairs(v: Views) -> DataFrame:
    return rounded(_measures(v).select("accession", "prev_accession", "cosine"))


@query
def jaccard_pairs(v: Views) -> DataFrame:
    return rounded(_measures(v).select("accession", "prev_accession", "jaccard"))


@query
def edit_pairs(v: Views) -> DataFrame:
    """Every section; one that has no text in an edition (a document of few lines) is not there."""
    there = v.sections().filter("section = 'full' or text <> ''")
    return rounded(similarity.edit(similarity.consecutive_pairs(v.filings()), there).select("accession", "section", "edit"))


@query
def consecutive_pairs_orders(v: Views) -> DataFrame:
    return similarity.consecutive_pairs(v.order_periods()).select("cik", "filing_date", "prev_filing_date")


@query
def similarity_panel_wide(v: Views) -> DataFrame:
    return rounded(_panel(v))


@whole
def similarity_panel_edit(v: Views) -> DataFrame:
    return rounded(_panel(v, with_edit=True))


@query
def similarity_trend_median(v: Views) -> DataFrame:
    return rounded(similarity.trend_by_year(_panel(v)))


@query
def qa_gates(v: Views) -> DataFrame:
    return _qa(v).drop("parser_version").fillna(-1)  # no count where parsing failed


@query
def qa_summary_by_year(v: Views) -> DataFrame:
    return rounded(filing_ops.scorecard(_qa(v), v.all_filings()))


@query
def normalize_lines(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.array_join(normalized_lines(F.col("text")), "\n").alias("lines"))


@query
def html_to_text(v: Views) -> DataFrame:
    raw = v.table("pages").select(F.col("page_id").alias("cik"), F.col("url").alias("accession"), F.col("html").cast("binary").alias("content"))
    return filing_ops.parse_filings(raw).select(F.col("cik").alias("page_id"), F.col("full").alias("text"), "error")


@query
def extract_sections(v: Views) -> DataFrame:
    """Documents as plain filings, with item headings set before their lines 2, 4 and 6."""
    lines = F.split("text", "\n")
    cut = lambda a, n: F.array_join(F.slice(lines, a, n), "\n")
    made = F.concat_ws("\n", cut(1, 1), F.lit("Item 1A. Risk Factors"), cut(2, 2), F.lit("Item 1B. Comments"), cut(4, 1), F.lit("ITEM 7 - MANAGEMENT'S DISCUSSION"), cut(5, 1_000_000_000), F.lit("Item 8. Statements"))
    raw = v.table("documents").select(F.lit(0).alias("cik"), F.col("doc_id").cast("string").alias("accession"), made.cast("binary").alias("content"))
    return filing_ops.parse_filings(raw).select("accession", "item1a", "item7", "error")


@query
def split_passages(v: Views) -> DataFrame:
    return semantic.split_passages(_texts(v))


def _best(v: Views) -> DataFrame:
    rows = v.passages()
    before = rows.select("firm", (F.col("edition") + 1).alias("edition"), "embedding")
    return semantic.best_match(rows, before, FIRM)


@query
def passage_best_match(v: Views) -> DataFrame:
    return rounded(_best(v))


@query
def semantic_scores(v: Views) -> DataFrame:
    return rounded(semantic.semantic_scores(_best(v), FIRM))


@query
def top_changes(v: Views) -> DataFrame:
    return rounded(semantic.top_changes(_best(v), FIRM)).drop("words")


@query
def semantic_panel(v: Views) -> DataFrame:
    return rounded(semantic.semantic_panel(_panel(v), v.sections())[0])


@query
def month_end_close(v: Views) -> DataFrame:
    return rounded(market.month_end_close(v.closes(), v.close_dates()))


@query
def monthly_returns(v: Views) -> DataFrame:
    return rounded(v.returns())


_FEW = ["T000000", "T000001", "T000002", "T000003"]


@query
def returns_pivot(v: Views) -> DataFrame:
    return rounded(v.returns().groupBy("date").pivot("ticker", _FEW).agg(F.max("ret")))


@query
def returns_melt(v: Views) -> DataFrame:
    return returns_pivot(v).unpivot(["date"], _FEW, "ticker", "ret").dropna(subset=["ret"])


@whole
def returns_pivot_all(v: Views) -> DataFrame:
    return rounded(market.returns_wide(v.returns()))


@whole
def returns_melt_all(v: Views) -> DataFrame:
    return rounded(market.returns_long(returns_pivot_all(v)))


@query
def factor_means(v: Views) -> DataFrame:
    return rounded(v.factors())


@query
def factor_block_parse(v: Views) -> DataFrame:
    text = "Made up\nfree text, 196301\n\n,Mkt-RF,SMB,RF\n196307, -0.39, -0.41, 0.27\n196308, 5.07, -0.80, -99.99\n196309, -1.57, -0.52, 0.27\n\n Annual\n,Mkt-RF,SMB,RF\n1963, 1.0, 2.0, 3.0\n"
    files = v.spark.createDataFrame([("five", text)], "name string, text string")
    return rounded(market.factor_block(files).drop("name"))


@query
def formation_dates(v: Views) -> DataFrame:
    return _signals(v).filter("signal = 'full_cosine'").select("accession", "filing_date", formation_month_end(F.col("filing_date")).alias("formed"))


@query
def live_signal(v: Views) -> DataFrame:
    return rounded(_live(v))


@query
def quantile_assignment(v: Views) -> DataFrame:
    return _quantiles(v)


@query
def quantile_returns(v: Views) -> DataFrame:
    return rounded(portfolio.quantile_returns(_quantiles(v), v.returns()))


@query
def long_short(v: Views) -> DataFrame:
    return rounded(_portfolios(v).select("signal", "date", "n_names", "Q1", "Q2", "Q3", "Q4", "Q5", "LS"))


@query
def turnover_net(v: Views) -> DataFrame:
    return rounded(_portfolios(v).select("signal", "date", "turnover_short", "turnover_long", "LS", "LS_net"))


@query
def performance_stats(v: Views) -> DataFrame:
    return rounded(perf.performance(_series(v)))


@query
def drawdown(v: Views) -> DataFrame:
    return rounded(perf.wealth(_series(v)).select(*perf.KEY, "date", (F.col("wealth") / F.col("peak") - 1).alias("drawdown")))


@query
def growth_curve(v: Views) -> DataFrame:
    w = F.col("growth")  # on a log scale: the made-up prices give sums of any size
    return rounded(perf.growth_curve(_series(v)).withColumn("growth", F.signum(w) * F.log(F.abs(w))))


@query
def newey_west_t(v: Views) -> DataFrame:
    return rounded(perf.newey_west(_series(v)))


@query
def capm_regression(v: Views) -> DataFrame:
    return rounded(perf.capm(_series(v), v.factors()))


@query
def multifactor_regression(v: Views) -> DataFrame:
    return rounded(research.attribution(_every_portfolio(v), v.factors()))


@query
def sample_slices(v: Views) -> DataFrame:
    return _series(v).groupBy(*perf.KEY).agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("months"))


@query
def quintile_means(v: Views) -> DataFrame:
    return rounded(perf.quantile_means(_portfolios(v), SAMPLES))


@query
def hold_robustness(v: Views) -> DataFrame:
    out = research.robustness(_signals(v), v.returns(), v.factors(), portfolio.COST_BPS, _min_names(v), primary=("full_cosine", "full_jaccard"))
    return rounded(out.drop("alpha_monthly_bps", "alpha_t"))


@query
def research_tables_long(v: Views) -> DataFrame:
    wide = perf.performance(_series(v)).drop("months")
    return rounded(wide.unpivot(perf.KEY, [c for c in wide.columns if c not in perf.KEY], "statistic", "value").dropna(subset=["value"]))


@query
def meta_row(v: Views) -> DataFrame:
    filed = v.filings()
    out = research.meta(filed, _qa(v), similarity.consecutive_pairs(filed), v.spark.createDataFrame([], "signal string, date date"))
    return out.select(F.col("companies_in_universe").alias("companies"), "filings_parsed", "year_over_year_pairs", "first_filing", "last_filing")


@query
def company_history(v: Views) -> DataFrame:
    return rounded(_panel(v).filter("ticker = 'T000003'").select("ticker", "filing_date", "full_cosine", "full_jaccard"))


@query
def status_counts(v: Views) -> DataFrame:
    status = F.when(F.col("error") == "", F.lit("ok")).otherwise(F.substring_index("error", ":", 1))
    return _qa(v).groupBy(status.alias("status")).agg(F.count("*").alias("filings"))


@query
def signal_labels(v: Views) -> DataFrame:
    return _signals(v).select("signal").distinct().withColumn("label", perf.label(F.col("signal")))


@query
def factor_models(v: Views) -> DataFrame:
    """The models of several factors on the two signals that SQL can follow."""
    models = {k: m for k, m in perf.MODELS.items() if len(m) > 1}
    out = perf.factor_regression(_series(v), v.factors(), models)
    return rounded(out.select(*perf.KEY, "model", "months", "alpha_monthly_bps", "alpha_t", "r2"))


@query
def hold_alpha(v: Views) -> DataFrame:
    """The six-factor alpha that hold_robustness leaves out."""
    out = research.robustness(_signals(v), v.returns(), v.factors(), portfolio.COST_BPS, _min_names(v), primary=("full_cosine", "full_jaccard"))
    return rounded(out.select("signal", "hold_months", "months", "alpha_monthly_bps", "alpha_t"))


@query
def similarity_describe(v: Views) -> DataFrame:
    panel = _panel(v)
    return rounded(perf.describe(panel, [c for c in panel.columns if c.endswith(("_cosine", "_jaccard"))]))


@query
def missing_tickers(v: Views) -> DataFrame:
    universe = v.table("customer").select(v.ticker(F.col("c_custkey")).alias("ticker"))
    return market.missing_tickers(universe, v.returns())


@query
def meta_months(v: Views) -> DataFrame:
    """meta_row() with the months of the first primary signal's portfolios."""
    filed = v.filings()
    out = research.meta(filed, _qa(v), similarity.consecutive_pairs(filed), _portfolios(v))
    return out.select(F.col("companies_in_universe").alias("companies"), "filings_parsed", "year_over_year_pairs", "first_filing", "last_filing", "return_months")


@whole
def semantic_changes(v: Views) -> DataFrame:
    """The passages of each pair that changed most."""
    return rounded(semantic.semantic_panel(_panel(v), v.sections())[1])


@whole
def signals_all(v: Views) -> DataFrame:
    return rounded(_every_signal(v))


@whole
def live_signal_all(v: Views) -> DataFrame:
    return rounded(portfolio.live_signal(_every_signal(v), v.returns()))


@whole
def quantile_assignment_all(v: Views) -> DataFrame:
    return _every_quantile(v)


@whole
def quantile_returns_all(v: Views) -> DataFrame:
    return rounded(portfolio.quantile_returns(_every_quantile(v), v.returns()))


@whole
def portfolio_returns_all(v: Views) -> DataFrame:
    """What long_short and turnover_net show."""
    return rounded(_every_portfolio(v))


@whole
def performance_stats_all(v: Views) -> DataFrame:
    return rounded(perf.performance(_every_series(v)))


@whole
def newey_west_t_all(v: Views) -> DataFrame:
    return rounded(perf.newey_west(_every_series(v)))


@whole
def capm_regression_all(v: Views) -> DataFrame:
    return rounded(perf.capm(_every_series(v), v.factors()))


@whole
def quintile_means_all(v: Views) -> DataFrame:
    return rounded(perf.quantile_means(_every_portfolio(v), SAMPLES))


@whole
def hold_robustness_all(v: Views) -> DataFrame:
    """The primary signals of the design, with both alpha columns."""
    return rounded(research.robustness(_every_signal(v), v.returns(), v.factors(), portfolio.COST_BPS, portfolio.MIN_NAMES))


@whole
def research_tables_long_all(v: Views) -> DataFrame:
    wide = perf.performance(_every_series(v)).drop("months")
    return rounded(wide.unpivot(perf.KEY, [c for c in wide.columns if c not in perf.KEY], "statistic", "value").dropna(subset=["value"]))


def flagship(spark: SparkSession, sf_dir: str, min_names: int = portfolio.MIN_NAMES) -> DataFrame:
    """Text change to long-short returns, net of costs."""
    return _every_portfolio(Views(spark, sf_dir), min_names)
