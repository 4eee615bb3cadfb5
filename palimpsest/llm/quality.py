"""Quality rules on documents and on hosts, in DataFrame functions only.

Rules look at one text: too few words, repeated five-word windows (the base rules), many
symbols, repeated lines.  Failures of each rule, and of any of them, are then aggregated by
host (the source column), each host's failure rate is shrunk with a beta prior fitted to
all hosts by moments, and a host is rejected with all its documents if that rate is sure
(to 95 %, by the posterior's spread) to exceed `host_limit` for one rule or `any_limit` for
any of the rules, so a few documents condemn no host.  Host verdicts are joined back to the
documents.  Aggregation by host combines before it shuffles, so a host with a third of all
rows is no hot task; back to the documents go the rejected hosts only, broadcast where
their number is under `BROADCAST_HOSTS`, else with the host split by salts.

Defined results: a null or empty text has no words and fails; a null source is a host of
its own (shared with the empty string); if all hosts have one rate, or there is one host,
the prior pools completely; repeated rows are judged one by one; extra columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import as_text, saved, shared_dir

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
LEAST_WORDS, REPEAT_PERCENT, SYMBOL_PERCENT, LINE_PERCENT = 10, 20, 50, 50
STRONGEST = 1e6
RULES = ("short", "repeats", "symbols", "lines")
RATES = (*RULES, "any")
#: A host's shrunk rate of one rule's failures, and of any rule's, above which it is rejected; so many deviations above.
HOST_LIMIT, ANY_LIMIT, SURE = 0.3, 0.5, 1.645
#: Up to so many rejected hosts are broadcast (a host name is a few dozen bytes); beyond, so many salts split a host.
BROADCAST_HOSTS, SALTS = 200_000, 64
Q = "_pq_quality"


def _long(c: Column) -> Column:
    return c.cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """docs with a struct column of counts and rule failures."""
    text = as_text()
    df = docs.withColumn("_pq_w", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    n = F.size("_pq_w")
    grams = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get("_pq_w", i + j) for j in range(WINDOW)]))
    df = df.withColumn("_pq_g", F.when(n > WINDOW, grams))
    # Only texts with a repeated window pay for the sort that finds where the repeats stand.
    places = F.sort_array(F.transform("_pq_g", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_pq_s", F.when(F.size(F.array_distinct("_pq_g")) < F.size("_pq_g"), places))
    same = lambda x, i: F.coalesce(F.get("_pq_s", i)["h"] == x["h"], F.lit(False))
    at = F.transform("_pq_s", lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"]))
    df = df.withColumn("_pq_p", F.sort_array(F.filter(at, lambda i: i.isNotNull())))
    covered = F.aggregate(
        "_pq_p",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")),
    )["n"]
    df = df.withColumn("_pq_l", F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
    n_lines = F.size("_pq_l")
    df = df.withColumn(
        Q,
        F.struct(
            _long(n).alias("n_words"),
            _long(F.length(F.array_join("_pq_w", ""))).alias("word_chars"),
            _long(F.regexp_count(text, F.lit(SYMBOLS))).alias("n_symbols"),
            _long(n_lines - F.size(F.array_distinct("_pq_l"))).alias("n_dup_lines"),
            _long(F.coalesce(covered, F.lit(0))).alias("n_repeat_words"),
            _long(n_lines).alias("n_lines"),
        ),
    ).drop("_pq_w", "_pq_g", "_pq_s", "_pq_p", "_pq_l")
    q = F.col(Q)
    fails = {
        "short": q["n_words"] < LEAST_WORDS,
        "repeats": 100 * q["n_repeat_words"] > REPEAT_PERCENT * q["n_words"],
        "symbols": 100 * q["n_symbols"] > SYMBOL_PERCENT * q["n_words"],
        "lines": 100 * q["n_dup_lines"] > LINE_PERCENT * q["n_lines"],
    }
    fails["any"] = fails["short"] | fails["repeats"] | fails["symbols"] | fails["lines"]
    return df.withColumn(Q, F.struct(F.col(f"{Q}.*"), *(v.alias(k) for k, v in fails.items())))


def host_of(column: str = "source") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def host_verdicts(judged: DataFrame, host_limit: float = HOST_LIMIT, any_limit: float = ANY_LIMIT) -> DataFrame:
    """Per host: host, n, rejected, and the shrunk rate of each rule and of any."""
    counts = judged.groupBy(host_of().alias("host")).agg(F.count("*").alias("n"), *(F.sum(F.col(f"{Q}.{r}").cast("long")).alias(r) for r in RATES))
    moments = counts.agg(*(f(F.col(r) / F.col("n")).alias(f"{r}_{m}") for r in RATES for m, f in (("mean", F.avg), ("var", F.var_samp))))
    hosts = counts.withColumn("one", F.lit(1)).join(F.broadcast(moments.withColumn("one", F.lit(1))), "one")  # a single row
    rates, least = {}, {}
    for r in RATES:
        mean, var = F.col(f"{r}_mean"), F.col(f"{r}_var")
        fitted = F.least(F.greatest(F.try_divide(mean * (1 - mean), var) - 1, F.lit(1.0)), F.lit(STRONGEST))
        strength = F.coalesce(fitted, F.lit(STRONGEST))
        rates[r] = rate = (F.col(r) + mean * strength) / (F.col("n") + strength)
        least[r] = rate - SURE * F.sqrt(F.greatest(rate * (1 - rate), F.lit(0.0)) / (F.col("n") + strength + 1))
    rejected = F.lit(False)
    for r in RATES:
        rejected = rejected | (least[r] > (any_limit if r == "any" else host_limit))
    return hosts.select("host", "n", rejected.alias("rejected"), *(rate.alias(f"{r}_rate") for r, rate in rates.items()))


def _judged(docs: DataFrame, columns: list[str], host_limit: float, any_limit: float) -> DataFrame:
    """columns of docs with the counts and both verdicts.  Measures once: what two
    later steps need is written, then read back."""
    folder = shared_dir(docs.sparkSession)
    judged = saved(measured(docs).select(*columns, Q), folder, "judged")
    gone = host_verdicts(judged, host_limit, any_limit).filter("rejected").select(F.col("host").alias("_pq_host"), F.lit(True).alias("_pq_rejected"))
    gone = saved(gone, folder, "rejected")
    out = judged.withColumn("_pq_base_failed", F.col(f"{Q}.short") | F.col(f"{Q}.repeats"))
    if gone.count() <= BROADCAST_HOSTS:
        out = out.join(F.broadcast(gone), host_of() == F.col("_pq_host"), "left")
    else:
        gone = gone.withColumn("_pq_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = (F.monotonically_increasing_id() % SALTS).cast("int")
        out = out.withColumn("_pq_of", salt).join(gone, (host_of() == F.col("_pq_host")) & (F.col("_pq_of") == F.col("_pq_salt")), "left")
    return out.withColumn("_pq_kept", ~F.col("_pq_base_failed") & F.col("_pq_rejected").isNull())


def quality_report(docs: DataFrame, host_limit: float = HOST_LIMIT, any_limit: float = ANY_LIMIT) -> DataFrame:
    """Per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    judged = _judged(docs, ["doc_id", "source"], host_limit, any_limit)
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *(F.col(f"{Q}.{c}").alias(c) for c in counts), F.col("_pq_base_failed").alias("base_failed"), F.col("_pq_kept").alias("kept"))


def only_kept(docs: DataFrame, host_limit: float = HOST_LIMIT, any_limit: float = ANY_LIMIT) -> DataFrame:
    """The rows of docs that the rules keep, columns unchanged."""
    return _judged(docs, docs.columns, host_limit, any_limit).filter("_pq_kept").select(*docs.columns)


#: The same in DuckDB SQL, for documents with distinct ids.
SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), grams AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1
), repeated AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(5) AS r(j) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(DISTINCT line) AS n_distinct
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), q AS (
  SELECT w.doc_id, host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_lines - n_distinct, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(repeated.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines
  FROM w LEFT JOIN repeated USING (doc_id) LEFT JOIN lines USING (doc_id)
), f AS (
  SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats,
         100 * n_symbols > 50 * n_words AS symbols, 100 * n_dup_lines > 50 * n_lines AS lines
  FROM q
), h AS (
  SELECT host, count(*) AS n, avg(CAST(short AS INT)) AS r1, avg(CAST(repeats AS INT)) AS r2,
         avg(CAST(symbols AS INT)) AS r3, avg(CAST(lines AS INT)) AS r4, avg(CAST(short OR repeats OR symbols OR lines AS INT)) AS r5
  FROM f GROUP BY host
), rates AS (
  SELECT host, n, unnest([r1, r2, r3, r4, r5]) AS rate, unnest([1, 2, 3, 4, 5]) AS rule FROM h
), prior AS (
  SELECT rule, avg(rate) AS m,
         coalesce(least(greatest(avg(rate) * (1 - avg(rate)) / nullif(var_samp(rate), 0) - 1, 1), 1e6), 1e6) AS strength
  FROM rates GROUP BY rule
), shrunk AS (
  SELECT host, rule, n + strength + 1 AS weight, (rate * n + m * strength) / (n + strength) AS rate FROM rates JOIN prior USING (rule)
), verdict AS (
  SELECT host, bool_or(rate - 1.645 * sqrt(greatest(rate * (1 - rate), 0) / weight) > CASE WHEN rule = 5 THEN 0.5 ELSE 0.3 END) AS rejected
  FROM shrunk GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (short OR repeats) AS base_failed, NOT (short OR repeats) AND NOT rejected AS kept
FROM f JOIN verdict USING (host)
"""
