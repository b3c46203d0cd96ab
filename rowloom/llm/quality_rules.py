"""Quality rules (10): rules on each text, and a verdict on each host by an empirical beta prior.

Every step is a DataFrame expression. A document fails by its own text (few words, much repetition).
Failures are then counted per host; each host's failure rate is shrunk towards the mean of all hosts by
a beta prior whose two parameters come from the moments of the host rates; a host whose shrunk rate is
nearer to 1 than to the prior's mean rejects its documents.

Cases: null text has no words and fails; a null host has no verdict; repeated rows each give a row;
an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import SPACES, small, stored, table, text_or_empty
from rowloom.llm.sliding import gram_hashes

MIN_WORDS = 10
#: Percent of the words that may stand in repeated windows.
MAX_REPEAT_PCT = 20
WINDOW = 5
#: Characters of a text that is short, in quality_rules_by_kind.
SHORT = 70
#: How far from the prior's mean to 1 a host's shrunk rate may lie.
TO_ONE = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """The runs of characters other than white space."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def covered(starts: Column, width: int) -> Column:
    """Positions that windows of this width cover, given their sorted starts."""
    gaps = F.zip_with(starts, F.slice(starts, 2, F.size(starts)), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width))))
    return F.aggregate(gaps, F.lit(0).cast("long"), lambda acc, x: acc + x)


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of COUNTS, computed in the JVM in one narrow pass."""
    t = text_or_empty(text)
    df = docs.withColumn("_w", words_of(t))
    df = df.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    df = df.withColumn("_g", gram_hashes(F.col("_h"), WINDOW))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    df = df.withColumn("_l", lines)
    # Only texts with a repeated window sort their windows.
    repeated = F.size(F.array_distinct("_g")) < F.size("_g")
    pairs = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    df = df.withColumn("_s", F.when(repeated, pairs))
    nxt = F.zip_with("_s", F.slice("_s", 2, F.size("_s")), lambda a, b: F.coalesce(a["g"] == b["g"], F.lit(False)))
    df = df.withColumn("_n", nxt)
    prev = F.concat(F.array(F.lit(False)), F.slice("_n", 1, F.size("_n") - 1))
    flag = F.zip_with("_n", prev, lambda a, b: a | F.coalesce(b, F.lit(False)))
    starts = F.filter(F.zip_with("_s", flag, lambda a, f: F.when(f, a["i"])), lambda x: x.isNotNull())
    df = df.withColumn("_p", F.when(F.col("_s").isNotNull(), F.sort_array(starts)))
    return df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.translate(t, SPACES, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "n_repeat_words": F.when(F.col("_p").isNull(), F.lit(0).cast("long")).otherwise(covered(F.col("_p"), WINDOW)),
        }
    ).drop("_w", "_h", "_g", "_l", "_s", "_n", "_p")


def host_of(source: Column) -> Column:
    """The domain of a URL, or a bare source name as it is."""
    s = F.lower(source.cast("string"))
    return F.when(s.contains("://"), F.nullif(F.regexp_extract(s, r"://(?:[^/@]*@)?([^/:?#]*)", 1), F.lit(""))).otherwise(s)


def beta_prior(mean: float | None, var: float | None, n_mean: float | None) -> tuple[float, float]:
    """(alpha, beta) by the method of moments on host rates. The part of the variance that sampling
    explains is taken off first; where nothing is left, or the moments fit no beta, the prior
    weighs 1000 documents, so that hosts are pulled strongly to the mean."""
    if mean is None:
        return 1.0, 1.0
    m = min(max(mean, 1e-6), 1 - 1e-6)
    between = (var or 0.0) - m * (1 - m) / max(n_mean or 1.0, 1.0)
    weight = m * (1 - m) / between - 1 if between > 0 else 1000.0
    weight = min(max(weight, 2.0), 1000.0)
    return m * weight, (1 - m) * weight


def host_verdicts(base: DataFrame, to_one: float = TO_ONE) -> DataFrame:
    """host, n_docs, n_failed, rate (shrunk), host_failed; one row per host. base has host and base_failed."""
    hosts = base.where(F.col("host").isNotNull()).groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    hosts = stored(hosts, "hosts")
    raw = F.col("n_failed") / F.col("n_docs")
    # One row: hosts weigh alike in the moments, and the harmonic mean of their sizes sets the sampling part.
    m = hosts.agg(F.avg(raw).alias("m"), F.var_pop(raw).alias("v"), (F.count(F.lit(1)) / F.sum(F.lit(1.0) / F.col("n_docs"))).alias("n")).first()
    alpha, beta = beta_prior(m["m"], m["v"], m["n"])
    rate = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    mean = alpha / (alpha + beta)
    return hosts.withColumn("rate", rate).withColumn("host_failed", F.col("rate") >= mean + to_one * (1 - mean))


def judge(docs: DataFrame, text: str = "text", host: str = "source", to_one: float = TO_ONE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, COUNTS, base_failed, host_rate and kept; one row per document."""
    own = docs.select(*[F.col(c).alias(f"_keep_{c}") for c in keep], F.col(text).alias("_text"), host_of(F.col(host)).alias("host"))
    base = text_counts(own, "_text").drop("_text")
    base = base.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))
    base = stored(base, "rules")
    verdicts, _ = small(host_verdicts(base, to_one).select("host", "rate", "host_failed"))
    out = base.join(verdicts, "host", "left")
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("host_failed"), F.lit(False))
    return out.select(*[F.col(f"_keep_{c}").alias(c) for c in keep], *COUNTS, "base_failed", F.col("rate").alias("host_rate"), kept.alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("host_rate")


def quality_rules_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules with hosts that differ: the short texts are a host of their own, and most of them fail. Those that pass
    are rejected with their host. host_rate is the host's shrunk rate."""
    docs = table(spark, sf_dir, "documents")
    kind = F.when(F.length(text_or_empty("text")) < SHORT, F.lit("short")).otherwise(F.col("source"))
    return judge(docs.select("doc_id", "text", kind.alias("source"))).withColumn("host_rate", F.round("host_rate", 6))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass. The verdict comes with the row through `keep`, so rows that share
    an id stay apart."""
    return judge(docs, keep=tuple(docs.columns)).where("kept").select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, lower(source) AS host FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), win AS (
  SELECT rid, i, array_to_string(ws[i:i+4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 1))) AS u(i)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n >= 2
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(0, 5) AS r(k) GROUP BY rid
), lines AS (
  SELECT rid, l, count(*) AS n FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid, l
), dup AS (
  SELECT rid, sum(n - 1) AS n_dup_lines FROM lines GROUP BY rid
), b AS (
  SELECT w.rid, doc_id, host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b
), h AS (
  SELECT host, count(*) AS n, sum(base_failed::INT) AS k FROM f WHERE host IS NOT NULL GROUP BY host
), mo AS (
  SELECT greatest(least(avg(k / n), 1 - 1e-6), 1e-6) AS m, var_pop(k / n) AS v, count(*) / sum(1.0::DOUBLE / n) AS nm FROM h
), bt AS (
  SELECT m, v - m * (1 - m) / greatest(nm, 1) AS between_v FROM mo
), pr AS (
  SELECT m, greatest(least(CASE WHEN between_v > 0 THEN m * (1 - m) / between_v - 1 ELSE 1000 END, 1000), 2) AS wt FROM bt
), v AS (
  SELECT host, (k + m * wt) / (n + wt) >= (1 + m) / 2 AS host_failed FROM h, pr
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(host_failed, false) AS kept
FROM f LEFT JOIN v USING (host)
"""

ORACLE_BY_KIND = (
    ORACLE.replace("lower(source) AS host", f"lower(CASE WHEN length(coalesce(text, '')) < {SHORT} THEN 'short' ELSE source END) AS host")
    .replace("SELECT host, (k + m", "SELECT host, round((k + m * wt) / (n + wt), 6) AS host_rate, (k + m")
    .replace("  NOT base_failed AND", "  host_rate, NOT base_failed AND")
)
