"""Benchmark decontamination (5) by winnowing, in DataFrame expressions.

Texts become words, words become hashes, and each run of K hashes a gram. Of each WINDOW consecutive grams the
least is kept as a fingerprint, so that two texts that share K + WINDOW - 1 = SPAN words share a
fingerprint of that span. Documents' and benchmark's fingerprints are joined; for documents with a match,
each match is extended along its diagonal (document place less item place): the item is laid over the
document there, and every run of SPAN equal words is an occurrence. Items of fewer words are one window
each; for each such length all runs of that length are fingerprints, and the extension compares the item's
words.

No text is shuffled: the fingerprint join broadcasts the benchmark's side while its counted rows and bytes stay
within bounds, and the second pass over documents joins the counted matches in the same way. Beyond the
bounds the joins are shuffled, fingerprints and diagonals without words, and adaptive execution splits hot fingerprints.
A diagonal of an item in a document is laid out once, however many fingerprints lie on it.

Cases: null and empty texts have no words; rows equal in id and text each give the same result row; a null
doc_id is an id of its own; items that repeat count by item_id, an item without id hits but isn't listed;
an empty benchmark hits nothing; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rowloom.llm.common import small, stored, table, text_or_empty
from rowloom.llm.sliding import gram_hashes, sliding

K, WINDOW = 5, 6
SPAN = K + WINDOW - 1
#: Rows of the benchmark's fingerprints, and of matched documents, that are broadcast at most.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the document itself among its fingerprints.
OWN_ROW = -(1 << 63)


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and characters beyond ASCII."""
    return F.array_remove(F.split(F.translate(text, UPPER, LOWER), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _salted(grams: Column, length: int) -> Column:
    """Grams of another length are another family."""
    return F.transform(grams, lambda g: F.xxhash64(g, F.lit(length)))


def fingerprints(hashes: Column, short: list[int]) -> Column:
    """Distinct fingerprints of an array of word hashes; short: lengths of items that have fewer than SPAN words."""
    kept = sliding(gram_hashes(hashes, K), WINDOW, lambda a, b: F.least(a, b))
    return F.array_distinct(F.concat(kept, *[_salted(gram_hashes(hashes, n), n) for n in short]))


def places(hashes: Column, short: list[int]) -> Column:
    """All grams as an array of (fp, at): what a fingerprint of the other side may be found at."""
    own = F.transform(gram_hashes(hashes, K), lambda g, i: F.struct(g.alias("fp"), i.alias("at")))
    more = [F.transform(gram_hashes(hashes, n), lambda g, i: F.struct(F.xxhash64(g, F.lit(n)).alias("fp"), i.alias("at"))) for n in short]
    return F.concat(own, *more)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item, item_id, iw (words), span: the distinct items that have words."""
    rows = benchmark.select(F.col("item_id"), text_or_empty("text").alias("t")).distinct()
    rows = rows.select("item_id", words(F.col("t")).alias("iw")).where(F.size("iw") > 0)
    return rows.select(F.xxhash64("item_id", F.array_join("iw", " ")).alias("item"), "item_id", "iw", F.least(F.size("iw"), F.lit(SPAN)).alias("span"))


def seeds_of(items: DataFrame, short: list[int]) -> DataFrame:
    """fp, item, ipos, n (words of the item): the fingerprints of the items, with all their places."""
    h = items.withColumn("ih", F.transform("iw", lambda w: F.xxhash64(w)))
    kept = h.withColumn("kept", fingerprints(F.col("ih"), short)).withColumn("g", F.explode(places(F.col("ih"), short)))
    return kept.where(F.array_contains("kept", F.col("g.fp"))).select(F.col("g.fp").alias("fp"), "item", F.col("g.at").alias("ipos"), F.size("iw").alias("n"))


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """d, k (together the identity of a document: its id, and a hash of id and text) and the text."""
    t = text_or_empty(text)
    return docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")).alias("d"), F.xxhash64("doc_id", t).alias("k"), "doc_id", t.alias("t"))


def hits(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, spans). documents: d, k, doc_id, n_words, n_rows (equal rows), one row per distinct
    document. spans: d, k, item, item_id, start, span, one row per occurrence of a window of an item."""
    items = stored(items_of(benchmark), "items")
    short = sorted(r["span"] for r in items.select("span").distinct().collect() if r["span"] < SPAN)
    seeds = stored(seeds_of(items, short), "seeds")
    fps, _ = small(seeds.select("fp").distinct(), BROADCAST_ROWS)
    rows = keyed(docs).withColumn("w", words(F.col("t")))
    rows = rows.withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
    # A row for the document itself, and one for each fingerprint; only those that match go on.
    each = rows.select("d", "k", "doc_id", F.size("w").cast("long").alias("n_words"), F.explode(F.concat(F.array(F.lit(OWN_ROW)), fingerprints(F.col("h"), short))).alias("fp"))
    each = each.join(fps.select("fp", F.lit(True).alias("hit")), "fp", "left").where(F.col("hit") | (F.col("fp") == OWN_ROW))
    documents = each.groupBy("d", "k", "doc_id").agg(F.max("n_words").alias("n_words"), F.sum((F.col("fp") == OWN_ROW).cast("long")).alias("n_rows"), F.count("hit").alias("n_seeds"))
    documents = stored(documents, "fingerprinted")
    matched, _ = small(documents.where("n_seeds > 0").select("d", "k"), BROADCAST_ROWS)
    again = keyed(docs).join(matched, ["d", "k"], "left_semi").dropDuplicates(["d", "k"]) if _repeats(documents) else keyed(docs).join(matched, ["d", "k"], "left_semi")
    again = stored(again.select("d", "k", words(F.col("t")).alias("w")), "matched")
    found = again.select("d", "k", F.explode(places(F.transform("w", lambda w: F.xxhash64(w)), short)).alias("g"))
    found = found.select("d", "k", F.col("g.fp").alias("fp"), F.col("g.at").alias("dpos")).join(small(seeds, BROADCAST_ROWS)[0], "fp")
    # Words stay behind until each diagonal is known once; then each takes the words that its item lies over, and no more.
    diagonals = stored(found.select("d", "k", "item", "n", (F.col("dpos") - F.col("ipos")).alias("diagonal")).distinct(), "diagonals")
    diagonal, first = F.col("diagonal"), F.greatest("diagonal", F.lit(0))
    laid = again.join(small(diagonals, BROADCAST_ROWS, F.octet_length("d") + 40)[0], ["d", "k"]).select("d", "k", "item", "diagonal", F.slice("w", first + 1, F.col("n")).alias("w"))
    laid = laid.join(small(items, BROADCAST_ROWS, F.octet_length(F.array_join("iw", " ")) + 8 * F.size("iw"))[0], "item")
    laid = laid.withColumn("eq", F.transform("iw", lambda x, j: F.coalesce(F.get("w", j + diagonal - first) == x, F.lit(False))))
    whole = F.forall("eq", lambda x: x)
    runs = sliding(F.col("eq"), SPAN, lambda a, b: a & b)
    starts = F.filter(F.transform(runs, lambda x, j: F.when(x, j + diagonal)), lambda x: x.isNotNull())
    starts = F.when(F.col("span") < SPAN, F.when(whole, F.array(diagonal)).otherwise(F.array().cast("array<int>"))).otherwise(starts)
    spans = laid.select("d", "k", "item", "item_id", F.explode(starts).alias("start"), "span").distinct()
    return documents, spans


def _repeats(documents: DataFrame) -> bool:
    return documents.where("n_rows > 1").limit(1).count() > 0


def summary(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and d, k)."""
    order = Window.partitionBy("d", "k").orderBy("start", "span", "item")
    before = F.max(F.col("start") + F.col("span")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("start") + F.col("span") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))), F.lit(0))
    per = spans.withColumn("new", new).groupBy("d", "k").agg(F.sum("new").cast("long").alias("hit"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    out = documents.join(per, ["d", "k"], "left")
    ids = F.coalesce(F.col("ids"), F.array().cast("array<string>"))
    out = out.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    n_hit = F.coalesce(F.col("hit"), F.lit(0).cast("long"))
    return out.select("d", "k", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary(*hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))).drop("d", "k")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a window of the benchmark occurs."""
    _, spans = hits(docs, table(spark, sf_dir, "benchmark"))
    bad, _ = small(stored(spans.select("d", "k").distinct(), "contaminated"), BROADCAST_ROWS)
    t = text_or_empty("text")
    d, k = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0")), F.xxhash64("doc_id", t)
    own = docs.select(F.struct(*docs.columns).alias("row"), d.alias("d"), k.alias("k"))
    return own.join(bad, ["d", "k"], "left_anti").select("row.*")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), s AS (
  SELECT DISTINCT least(len(ws), 10) AS span FROM b WHERE len(ws) > 0
), bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS span, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
  FROM b, unnest(range(1, greatest(len(ws) - least(len(ws), 10) + 2, 1))) AS u(i) WHERE len(ws) > 0
), dw AS (
  SELECT rid, span, i, array_to_string(ws[i:i + span - 1], ' ') AS g FROM d, s, unnest(range(1, greatest(len(ws) - span + 2, 1))) AS u(i)
), h AS (
  SELECT DISTINCT rid, span, i, item_id FROM dw JOIN bw USING (span, g)
), n AS (
  SELECT rid, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, span)) AS u(j) GROUP BY rid
), m AS (
  SELECT rid, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT rid, item_id::VARCHAR AS id FROM h WHERE item_id IS NOT NULL) GROUP BY rid
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (rid) LEFT JOIN m USING (rid)
"""
