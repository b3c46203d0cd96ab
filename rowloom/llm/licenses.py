"""License scan (4), in DataFrame expressions: MinHash bands over overlapping windows, then exact containment.

Words become hashes and each run of GRAM words a shingle (a template of fewer words has one). Templates come at two scales:

* whole texts (WHOLE shingles or more): windows of WINDOW shingles, in a text one every STEP, in a template at every place. A window's
  MinHash under each of BANDS functions is a band of one row, so windows of Jaccard similarity J fall together with probability
  1 - (1 - J)^BANDS. A window of which the share CONTAINED is the template's has J >= CONTAINED / (2 - CONTAINED) = 2/3, and BANDS is the least number that
  misses such a window once in a thousand times; an untouched text has a window that is the template's, which is found for sure.
* notices: windows of NOTICE shingles (of their own number if that is less) at every place. Where an edit leaves CONTAINED of the
  shingles there is a window without one, as each edited word spoils four or five shingles; so these are found for sure.

Templates retrieved for a text are verified: the share CONTAINED of the template's distinct shingles stands within a stretch of the text
that is SPAN times as long as the template. Of two matches of which one lies in the other's place, with fewer shingles, the other is kept
(a license that another one quotes whole).

The template table is a parameter of a few hundred rows (its size is counted before it is broadcast); texts
are not shuffled, the matched ones are read again. Cases: null and empty texts have no license; rows equal in id
and text give equal rows; a template without a word is never found, equal templates are found alike; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import small, stored, table
from rowloom.llm.decontaminate import BROADCAST_ROWS, OWN_ROW, keyed, words
from rowloom.llm.license_texts import TEMPLATES
from rowloom.llm.sliding import gram_hashes, let, sliding

GRAM, CONTAINED, SPAN = 5, 0.8, 1.25
STEP, NOTICE = 16, 3
WINDOW = 3 * STEP
#: So many shingles hold a window of a text wherever they begin.
WHOLE = WINDOW + STEP - 1
MISSED = 1e-3
BANDS = math.ceil(math.log(MISSED) / math.log(1 - CONTAINED / (2 - CONTAINED)))


def templates(spark: SparkSession, rows=TEMPLATES) -> DataFrame:
    """template (number), license, text."""
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(rows)], "template int, license string, text string")


def shingles(hashes: Column, n: int = GRAM) -> Column:
    """Hashes of the runs of n words; those of other lengths than GRAM are another family."""
    g = gram_hashes(hashes, n)
    return g if n == GRAM else F.transform(g, lambda x: F.xxhash64(x, F.lit(n)))


def _least(a: Column, b: Column) -> Column:
    return F.least(a, b)


def _hashed(g: Column, j: int, scale: int) -> Column:
    return F.transform(g, lambda x: F.xxhash64(x, F.lit(j * 64 + scale)))


def notice_bands(g: Column, window: int) -> Column:
    """Bands of all windows of so many shingles. One function does for a window of one."""
    return F.concat(*[sliding(_hashed(g, j, window), window, _least) for j in range(3 if window > 1 else 1)])


def whole_bands(g: Column, every: bool) -> Column:
    """Bands of the windows of WINDOW shingles, at every place or at every STEP."""

    def one(j: int) -> Column:
        if every:
            return sliding(_hashed(g, j, 63), WINDOW, _least)
        chunks = F.sequence(F.lit(0), F.floor((F.size(g) - 1) / STEP).cast("int"))
        least = let(_hashed(g, j, 63), lambda x: F.transform(chunks, lambda c: F.array_min(F.slice(x, c * STEP + 1, STEP))))
        return F.when(F.size(g) > WINDOW - STEP, sliding(least, WINDOW // STEP, _least)).otherwise(F.array().cast("array<long>"))

    return F.concat(*[one(j) for j in range(BANDS)])


def known(licenses: DataFrame) -> DataFrame:
    """template, license, n_words, g (its shingles in order), tg (distinct): templates with a word."""
    h = F.transform(words(F.coalesce("text", F.lit(""))), lambda w: F.xxhash64(w))
    t = licenses.select("template", "license", h.alias("h")).withColumn("n_words", F.size("h")).where("n_words > 0")
    g = F.coalesce(*[F.when(F.col("n_words") == n, shingles(F.col("h"), n)) for n in range(1, GRAM)], shingles(F.col("h")))
    return t.select("template", "license", "n_words", g.alias("g")).withColumn("tg", F.array_distinct("g"))


def best_stretch(places: Column, tg: Column, length: Column) -> Column:
    """(n, at, end): the most distinct shingles of tg in a stretch of so many places, the first of the best, and where the last of them is."""
    hits = F.filter(places, lambda p: F.array_contains(tg, p["g"]))

    def most(x: Column) -> Column:
        def here(p: Column, i: Column) -> Column:
            near = F.filter(F.slice(x, i + 1, length), lambda q: q["i"] < p["i"] + length)
            return let(near, lambda y: F.struct(F.size(F.array_distinct(F.transform(y, lambda q: q["g"]))).alias("n"), (-p["i"]).alias("back"), F.array_max(F.transform(y, lambda q: q["i"])).alias("end")))

        return F.array_max(F.transform(x, here))

    return let(hits, most)


def scan(docs: DataFrame, licenses: DataFrame, contained: float = CONTAINED) -> tuple[DataFrame, DataFrame]:
    """(documents, matches). documents: d, k, doc_id, n_rows; matches: d, k, license, template, containment, at, end (words)."""
    t = stored(known(licenses), "templates")
    kinds = t.select(F.least("n_words", F.lit(GRAM)).alias("n"), F.when(F.size("g") >= WHOLE, F.lit(0)).otherwise(F.least(F.size("g"), F.lit(NOTICE))).alias("window")).distinct().collect()
    lengths, windows = sorted({r["n"] for r in kinds}), sorted({r["window"] for r in kinds if r["n"] == GRAM})
    none = F.array().cast("array<long>")
    own = F.when(F.size("g") >= WHOLE, whole_bands(F.col("g"), True) if 0 in windows else none)
    own = F.coalesce(own, *[F.when(F.least(F.size("g"), F.lit(NOTICE)) == v, notice_bands(F.col("g"), v)) for v in range(1, NOTICE + 1)])
    keys = stored(t.select(F.explode(F.array_distinct(own)).alias("band"), "template").distinct(), "bands")
    keys, _ = small(keys, BROADCAST_ROWS)
    h = F.transform(words(F.col("t")), lambda w: F.xxhash64(w))
    rows = keyed(docs).withColumn("h", h)
    for n in lengths:
        rows = rows.withColumn(f"g{n}", shingles(F.col("h"), n))
    found = [notice_bands(F.col(f"g{GRAM}"), v) if v else whole_bands(F.col(f"g{GRAM}"), False) for v in windows]
    found += [notice_bands(F.col(f"g{n}"), 1) for n in lengths if n < GRAM]
    each = rows.select("d", "k", "doc_id", F.explode(F.concat(F.array(F.lit(OWN_ROW)), F.array_distinct(F.concat(none, *found)))).alias("band"))
    each = each.join(keys, "band", "left").where(F.col("template").isNotNull() | (F.col("band") == OWN_ROW))
    seen = each.groupBy("d", "k", "doc_id", "template").agg(F.sum((F.col("band") == OWN_ROW).cast("long")).alias("n_rows"))
    seen = stored(seen, "retrieved")
    documents = seen.where("template is null").select("d", "k", "doc_id", "n_rows")
    pairs = seen.where("template is not null").select("d", "k", "template")
    matched, _ = small(stored(pairs.select("d", "k").distinct(), "matched"), BROADCAST_ROWS)
    places = [F.transform(shingles(F.col("h"), n), lambda x, i: F.struct(i.alias("i"), x.alias("g"))) for n in lengths]
    again = keyed(docs).join(matched, ["d", "k"], "left_semi").withColumn("h", h).select("d", "k", F.concat(F.array().cast("array<struct<i:int,g:bigint>>"), *places).alias("places"))
    body, _ = small(t.select("template", "license", "tg", F.ceil(SPAN * F.size("g")).cast("int").alias("length"), F.least("n_words", F.lit(GRAM)).alias("gram")), BROADCAST_ROWS)
    checked = again.join(small(pairs, BROADCAST_ROWS)[0], ["d", "k"]).join(body, "template")
    checked = checked.withColumn("best", best_stretch(F.col("places"), F.col("tg"), F.col("length"))).withColumn("containment", F.col("best.n") / F.size("tg"))
    checked = checked.where(F.col("containment") >= contained).select("d", "k", "license", "template", "containment", F.col("best.n").alias("n"), (-F.col("best.back")).alias("at"), (F.col("best.end") + F.col("gram")).alias("end")).distinct()
    checked = stored(checked, "checked")
    # Matches of one text are as few as templates.
    other = checked.select("d", "k", F.col("n").alias("n2"), F.col("at").alias("at2"), F.col("end").alias("end2"))
    inside = (checked["d"] == other["d"]) & (checked["k"] == other["k"]) & (F.col("at2") <= F.col("at")) & (F.col("end2") >= F.col("end")) & (F.col("n2") > F.col("n"))
    return documents, checked.join(other, inside, "left_anti").drop("n")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_licenses, licenses (names, sorted, comma-joined), n_templates: one row per document."""
    documents, matches = scan(table(spark, sf_dir, "documents"), templates(spark))
    per = matches.groupBy("d", "k").agg(F.sort_array(F.collect_set("license")).alias("names"), F.count_distinct("template").alias("n"))
    out = documents.join(per, ["d", "k"], "left").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n_rows"))))
    names = F.coalesce(F.col("names"), F.array().cast("array<string>"))
    return out.select("doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"), F.coalesce("n", F.lit(0).cast("long")).alias("n_templates"))


def _values() -> str:
    return ",\n    ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))


_WORDS = "regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: All stretches of all texts against all templates.
ORACLE = rf"""
WITH t(template, license, text) AS (VALUES
    {_values()}
), tw AS (
  SELECT template, license, {_WORDS.format("text")} AS ws FROM t
), tl AS (
  SELECT *, least(len(ws), 5) AS gram, ceil(1.25::DOUBLE * (len(ws) - least(len(ws), 5) + 1))::INT AS length FROM tw
), tg AS (
  SELECT DISTINCT template, license, gram, length, array_to_string(ws[i:i + gram - 1], ' ') AS g FROM tl, unnest(range(1, len(ws) - gram + 2)) AS u(i)
), size AS (
  SELECT template, count(*) AS m FROM tg GROUP BY template
), d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents
), dg AS (
  SELECT rid, gram, i - 1 AS i, array_to_string(ws[i:i + gram - 1], ' ') AS g FROM d, (SELECT DISTINCT gram FROM tl), unnest(range(1, greatest(len(ws) - gram + 2, 1))) AS u(i)
), hit AS (
  SELECT rid, template, license, dg.gram, length, dg.i, dg.g FROM dg JOIN tg USING (gram, g)
), many AS (
  SELECT hit.* FROM hit JOIN (SELECT rid, template FROM hit JOIN size USING (template) GROUP BY rid, template, m HAVING count(DISTINCT g) >= 0.8 * m) USING (rid, template)
), stretch AS (
  SELECT a.rid, a.template, a.license, a.gram, a.i, count(DISTINCT b.g) AS n, max(b.i) AS last
  FROM (SELECT DISTINCT rid, template, license, gram, length, i FROM many) a JOIN many b ON a.rid = b.rid AND a.template = b.template AND b.i >= a.i AND b.i < a.i + a.length GROUP BY ALL
), best AS (
  SELECT rid, template, license, n, i AS begins, last + gram AS ends FROM stretch JOIN size USING (template) WHERE n / m >= 0.8 QUALIFY row_number() OVER (PARTITION BY rid, template ORDER BY n DESC, i) = 1
), kept AS (
  SELECT * FROM best a WHERE NOT EXISTS (SELECT 1 FROM best b WHERE a.rid = b.rid AND b.begins <= a.begins AND b.ends >= a.ends AND b.n > a.n)
), p AS (
  SELECT rid, count(DISTINCT license) AS n_licenses, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(DISTINCT template) AS n_templates FROM kept GROUP BY rid
)
SELECT doc_id, coalesce(n_licenses, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(n_templates, 0)::BIGINT AS n_templates
FROM d LEFT JOIN p USING (rid)
"""
