"""Quality rules on words, symbols and repeats, and on lines that many documents of a host share.

DataFrame functions only. Lines are split at ``\\n``; a line is normalised by lower case and
single spaces between words, and hashed. For every host (``source``) the distinct documents
of each line are counted. The limit of a host is ``share`` of its documents, but not under
``least_docs`` nor over ``most_docs``, so that on a hot host too a line in more than
``most_docs`` documents goes. The words of lines above it are removed, and a document left
with less than ``keep_share`` of its words is rejected as depleted.

Rows: a null text has no words, lines or symbols and fails the base rules. A null source is
a host of its own. Rows that share a doc_id count as one document of their host; a row with a
null doc_id counts by itself. Extra columns are ignored. An empty table gives an empty result.
Long texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.shared import cut

WORD = r"[^\x20\x09-\x0D]"
SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
REPEAT_WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
LEAST_DOCS, MOST_DOCS = 20, 200
SHARE = 0.002
KEEP_SHARE = 0.5


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def line_hash(line: Column) -> Column:
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(line), f"{SPACE}+", " ")))


def lines_of(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def _shifted(column: str, by: int = 2) -> Column:
    """The array from its second element on."""
    return F.slice(column, by, F.greatest(F.size(column) - by + 1, F.lit(0)))


def base_rules(docs: DataFrame) -> DataFrame:
    """docs with the base columns and ``_lines``, the structs (h, w) of the lines that have a word.

    Each step is a column of its own: an array that a lambda looks into must not be built anew per element.
    """
    n = REPEAT_WINDOW
    text = F.coalesce("text", F.lit(""))
    hashes = F.transform(F.sequence(F.lit(1), F.size("_words") - n + 1), lambda i: F.xxhash64(F.slice("_words", i, F.lit(n))))
    step = docs.withColumn("_words", words_of(text)).withColumn("n_words", F.size("_words").cast("long"))
    step = step.withColumn("_windows", F.when(F.col("n_words") > n, hashes)).drop("_words")
    # places of windows that occur twice or more, found among neighbours in order of hash; most texts have none
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step = step.withColumn("_placed", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed)).drop("_windows")
    step = step.withColumn("_next", F.zip_with("_placed", _shifted("_placed"), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))))
    either = F.zip_with("_next", F.concat(F.array(F.lit(False)), "_next"), lambda x, y: F.coalesce(x, F.lit(False)) | y)
    step = step.withColumn("_at", F.array_sort(F.array_compact(F.zip_with("_placed", either, lambda x, y: F.when(y, x["i"])))))
    covered = F.zip_with("_at", _shifted("_at"), lambda x, y: F.coalesce(F.least(y - x, F.lit(n)), F.lit(n)))
    step = step.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"))
    step = step.drop("_placed", "_next", "_at").withColumn("_raw", lines_of(text))
    step = step.select(
        *docs.columns,
        "n_words",
        F.char_length(F.regexp_replace(text, f"{SPACE}+", "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.regexp_replace(text, SYMBOL, ""))).cast("long").alias("n_symbols"),
        (F.size("_raw") - F.size(F.array_distinct("_raw"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.transform("_raw", lambda x: F.struct(line_hash(x).alias("h"), F.size(words_of(x)).alias("w"))).alias("_lines"),
    )
    few = F.col("n_words") < LEAST_WORDS
    return step.withColumn("base_failed", few | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))


def line_rules(
    docs: DataFrame,
    least_docs: int = LEAST_DOCS,
    most_docs: int = MOST_DOCS,
    share: float = SHARE,
    keep_share: float = KEEP_SHARE,
    with_text: bool = False,
) -> DataFrame:
    """doc_id, the base columns, n_common_words, base_failed and kept of every row.

    ``with_text`` adds clean_text, the text without the lines above the limits.
    """
    host = F.xxhash64("source", F.col("source").isNull())
    slim = docs.select("doc_id", "text", host.alias("_host"))
    base = base_rules(slim).withColumn("_row", F.monotonically_increasing_id())
    base = cut(base if with_text else base.drop("text"))  # from here on row numbers stand still
    document = F.struct("doc_id", F.when(F.col("doc_id").isNull(), F.col("_row")).alias("row"))
    each = base.select("_host", document.alias("_doc"), F.explode(F.array_distinct(F.transform("_lines", lambda x: x["h"]))).alias("h"))
    hosts = base.groupBy("_host").agg(F.count_distinct(document).alias("docs"))
    often = each.groupBy("_host", "h").agg(F.count_distinct("_doc").alias("n")).where(F.col("n") > least_docs)
    limit = F.least(F.lit(most_docs), F.greatest(F.lit(least_docs), F.col("docs") * share))
    common = cut(often.join(hosts, "_host").where(F.col("n") > limit).select("_host", "h"))
    lines = base.select("_row", "_host", F.explode("_lines").alias("_line")).select("_row", "_host", "_line.h", "_line.w")
    removed = lines.join(common, ["_host", "h"]).groupBy("_row").agg(F.sum("w").alias("_gone"), F.collect_set("h").alias("_common"))
    out = base.join(removed if with_text else removed.drop("_common"), "_row", "left")
    out = out.withColumn("n_common_words", F.coalesce("_gone", F.lit(0)).cast("long"))
    left = F.col("n_words") - F.col("n_common_words")
    out = out.withColumn("kept", ~F.col("base_failed") & (left >= keep_share * F.col("n_words")))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_common_words", "base_failed", "kept"]
    if with_text:
        gone = F.coalesce("_common", F.array().cast("array<bigint>"))
        kept = F.filter(F.split("text", "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains(gone, line_hash(x))))
        return out.select(*columns, F.array_join(kept, "\n").alias("clean_text"))
    return out.select(*columns)


def op3(spark, sf_dir: str) -> DataFrame:
    """The op3 contract over the whole documents table."""
    return line_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP3_SQL = rf"""
WITH d AS (
  SELECT *, coalesce('d' || doc_id, 'r' || r) AS doc
  FROM (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, source FROM documents)
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM d
), p AS (
  SELECT r, words, unnest(range(1, len(words) - {REPEAT_WINDOW - 2})) AS i FROM w WHERE len(words) > {REPEAT_WINDOW}
), g AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(words[i:i + {REPEAT_WINDOW - 1}], ' ')) AS n FROM p
), c AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM g, (SELECT unnest(range(0, {REPEAT_WINDOW})) AS k) WHERE n > 1 GROUP BY r
), l AS (
  SELECT r, doc, source, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw
  FROM (SELECT r, doc, source, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY r
), h AS (
  SELECT source, count(DISTINCT doc) AS docs FROM d GROUP BY source
), often AS (
  SELECT l.source, norm FROM l JOIN h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, norm, docs HAVING count(DISTINCT doc) > least({MOST_DOCS}, greatest({LEAST_DOCS}, docs * {SHARE}))
), gone AS (
  SELECT r, sum(nw) AS n FROM l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.norm = o.norm GROUP BY r
), b AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(gone.n, 0) AS BIGINT) AS n_common_words
  FROM w LEFT JOIN c USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)
), f AS (
  SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM b
)
SELECT *, NOT base_failed AND n_words - n_common_words >= {KEEP_SHARE} * n_words AS kept FROM f
"""
