"""Company and keyword dictionaries, and the hints they give to articles.

A dictionary is a DataFrame. Its names, aliases and keywords become an Aho-Corasick automaton, built once
per Python worker, which goes over each article once: articles are neither joined nor exploded, and the time
hardly depends on the number of entries. A part of a dictionary has at most PART_BYTES of words and entries;
a larger dictionary is searched part by part, and only one part at a time comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.lineage import cut
from glosswork.session import small_batches
from glosswork.sources.files import exists

PART_BYTES = 2_000_000

# Keywords in use when no taxonomy file is there.
DEFAULT_KEYWORDS = ["M&A", "bo nhiem", "hop dong", "khoi cong", "kien tung", "mien nhiem", "mo rong", "phat hanh", "sap nhap", "tang von", "trung thau"]

COMPANY = "ticker string, company_name string, aliases array<string>, sector string, exchange string, status string, source_note string, source_url string, last_verified_at string"
KEYWORD = "event_type string, event_subtype string, keyword string, polarity_hint string, priority int, notes string"


def _csv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("\ufeff") for c in df.columns])


def _column(df: DataFrame, name: str) -> Column:
    return T.normalize_text(F.col(name)) if name in df.columns else F.lit("")


def load_company_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Companies with upper-case ticker and split aliases; rows without ticker or name are left out; a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], COMPANY)
    df = _csv(spark, path)
    names = F.coalesce(F.col("aliases"), F.lit("")) if "aliases" in df.columns else F.lit("")
    optional = ["sector", "exchange", "status", "source_note", "source_url", "last_verified_at"]
    return df.select(
        F.upper(_column(df, "ticker")).alias("ticker"),
        _column(df, "company_name").alias("company_name"),
        F.filter(F.transform(F.split(names, r"\|"), T.strip), lambda a: a != "").alias("aliases"),
        *[F.nullif(_column(df, c), F.lit("")).alias(c) for c in optional],
    ).where("ticker <> '' AND company_name <> ''")


def load_event_keywords(spark: SparkSession, path: str) -> DataFrame:
    """Keywords with type and subtype in upper case; the default keywords if the file is missing."""
    if not exists(spark, path):
        rows = [("UNKNOWN", "UNKNOWN", k, "neutral", 1, "fallback keyword") for k in DEFAULT_KEYWORDS]
        return spark.createDataFrame(rows, KEYWORD)
    df = _csv(spark, path)
    return df.select(
        F.upper(_column(df, "event_type")).alias("event_type"),
        F.upper(_column(df, "event_subtype")).alias("event_subtype"),
        _column(df, "keyword").alias("keyword"),
        F.coalesce(F.nullif(_column(df, "polarity_hint"), F.lit("")), F.lit("neutral")).alias("polarity_hint"),
        F.coalesce(_column(df, "priority").try_cast("int"), F.lit(1)).alias("priority"),
        _column(df, "notes").alias("notes"),
    ).where("keyword <> '' AND event_type <> ''")


def load_event_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """One row per event type: subtypes and allowed argument fields (common ones included)."""
    kind = "struct<subtypes:array<string>,argument_fields:array<string>>"
    schema = f"schema_version string, document_labels array<string>, impact_sentiments array<string>, common_argument_fields array<string>, event_types map<string,{kind}>"
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    return df.select("document_labels", "impact_sentiments", "common_argument_fields", F.explode("event_types").alias("event_type", "rule")).select(
        "event_type",
        F.array_sort(F.coalesce("rule.subtypes", F.array().cast("array<string>"))).alias("subtypes"),
        F.array_sort(F.array_union(F.coalesce("common_argument_fields", F.array().cast("array<string>")), F.coalesce("rule.argument_fields", F.array().cast("array<string>")))).alias("argument_fields"),
        "document_labels",
        "impact_sentiments",
    )


def _streams(entries: DataFrame) -> Iterator[bytes]:
    """The entries as Arrow streams of at most about PART_BYTES."""
    size = F.octet_length(F.to_json(F.struct("*"))).cast("long")
    entries = cut(entries.select("*", size.alias("_size"), F.xxhash64(*entries.columns).alias("_place")))
    parts = max(1, -(-(entries.agg(F.sum("_size")).first()[0] or 0) // PART_BYTES))
    for p in range(parts):
        table = entries.where(F.pmod("_place", F.lit(parts)) == p).drop("_size", "_place").toArrow().combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        yield sink.getvalue().to_pybytes()


def _automaton(words: Iterable[tuple[str, int]]) -> ahocorasick.Automaton | None:
    """Finds words; a hit gives the numbers of the entries that have the word. None without words."""
    by_word: dict[str, list[int]] = {}
    for word, number in words:
        if word:
            by_word.setdefault(word, []).append(number)
    out = ahocorasick.Automaton()
    for word, numbers in by_word.items():
        out.add_word(word, (len(word), tuple(dict.fromkeys(numbers))))
    out.make_automaton()
    return out if by_word else None


class _Finder:
    """Which entries of one part are in texts."""

    def __init__(self, stream: bytes) -> None:
        table = pa.ipc.open_stream(stream).read_all().combine_chunks()
        self.entry = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in table.column_names if c[0] != "_"], [c for c in table.column_names if c[0] != "_"])
        words = table.column("_words").to_pylist()
        self.words = _automaton((w, i) for i, own in enumerate(words) for w in own or ())
        self.codes = _automaton((w, i) for i, w in enumerate(table.column("_code").to_pylist()))

    def find(self, plain: list[str], folded: list[str]) -> pa.Array:
        flat, ends = [], [0]
        for text, low in zip(plain, folded, strict=True):
            hits = {numbers for _, (_, numbers) in self.words.iter(low)} if self.words and low else set()
            found = {n for numbers in hits for n in numbers}
            for end, (size, numbers) in self.codes.iter(text) if self.codes and text else ():
                if not (_code_sign(text, end - size) or _code_sign(text, end + 1)):
                    found.update(numbers)
            flat += sorted(found)
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), self.entry.take(pa.array(flat, pa.int64())))


def _code_sign(text: str, at: int) -> bool:
    return 0 <= at < len(text) and (text[at] in "0123456789" or "A" <= text[at] <= "Z")


@lru_cache(maxsize=8)
def _finder(stream: bytes) -> _Finder:
    """One finder per part and Python worker."""
    return _Finder(stream)


def _hits(entries: DataFrame, plain: Column, folded: Column) -> Column:
    """The entries that are in a text: ``_code`` as a word of its own in the text, or one of ``_words`` in the folded text."""
    kind = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in entries.schema.fields if f.name[0] != "_")

    def part(stream: bytes) -> Column:
        @F.arrow_udf(f"array<struct<{kind}>>")
        def run(text: pa.Array, low: pa.Array) -> pa.Array:
            return _finder(stream).find(text.to_pylist(), low.to_pylist())

        return run(plain, folded)

    return reduce(F.concat, [part(s) for s in _streams(entries)])


def _folded(c: Column) -> Column:
    return F.lower(T.ascii_fold(c))


def _company_entries(companies: DataFrame) -> DataFrame:
    """Per company: ticker, name, the sectors of all entries with its ticker, and the words to look for."""
    named = companies.select("ticker", "company_name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), "sector")
    sectors = named.where("sector <> ''").groupBy("ticker").agg(F.array_sort(F.collect_set("sector")).alias("sectors"))
    words = F.array_distinct(F.transform(F.array_compact(F.concat(F.array("company_name"), "aliases")), _folded))
    return named.join(sectors, "ticker", "left").select("ticker", F.col("company_name").alias("name"), "sectors", words.alias("_words"), F.col("ticker").alias("_code"))


def _keyword_entries(keywords: DataFrame) -> DataFrame:
    """One entry per type, subtype and keyword, with the values of the last row; rows count in their order."""
    rows = keywords.withColumn("_at", F.monotonically_increasing_id())
    values = F.struct("polarity_hint", "priority")
    last = rows.groupBy("event_type", "event_subtype", "keyword").agg(F.max_by(values, "_at").alias("v"), F.min("_at").alias("first"))
    return last.select(
        (-F.col("v.priority")).alias("order"), "event_type", "keyword", "first", "event_subtype", F.col("v.polarity_hint").alias("polarity_hint"),
        F.array(_folded(F.col("keyword"))).alias("_words"), F.lit("").alias("_code"),
    )


def _sorted(hits: str, field: str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(hits, lambda e: e[field]), lambda v: v.isNotNull() & (v != ""))))


def _hinted(articles: DataFrame, text: str, companies: DataFrame | None, keywords: DataFrame | None) -> DataFrame:
    """articles with the hints of the given dictionaries, from one pass over the texts, in small batches."""
    articles = small_batches(articles)
    plain = T.normalize_text(F.col(text))
    rows = articles.withColumns({"_plain": plain}).withColumn("_low", _folded(F.col("_plain")))
    hits, out = {}, []
    if companies is not None:
        hits["_companies"] = _hits(_company_entries(companies), F.col("_plain"), F.col("_low"))
        sectors = F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform("_companies", lambda e: e["sectors"]), lambda x: x.isNotNull()))))
        out += [_sorted("_companies", "ticker").alias("tickers_hint"), _sorted("_companies", "name").alias("company_names_hint"), sectors.alias("sector_hints")]
    if keywords is not None:
        hits["_keywords"] = F.array_sort(_hits(_keyword_entries(keywords), F.lit(""), F.col("_low")))
        names = ["event_type", "event_subtype", "keyword", "polarity_hint"]
        matches = F.transform("_keywords", lambda e: F.struct(*[e[n].alias(n) for n in names], (-e["order"]).alias("priority")))
        out.append(matches.alias("event_keyword_matches"))
        out += [_sorted("_keywords", f).alias(n) for f, n in (("keyword", "event_keywords"), ("event_type", "event_type_hints"), ("event_subtype", "event_subtype_hints"))]
    return rows.withColumns(hits).select(*articles.columns, *out)


def company_hints(articles: DataFrame, companies: DataFrame, text: str = "text") -> DataFrame:
    """articles with sorted tickers_hint, company_names_hint and sector_hints.

    A company is found by its ticker as a word of its own, or by its name or an alias, folded. Sectors are those of all
    entries that have a found ticker.
    """
    return _hinted(articles, text, companies, None)


def keyword_hints(articles: DataFrame, keywords: DataFrame, text: str = "text") -> DataFrame:
    """articles with event_keyword_matches (by falling priority, type, keyword, then order of the dictionary) and sorted
    keyword, type and subtype hints. Of rows with one type, subtype and keyword the last counts."""
    return _hinted(articles, text, None, keywords)


def sector_hints(articles: DataFrame, companies: DataFrame, key: str) -> DataFrame:
    """key and the sorted sectors of the companies in tickers_hint, by an equi-join."""
    each = T.exploded(articles, F.col("tickers_hint"), "ticker", key)
    return each.join(companies.select("ticker", "sector"), "ticker").where("sector <> ''").groupBy(key).agg(F.array_sort(F.collect_set("sector")).alias("sector_hints"))


def attach_hints(articles: DataFrame, companies: DataFrame, keywords: DataFrame) -> DataFrame:
    """All hints from title and text together."""
    whole = articles.withColumn("_all", F.concat_ws("\n", *([F.col("title")] if "title" in articles.columns else []), F.col("text")))
    return _hinted(whole, "_all", companies, keywords).drop("_all")


def audit(companies: DataFrame, keywords: DataFrame) -> DataFrame:
    """(kind, name, n): duplicate tickers and keywords, and counts by sector and event type."""
    key = F.concat_ws("/", "event_type", F.coalesce("event_subtype", F.lit("")), "keyword")

    def counted(df: DataFrame, kind: str, name: Column, least: int = 1) -> DataFrame:
        return df.groupBy(name.alias("name")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.lit(kind).alias("kind"), "name", "n")

    return (
        counted(companies, "duplicate_ticker", F.col("ticker"), 2)
        .union(counted(keywords, "duplicate_keyword", key, 2))
        .union(counted(companies, "sector", F.coalesce("sector", F.lit("UNKNOWN"))))
        .union(counted(keywords, "event_type", F.col("event_type")))
    )
