"""Prompts for extraction and for self-verification as columns, shrunk to a budget of characters.

Contexts are rows: article_id, rank, chunk_id, title, text, score, event_type_hints, and optionally patterns (an array of
structs with pattern_id, event_type, event_subtype, evidence_span and output). An article has few contexts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.functions import text as T
from glosswork.operators.validation import DOCUMENT_LABELS, SENTIMENTS, Taxonomy

# Of each further attempt the contexts kept, and most characters of article, context and pattern output.
ATTEMPTS = [(3, 1600, 320, 520), (1, 1200, 240, 420), (0, 1000, 0, 0)]
# The lines of the self-verification prompt, and its limits.
VERIFY_LINES = [
    "You are verifying a Vietnamese financial event extraction result.",
    "Use only the article and retrieved contexts. Do not introduce new facts.",
    "For each event field, return SUPPORTED, PARTIALLY_SUPPORTED, or UNSUPPORTED.",
    "If a field is unsupported, recommend set_null, drop_field, or drop_event.",
    "Return JSON only.",
]
VERIFY_ARTICLE, VERIFY_CONTEXT = 4000, 1200

PATTERN = "pattern_id string, event_type string, event_subtype string, evidence_span string, output string"
NO_PATTERNS = f"array<struct<{PATTERN.replace(' string', ':string')}>>"


def limited(text: Column, most: int) -> Column:
    """The first characters of a text; all of it where ``most`` is 0."""
    return T.truncate_chars(text, most, "append") if most > 0 else F.coalesce(text, F.lit(""))


def taxonomy_view(types: Column, taxonomy: Taxonomy) -> Column:
    """JSON-ready view: all type names, and subtypes and arguments of the wanted types that the taxonomy knows."""
    known = F.array_sort(F.array_distinct(F.filter(F.transform(types, F.upper), taxonomy.known)))
    view = F.transform(
        known,
        lambda t: F.struct(t.alias("event_type"), F.array_sort(taxonomy.allowed_subtypes(t)).alias("subtypes"), F.array_sort(taxonomy.allowed_arguments(t)).alias("argument_fields")),
    )
    every = F.array(*[F.lit(t) for t in sorted(taxonomy.subtypes)]).cast("array<string>")
    return F.struct(
        F.array(*[F.lit(x) for x in sorted(DOCUMENT_LABELS)]).alias("document_labels"), F.array(*[F.lit(x) for x in sorted(SENTIMENTS)]).alias("impact_sentiments"),
        every.alias("event_type_enum"), view.alias("relevant_event_types"),
    )


def pattern_views(patterns: Column, most_output: int) -> Column:
    return F.transform(
        patterns,
        lambda p: F.struct(*[p[c].alias(c) for c in ("pattern_id", "event_type", "event_subtype", "evidence_span")], limited(p["output"], most_output).alias("output")),
    )


def context_views(contexts: Column, most_text: int, most_output: int) -> Column:
    """Contexts in order of rank, with texts and pattern outputs cut."""
    return F.transform(
        contexts,
        lambda c: F.struct(
            *[c[n].alias(n) for n in ("rank", "chunk_id", "title", "score", "event_type_hints")], pattern_views(c["patterns"], most_output).alias("matched_patterns"),
            limited(c["text"], most_text).alias("text"),
        ),
    )


def gathered(contexts: DataFrame) -> DataFrame:
    """(article_id, contexts): each article's contexts as one array in order of rank."""
    rows = contexts if "patterns" in contexts.columns else contexts.withColumn("patterns", F.array().cast(NO_PATTERNS))
    row = F.struct("rank", "chunk_id", "title", "score", "event_type_hints", "patterns", "text")
    return rows.groupBy("article_id").agg(F.array_sort(F.collect_list(row)).alias("contexts"))


def extraction_prompts(
    articles: DataFrame, contexts: DataFrame, taxonomy: Taxonomy, instruction: str, most_article: int = 0, most_context: int = 0, most_output: int = 0, most_prompt: int = 0
) -> DataFrame:
    """(article_id, attempt, prompt): the first attempt whose prompt fits ``most_prompt`` characters, else the last one.

    Attempt 0 has everything within the given limits; the others (see ATTEMPTS) keep fewer contexts and less text.
    Without ``most_prompt`` attempt 0 is taken.
    """
    rows = articles.join(gathered(contexts), "article_id", "left")
    every = F.coalesce("contexts", F.array().cast(rows.schema["contexts"].dataType))
    hints = F.coalesce(F.col("event_type_hints"), F.array().cast("array<string>"))
    types = F.concat(hints, F.flatten(F.transform(every, lambda c: F.coalesce(c["event_type_hints"], F.array().cast("array<string>")))), F.flatten(F.transform(every, lambda c: F.transform(c["patterns"], lambda p: p["event_type"]))))

    def rendered(keep: int | None, article: int, context: int, output: int) -> Column:
        some = every if keep is None else F.slice(every, 1, keep) if keep else F.slice(every, 1, 0)
        body = F.struct(
            F.struct("article_id", F.coalesce(F.col("title"), F.lit("")).alias("title"), limited(F.col("text"), article).alias("text")).alias("article"),
            context_views(some, context, output).alias("contexts"), taxonomy_view(types, taxonomy).alias("taxonomy"),
        )
        return F.concat(F.lit(instruction + "\n"), F.to_json(body))

    least = lambda given, fallback: min(given, fallback) if given > 0 else fallback
    tries = [(None, most_article, most_context, most_output)]
    if most_prompt > 0:
        tries += [(k, least(most_article, a), least(most_context, c) if c else 0, least(most_output, o) if o else 0) for k, a, c, o in ATTEMPTS]
    choices = [F.struct(F.lit(i).alias("attempt"), rendered(*t).alias("prompt")) for i, t in enumerate(tries)]
    fits = [F.when(F.char_length(c["prompt"]) <= most_prompt, c) for c in choices[:-1]]
    return rows.select("article_id", F.coalesce(*fits, choices[-1]).alias("_c")).select("article_id", "_c.*")


def self_verification_prompts(articles: DataFrame, drafts: DataFrame, contexts: DataFrame) -> DataFrame:
    """(article_id, prompt) for a model that checks a draft (article_id, draft: JSON text) against article and contexts."""
    rows = drafts.join(articles.select("article_id", "title", "text"), "article_id").join(gathered(contexts), "article_id", "left")
    block = F.transform(
        "contexts",
        lambda c, i: F.concat(F.lit("[context_"), i + 1, F.lit("]\ntitle: "), F.coalesce(c["title"], F.lit("")), F.lit("\ntext: "), T.truncate_chars(c["text"], VERIFY_CONTEXT)),
    )
    parts = [
        *map(F.lit, VERIFY_LINES), F.lit("[article]"), F.concat(F.lit("title: "), F.coalesce("title", F.lit(""))), F.concat(F.lit("text: "), T.truncate_chars(F.col("text"), VERIFY_ARTICLE)),
        F.lit("[retrieved_contexts]"), F.coalesce(F.array_join(block, "\n\n"), F.lit("[]")), F.lit("[draft_output_json]"), F.col("draft"),
    ]
    return rows.select("article_id", F.array_join(F.array(*parts), "\n\n").alias("prompt"))
