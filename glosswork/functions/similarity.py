"""Similarity and arithmetic as column expressions; sequence matching as Arrow UDFs."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from glosswork.functions import text as T


def cosine(left: Column, right: Column) -> Column:
    """0 for empty, unequal in length or zero vectors."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    dot = total(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))
    norm = F.sqrt(total(F.transform(left, lambda a: a.cast("double") * a.cast("double")))) * F.sqrt(
        total(F.transform(right, lambda b: b.cast("double") * b.cast("double")))
    )
    return F.when((F.size(left) == F.size(right)) & (norm > 0), dot / norm).otherwise(0.0)


def safe_divide(a: Column, b: Column) -> Column:
    """Rounded to 6 places; 0 for a zero divisor."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 6)


def mean_or_zero(x: Column, digits: int | None = 6) -> Column:
    """An aggregate that skips NaN and gives 0 on nothing."""
    mean = F.coalesce(F.avg(F.when(~F.isnan(x.cast("double")), x.cast("double"))), F.lit(0.0))
    return mean if digits is None else F.round(mean, digits)


def tolerant_double(x: Column) -> Column:
    """Text as a number, 0 if it is none."""
    return F.coalesce(x.cast("string").try_cast("double"), F.lit(0.0))


def four_digits(x: Column) -> Column:
    return F.format_string("%.4f", tolerant_double(x))


def jaccard(left: Column, right: Column) -> Column:
    """Of two distinct-element arrays; 0 if either is empty."""
    return F.when(
        (F.size(left) > 0) & (F.size(right) > 0),
        F.size(F.array_intersect(left, right)) / F.size(F.array_union(left, right)),
    ).otherwise(0.0)


def word_set(text: Column) -> Column:
    """The distinct words by which metrics compare texts."""
    return F.array_distinct(T.metric_tokens(text))


def word_overlap(left: Column, right: Column) -> Column:
    """Of two word sets."""
    return F.round(jaccard(left, right), 6)


def text_overlap(left: Column, right: Column) -> Column:
    return word_overlap(word_set(left), word_set(right))


def same_value(left: Column, right: Column) -> Column:
    """Of two normalised values: 1 if equal and not empty."""
    return F.when((left != "") & (left == right), 1.0).otherwise(0.0)


def exact_match(left: Column, right: Column) -> Column:
    return same_value(T.normalize_value(left), T.normalize_value(right))


def name_match(left: Column, right: Column, left_words: Column, right_words: Column) -> Column:
    """Of two normalised names and their word sets."""
    return (
        F.when((left == "") | (right == ""), 0.0)
        .when(left == right, 1.0)
        .when(F.contains(left, right) | F.contains(right, left), 0.8)
        .otherwise(word_overlap(left_words, right_words))
    )


def company_match(left: Column, right: Column) -> Column:
    return name_match(T.normalize_value(left), T.normalize_value(right), word_set(left), word_set(right))


def slots(arguments: Column) -> Column:
    """map<string, string> with normalised values and without empty ones."""
    given = F.coalesce(arguments, F.create_map().cast("map<string,string>"))
    return F.map_filter(F.transform_values(given, lambda k, v: T.normalize_value(v)), lambda k, v: v != "")


def slot_match(gold: Column, predicted: Column) -> Column:
    return (gold == predicted) | (text_overlap(gold, predicted) >= 0.75)


def argument_overlap(gold: Column, predicted: Column) -> Column:
    """Keys with matching values among all keys of two slot maps."""
    same = F.size(
        F.filter(F.map_keys(gold), lambda k: F.coalesce(slot_match(F.element_at(gold, k), F.element_at(predicted, k)), F.lit(False)))
    )
    keys = F.size(F.array_union(F.map_keys(gold), F.map_keys(predicted)))
    return F.when((F.size(gold) > 0) & (F.size(predicted) > 0), safe_divide(same, keys)).otherwise(0.0)


@F.arrow_udf(DoubleType())
def sequence_ratio(left: pa.Array, right: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp ratio with the automatic junk rule; 0 if either is empty."""
    return pa.array(
        [SequenceMatcher(None, a, b).ratio() if a and b else 0.0 for a, b in zip(left.to_pylist(), right.to_pylist())], pa.float64()
    )


@F.arrow_udf(DoubleType())
def best_sentence_ratio(query: pa.Array, text: pa.Array) -> pa.Array:
    """The best ratio of the query to a sentence of the text; null where the text is null."""
    out = []
    for q, t in zip(query.to_pylist(), text.to_pylist()):
        if not q or t is None:
            out.append(None)
            continue
        parts = [p.strip() for p in re.split(r"[\n\r]+|(?<=[.!?;:])\s+", t) if p.strip()] or [t]
        out.append(max(SequenceMatcher(None, q, p).ratio() for p in parts))
    return pa.array(out, pa.float64())


def windows(sentence: Column, target: Column) -> Column:
    """The sentence, and its runs of max(2, target - 3) to target + 5 words."""
    words = T.split_blank(sentence)
    n = F.size(words)
    low, high = F.greatest(F.lit(2), target - 3), F.least(n, target + 5)
    sizes = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))
    runs = F.flatten(
        F.transform(
            sizes, lambda size: F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(words, i, size), " "))
        )
    )
    return F.when((n > 2) & (target > 0), F.concat(F.array(sentence), runs)).otherwise(F.array(sentence))


def _fold(s: str) -> str:
    s = unicodedata.normalize("NFKD", s.lower().replace("đ", "d"))
    return " ".join("".join(c for c in s if not unicodedata.combining(c)).split())


def _windows(query: str, sentences: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of folded sentences, in order: sentence, first word and end word (counted over all sentences), and whether
    it is the whole sentence; and where each word begins in all words joined by spaces."""
    n_words, n = len(query.split()), np.array(list(map(len, sentences)), np.int64)
    ends = np.cumsum(n)
    room, of = np.repeat(ends, n) - np.arange(int(n.sum())), np.repeat(np.arange(len(n)), n)
    first, end = [ends - n], [ends]
    for k in range(max(2, n_words - 3), n_words + 6):
        at = np.flatnonzero((room >= k) & (n[of] > 2))
        first.append(at)
        end.append(at + k)
    size = np.repeat(np.arange(len(first)), list(map(len, first)))
    first, end = np.concatenate(first), np.concatenate(end)
    sentence = np.searchsorted(ends, first, "right")
    order = np.lexsort((first, size, sentence))
    width = np.array([len(w) for words in sentences for w in words], np.int64)
    begin = np.append(np.cumsum(width + (width > 0)) - (width + (width > 0)), int((width + (width > 0)).sum()))
    return sentence[order], first[order], end[order], size[order] == 0, begin


def _bounds(query: str, text: str, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A bound of the ratio of query and text[low:high]: twice their longest common subsequence over both lengths. The letters
    that a ratio counts as matched are such a sequence.

    Its length is kept for each prefix of what begins at a place, as the zeros of one number (bit by bit over the query),
    so one pass serves all windows that begin there.
    """
    full, signs = (1 << len(query)) - 1, {}
    for i, letter in enumerate(query):
        signs[letter] = signs.get(letter, 0) | 1 << i
    rows = [signs.get(c, 0) for c in text]
    common, order = np.zeros(len(low), np.int64), np.lexsort((high, low)).tolist()
    starts, stops = low.tolist(), high.tolist()
    at, state, begun = 0, full, -1
    for i in order:
        if starts[i] != begun:
            begun = at = starts[i]
            state = full
        for row in rows[at : stops[i]]:
            hit = state & row
            if hit:
                state = ((state + hit) | (state - hit)) & full
        at = max(at, stops[i])
        common[i] = len(query) - state.bit_count()
    return 2.0 * common / (len(query) + high - low)


def _best_window(query: str, text: str) -> tuple[float, str | None]:
    """The window of the text with the best ratio to the folded query, the earliest of equals.

    Windows are compared in order of their bound until the next bound is below the best ratio.
    """
    sentences = [part for part in (p.strip() for p in re.split(r"[\n\r]+|(?<=[.!?;:])\s+", text)) if part]
    words = [part.split() for part in sentences]
    folded = [[_fold(w) for w in own] for own in words]
    if not sentences:
        return 0.0, None
    sentence, first, end, whole, begin = _windows(query, folded)
    joined = " ".join(w for own in folded for w in own if w) + " "
    low = begin[first]
    high = np.maximum(begin[end] - 1, low)  # without the space after the last word
    bound = _bounds(query, joined, low, high)
    best, at, matcher = 0.0, len(bound), SequenceMatcher(None)
    for i in np.argsort(-bound, kind="stable").tolist():
        if bound[i] < best or bound[i] == 0:
            break
        if i > at and bound[i] == best:
            continue
        matcher.set_seqs(query, joined[low[i] : high[i]])  # the query stays first: the junk rule looks at the second sequence only
        ratio = matcher.ratio()
        if ratio > best or ratio == best and i < at:
            best, at = ratio, i
    if at == len(bound) or best == 0:
        return 0.0, None
    k = sentence[at]
    start = sum(map(len, words[:k]))
    return best, sentences[k] if whole[at] else " ".join(words[k][first[at] - start : end[at] - start])


_MATCH = pa.struct([("support", pa.string()), ("score", pa.float64()), ("matched_text", pa.string()), ("match_type", pa.string())])


def find_text_match(query: Column, text: Column, threshold: float) -> Column:
    """struct(support, score, matched_text, match_type): folded containment, else the best window.

    Containment is decided natively; only texts that do not contain the query reach the UDF.
    """

    @F.arrow_udf("struct<support:string,score:double,matched_text:string,match_type:string>")
    def fuzzy(queries: pa.Array, texts: pa.Array) -> pa.Array:
        rows = []
        for q, t in zip(queries.to_pylist(), texts.to_pylist()):
            if not q or not t:
                rows.append({"support": "UNSUPPORTED", "score": 0.0, "matched_text": None, "match_type": None})
                continue
            score, found = _best_window(q, t)
            support = "UNSUPPORTED" if score < threshold else "SUPPORTED" if score >= 0.92 else "PARTIALLY_SUPPORTED"
            rows.append({"support": support, "score": round(score, 6), "matched_text": found, "match_type": "fuzzy"})
        return pa.array(rows, _MATCH)

    q, t = T.fold_for_match(query), T.fold_for_match(text)
    contained = (q != "") & F.contains(t, q)
    exact = F.struct(
        F.lit("SUPPORTED").alias("support"), F.lit(1.0).alias("score"), query.alias("matched_text"), F.lit("exact").alias("match_type")
    )
    passed = F.when(contained, F.lit(None).cast("string")).otherwise(T.normalize_text(text))
    return F.when(contained, exact).otherwise(fuzzy(q, passed))
