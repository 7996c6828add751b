"""Text functions as column expressions.

Texts are normalised on two lanes: a native test finds those that hold entities, or signs that NFC may
change; only these go through an Arrow function, for the others it is given nulls. Everything else is
built-in expressions. ``settle`` is the native lane alone, for use inside lambdas and on texts that are
resolved already.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache, reduce
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The retrieval tokenizer's pattern and stop words, the tracking parameters of URLs,
# and the financial abbreviations and unit rewrites, as the reference behaviour has them.
TOKEN_PATTERN = r"[a-zA-Z0-9_]+(?:\.[a-zA-Z0-9_]+)?"
STOPWORDS = [
    "a", "an", "anh", "ba", "ban", "bang", "bi", "bo", "cac", "cai", "cho", "co", "cua", "da", "dang", "de", "den",
    "duoc", "duong", "gan", "giua", "hai", "hay", "hon", "khi", "la", "lai", "len", "mot", "nay", "nen", "nhieu",
    "nhung", "o", "qua", "sau", "se", "tai", "theo", "thi", "trong", "tu", "va", "vao", "ve", "voi",
]
TRACKING_PARAMETERS = r"utm_.*|fbclid|gclid"
ABBREVIATIONS = {
    "đhđcđ": "đại hội đồng cổ đông",
    "đhcđ": "đại hội đồng cổ đông",
    "dhcd": "đại hội đồng cổ đông",
    "dhđcd": "đại hội đồng cổ đông",
    "hđqt": "hội đồng quản trị",
    "hdqt": "hội đồng quản trị",
    "bctc": "báo cáo tài chính",
    "ctcp": "công ty cổ phần",
    "cp": "cổ phiếu",
    "tnhh": "trách nhiệm hữu hạn",
    "ubcknn": "ủy ban chứng khoán nhà nước",
    "ttck": "thị trường chứng khoán",
}
MONEY_WORDS = "%|tỷ|ty|triệu|trieu|nghìn|nghin|đồng|dong|vnd|vnđ"
UNIT_REWRITES = [
    (r"(?<=\d)\s*(?:vnđ|vnd|đ)\b", " đồng"),
    (r"\btr\.?\s*đ\b", "triệu đồng"),
    (r"\btỷ\s*đ\b", "tỷ đồng"),
    (r"\bty\s*đ\b", "tỷ đồng"),
    (r"\btr\.?\s*vnd\b", "triệu đồng"),
    (r"\btỷ\s*vnd\b", "tỷ đồng"),
]

_BLANK = r"[\s\x1C-\x1F]"


def resolved(text: str, times: int = 1) -> str:
    """HTML entities resolved, then NFC, so many times; what built-in functions cannot do."""
    for _ in range(times):
        text = unicodedata.normalize("NFC", unescape(text))
    return text


def _classes(signs: Iterable[str]) -> str:
    """Signs as the inside of a character class, with ranges."""
    out: list[list[int]] = []
    for code in sorted(map(ord, signs)):
        if out and out[-1][1] == code - 1:
            out[-1][1] = code
        else:
            out.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" if a < b else f"\\x{{{a:x}}}" for a, b in out)


#: Put before a long class: it fails at once on signs of common scripts that no class here holds.
COMMON = r"(?![\x00-\xBB\xBF-\x{131}\x{1EA0}-\x{1EF9}\x{4E00}-\x{9FFF}\x{400}-\x{482}\x{391}-\x{3CE}])"


@lru_cache(maxsize=1)
def unsettled() -> str:
    """A pattern that matches in every text that ``resolved`` changes, and in few others: an entity's beginning; marks, signs
    that NFC replaces, and signs that can join the one before them."""
    signs = {chr(c) for r in (range(0x1161, 0x1176), range(0x11A8, 0x11C3)) for c in r}  # Hangul vowels and finals
    for code in range(0x80, 0x110000):
        c = chr(code)
        parts = unicodedata.decomposition(c)
        if unicodedata.combining(c) or (parts and unicodedata.normalize("NFC", c) != c):
            signs.add(c)
        if parts and not parts.startswith("<") and " " in parts:
            signs.add(chr(int(parts.split()[1], 16)))
    return f"&[#A-Za-z]|{COMMON}[{_classes(signs)}]"


@lru_cache(maxsize=4)
def _resolver(times: int):
    @F.arrow_udf(StringType())
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else resolved(t, times) for t in text.to_pylist()], pa.string())

    return run


def resolve(text: Column, times: int = 1) -> Column:
    """``resolved`` of each text; those that it would not change never leave the JVM. Null stays null."""
    touched = F.when(text.rlike(unsettled()), text)
    return F.coalesce(_resolver(times)(touched), text)


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, even where body uses it inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exploded(rows: DataFrame, values: Column, name: str, *columns: Column | str) -> DataFrame:
    """columns and one row per value that is not null.

    Of a plain explode Spark infers a filter on the array's size, and works the array out twice: once for the filter.
    """
    return rows.select(*columns, F.explode_outer(values).alias(name)).where(F.col(name).isNotNull())


def one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """One row per key, the least by its other columns in order."""
    return rows.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("_least")).select(key, "_least.*")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{_BLANK}+|{_BLANK}+$", "")


#: White space other than blanks and line feeds, behind a class of what is common and none of it.
_RARE_SPACE = r"(?![\n\x20-\x84\x86-\x9F\xA1-\x{167F}])[\t\x0B\f\r\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def settle(text: Column) -> Column:
    """White space as in clean articles; null as empty. Entities and decomposed letters stay. Texts that are so already
    are only tested."""

    def settled(x: Column) -> Column:
        runs = [F.contains(x, F.lit(r)) for r in ("  ", " \n", "\n ", "\n\n\n")]
        ends = [F.substring(x, at, 1).isin(" ", "\n") for at in (1, -1)]
        return F.when(reduce(Column.__or__, [*runs, *ends, x.rlike(_RARE_SPACE)]), _settled(x)).otherwise(x)

    return let(F.coalesce(text, F.lit("")), settled)


def _settled(text: Column) -> Column:
    x = F.regexp_replace(F.translate(text, "\u00a0", " "), r"[ \t\r\f\x0B]+", " ")
    x = F.regexp_replace(x, rf"(?U)\n{_BLANK}*\n+", "\n\n")
    x = F.regexp_replace(x, r"[\x1C-\x1E\x85\u2028\u2029]", "\n")
    x = F.regexp_replace(x, r"(?U)[\s\x1F&&[^\n]]*\n[\s\x1F&&[^\n]]*", "\n")
    return strip(x)


def normalize_text(text: Column, times: int = 1) -> Column:
    """Entities resolved (``times`` times, for functions that normalise repeatedly), NFC, white space settled; null as empty."""
    return settle(resolve(text, times))


def text_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.lower(normalize_text(text)), 256))


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Letters whose compatibility decomposition without marks is one other character, followed by marks to drop; those
    characters; and what all others become: letters that decompose into several, or lie beyond 16 bits (Hangul is computed)."""
    source, target, marks, several = ["đ", "Đ"], ["d", "D"], [], {}
    for code in range(0x80, 0x110000):
        c = chr(code)
        if c in "đĐ" or 0xAC00 <= code <= 0xD7A3:
            continue
        if unicodedata.combining(c) and code < 0x10000:
            marks.append(c)
        elif unicodedata.combining(c) or unicodedata.decomposition(c):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(plain) == 1 and plain != c and code < 0x10000:  # ``translate`` works on 16-bit units
                source.append(c)
                target.append(plain)
            elif plain != c:
                several[c] = plain
    return "".join(source) + "".join(marks), "".join(target), several


def _hangul(syllable: Column) -> Column:
    """The letters of a syllable."""
    place = F.ascii(syllable) - 0xAC00
    final = place % 28
    codes = F.concat(
        F.array(0x1100 + (place / 588).cast("int"), 0x1161 + ((place % 588) / 28).cast("int")), F.filter(F.array(0x11A7 + final), lambda x: x > 0x11A7)
    )
    return F.array_join(F.transform(codes, lambda c: F.decode(F.unhex(F.hex(c)), "UTF-16BE")), "")


def ascii_fold(text: Column) -> Column:
    """The compatibility decomposition without marks, and d for the crossed letter.

    Letters that become several (ligatures, fractions, Hangul) are looked up once per text that has them and replaced one
    after the other, as none becomes another of them; all others take one translation.
    """
    source, target, several = _folding()
    letters = f"{_classes(several)}\\x{{ac00}}-\\x{{d7a3}}"
    table = "\x01".join(["", *[f"{k}\x02{v}" for k, v in several.items()], ""])

    def one(p: Column) -> Column:
        behind = F.call_function("substring_index", F.lit(table), F.concat(F.lit("\x01"), p, F.lit("\x02")), F.lit(-1))
        return F.when(p.between("\uac00", "\ud7a3"), _hangul(p)).otherwise(F.substring_index(behind, "\x01", 1))

    def folded(t: Column) -> Column:
        plain = F.translate(t, source, target)
        found = F.array_distinct(F.regexp_extract_all(plain, F.lit(f"{COMMON}[{letters}]"), F.lit(0)))
        several = F.aggregate(found, plain, lambda x, p: F.replace(x, p, one(p)))
        return F.when(t.rlike(f"{COMMON}[{letters}]"), several).otherwise(plain)

    return let(text, folded)


def fold_for_match(text: Column) -> Column:
    """Normalised, lower case, folded, one space for any white space."""
    return strip(F.regexp_replace(ascii_fold(F.lower(normalize_text(text))), rf"(?U){_BLANK}+", " "))


def normalize_value(value: Column) -> Column:
    """The form in which metrics compare values; null as empty."""
    x = ascii_fold(F.lower(strip(F.coalesce(value.cast("string"), F.lit("")))))
    return strip(F.regexp_replace(x, rf"(?U){_BLANK}+", " "))


def expand_abbreviations(text: Column) -> Column:
    for short in sorted(ABBREVIATIONS, key=len, reverse=True):
        text = F.regexp_replace(text, rf"(?iuU)(?<!\w){short}(?!\w)", ABBREVIATIONS[short])
    return text


def normalize_numbers(text: Column) -> Column:
    """``1.200,5`` as ``1200.5``; a decimal comma before a money word as a point."""
    group = r"(?<!\w)\d{1,3}(?:\.\d{3})"
    x = F.regexp_replace(text, rf"(?U)(?<={group}{{1,8}}),(?=\d)", "\u0001")
    x = F.regexp_replace(x, rf"(?U)(?<={group}{{0,8}})\.(?=\d{{3}})", "")
    x = F.translate(x, "\u0001", ".")
    return F.regexp_replace(x, rf"(?iuU)(?<!\w)(\d+),(\d+)(?=\s*(?:{MONEY_WORDS}))", "$1.$2")


def normalize_units(text: Column) -> Column:
    for pattern, unit in UNIT_REWRITES:
        text = F.regexp_replace(text, f"(?iuU){pattern}", unit)
    return text


def preprocess(text: Column, normalizer=None, times: int = 2) -> Column:
    """Normalised text with abbreviations, numbers and units written out.

    ``normalizer`` is an optional column function (for example a pandas UDF) for the first step. Normalisation ends the
    rewrites as well; the entities that it would find then are resolved at the start (``times``).
    """
    x = normalize_text(text, times)
    if normalizer is not None:
        x = F.coalesce(normalizer(x), x)
    return settle(normalize_units(normalize_numbers(expand_abbreviations(x))))


def preprocess_warnings(normalizer=None) -> Column:
    missing = F.lit("external_normalizer_unavailable") if normalizer is None else F.lit(None).cast("string")
    return F.array_compact(F.array(missing))


def tokens(text: Column, remove_stopwords: bool = True, domain: bool = True) -> Column:
    """Retrieval tokens. ``domain=False`` leaves out the rewrites of abbreviations, numbers and units."""
    x = preprocess(text, times=3) if domain else normalize_text(text)
    found = F.regexp_extract_all(F.lower(ascii_fold(x)), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))
    if not remove_stopwords:
        return found
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return F.filter(found, lambda t: (F.char_length(t) > 1) & ~F.array_contains(stop, t))


def mmr_tokens(text: Column) -> Column:
    """The unfolded token set that selection compares."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9_]+)"), F.lit(1)), F.lower))


def metric_tokens(text: Column) -> Column:
    return F.regexp_extract_all(normalize_value(text), F.lit("([a-z0-9]+)"), F.lit(1))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\w+"))


def split_blank(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, rf"(?U){_BLANK}+"), lambda w: w != "")


def truncate_words(text: Column, most: int) -> Column:
    words = split_blank(text)
    return F.when(F.size(words) <= most, text).otherwise(F.array_join(F.slice(words, 1, most), " "))


def split_sentences(text: Column, at_lines: bool = False) -> Column:
    """Sentences, stripped, without empty ones; ``at_lines`` also ends them at line breaks."""
    pattern = r"(?U)(?<=[.!?;:])\s+"
    if at_lines:
        pattern = r"(?U)[\n\r]+|(?<=[.!?;:])\s+"
    return F.filter(F.transform(F.split(text, pattern), strip), lambda s: s != "")


def split_paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(normalize_text(text), "\n+"), strip), lambda p: p != "")


def marked_letter_ratio(text: Column) -> Column:
    """Non-ASCII letters among letters; 0 without letters."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    marked = F.regexp_count(text, F.lit(r"[\p{L}&&[^\x00-\x7F]]"))
    return F.when(letters > 0, marked / letters).otherwise(0.0)


def canonical_url(url: Column) -> Column:
    """Lower scheme and host, no trailing slash, tracking parameters or fragment, sorted query."""
    x = strip(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(x, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(F.regexp_replace(x, r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""), r"#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^//([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(rest, r"^(?://[^/?]*)?([^?]*)", 1), "/+$", "")
    items = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda i: i != "")

    def decoded(part: Column) -> Column:
        # a percent sign without two hexadecimal digits stays as it is
        return F.url_decode(F.regexp_replace(part, "%(?![0-9A-Fa-f]{2})", "%25"))

    def encoded(part: Column) -> Column:
        return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))

    pairs = F.transform(
        items,
        lambda i: F.struct(
            decoded(F.regexp_extract(i, "^([^=]*)", 1)).alias("k"), decoded(F.regexp_extract(i, "^[^=]*=?(.*)$", 1)).alias("v")
        ),
    )
    kept = F.array_sort(F.filter(pairs, lambda p: ~p["k"].rlike(f"^(?:{TRACKING_PARAMETERS})$")))
    query = F.array_join(F.transform(kept, lambda p: F.concat(encoded(p["k"]), F.lit("="), encoded(p["v"]))), "&")
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(rest.startswith("//"), F.concat(F.lit("//"), host)).otherwise(""),
        path,
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def source_slug(source: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(source), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(slug, F.lit("")) == "", "unknown").otherwise(slug)


def article_id(source: Column, url: Column, text: Column) -> Column:
    digest = F.sha1(F.concat(canonical_url(url), F.lit("\n"), text_hash(text)))
    return F.concat(source_slug(source), F.lit("_"), F.substring(digest, 1, 12))


def numbered_id(prefix: Column, kind: str, index: Column) -> Column:
    return F.format_string(f"%s_{kind}_%04d", prefix, index)


def digest_id(prefix: str, text: Column, size: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(text), 1, size))


def retrieval_text(title: Column, text: Column, *hints: Column, lined: bool = False) -> Column:
    """Title, text and the space-joined hint arrays, one per line, without empty parts.

    With ``lined`` title and text keep their lines where they are empty, and a null in any part makes the result null.
    """
    if lined:
        holed = F.lit(False)
        for h in hints:
            holed = holed | h.isNull() | F.exists(h, F.isnull)
        lines = F.filter(F.array(*[F.when(F.size(h) > 0, F.array_join(h, " ")) for h in hints]), F.isnotnull)
        return F.when(~holed & title.isNotNull() & text.isNotNull(), F.array_join(F.concat(F.array(title, text), lines), "\n"))
    parts = [F.coalesce(title, F.lit("")), F.coalesce(text, F.lit(""))]
    parts += [F.array_join(F.coalesce(h, F.array().cast("array<string>")), " ") for h in hints]
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), "\n")


def truncate_chars(text: Column, most: int, rule: str = "append") -> Column:
    """Three cut rules: ``append`` keeps most characters and adds dots, ``within`` counts the dots, ``raw`` too without trimming."""
    text = F.coalesce(text, F.lit(""))
    if rule == "append":
        cut = F.concat(F.regexp_replace(F.substring(text, 1, most), r"\s+$", ""), F.lit("..."))
    elif rule == "within":
        cut = F.concat(F.regexp_replace(F.substring(text, 1, most - 3), r"\s+$", ""), F.lit("..."))
    else:
        cut = F.concat(F.substring(text, 1, most - 3), F.lit("..."))
    return F.when(F.char_length(text) > most, cut).otherwise(text)


def date_bucket(stamp: Column) -> Column:
    """The day of an ISO time stamp; ``unknown`` without one."""
    day = F.substring(strip(F.coalesce(stamp.cast("string"), F.lit(""))), 1, 10)
    return F.when(day == "", "unknown").otherwise(day)


def has_value(value: Column) -> Column:
    return strip(F.coalesce(value.cast("string"), F.lit(""))) != ""


def first_text(*values: Column) -> Column:
    """The first value that is not blank, stripped; empty if none."""
    return F.coalesce(*[F.nullif(strip(v.cast("string")), F.lit("")) for v in values], F.lit(""))


def nullable_upper(value: Column) -> Column:
    """Trimmed upper case; blank as null."""
    return F.nullif(F.upper(strip(value)), F.lit(""))



# Fixed value: tokens that an external normaliser must leave alone (upper-case codes).
PRESERVED = r"(?<!\w)(?:[A-ZĐ]{2,}(?:[_/-][A-ZĐ0-9]+)*|[A-ZĐ]+&[A-ZĐ]+)(?!\w)"


def external_normalizer(function):
    """A column function that runs ``function(text) -> text`` over Arrow, for ``preprocess``.

    The text is split at codes and at white space around them: the function sees the stretches between codes, and codes
    never leave their place. A failing call gives null, and ``preprocess`` then keeps its own text.
    """
    code = re.compile(rf"\s*({PRESERVED})\s*")

    def one(text: str) -> str | None:
        out, end = [], 0
        try:
            for match in [*code.finditer(text), None]:
                stretch = text[end : match.start() if match else len(text)]
                out.append(str(function(stretch)) if stretch.strip() else stretch)
                if match:
                    out.append(match.group(0))
                    end = match.end()
        except Exception:  # the caller falls back to the text as it was
            return None
        return "".join(out)

    @F.arrow_udf(StringType())
    def run(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else one(t) for t in text.to_pylist()], pa.string())

    return run
