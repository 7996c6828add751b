"""Personal data by anchor expansion.

An Aho-Corasick automaton goes over the shape of a text (every digit written as 0, every upper-case
letter as lower case) and finds anchors: at-signs, ``+0`` of phone numbers, ``0.0`` of addresses, five
digits with at most one blank or hyphen between each two, URL schemes, and words that announce an
identifier. A deterministic parser per anchor expands to the left and right as far as the kind's
grammar allows and validates what it has got: labels of an email's domain, parts of an address, the
Luhn sum of a card, the digits of a phone number, the check digits of an IBAN, the user part of a URL.

Kinds, in the order of their spans:

* ``email``, ``ip``, ``card``, ``phone``: the base, exactly the leftmost non-overlapping matches of the
  patterns in the tests, of which those that fail a check are dropped without a retry;
* ``address``: the user and host of a URL that carries a user (``scheme://user:word@host``);
* ``account``: what stands behind an identifier cue (``CUES``): after ``iban`` a number with right check
  digits, after the others ``=`` or ``:`` and at least 8 letters, digits and ``-_./+``, 4 of them digits.

All signs of the grammars are ASCII, so the parsers work on UTF-8 bytes; only the ends of spans are
turned into code points. Each anchor costs time in proportion to what it expands to, and anchors
inside a match, or a run, that was already taken are passed by, so a text costs linear time.

Rows: a null text counts as empty. Empty texts have no spans, long texts are taken whole, repeated
rows and null doc_ids stay, extra columns are ignored, an empty table gives an empty result. Spans of
one kind do not overlap; those of different kinds may.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.shared import small_batches

KINDS = ("email", "ip", "card", "phone", "address", "account")
BASE = KINDS[:4]
#: Words that announce an identifier, in lower case.
CUES = ("account", "acct", "api_key", "apikey", "customer_id", "iban", "konto", "cuenta", "compte", "passport", "passwd", "password", "secret", "ssn", "tax_id", "token", "user_id")
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ssh://", "smb://", "imap://", "postgres://", "mysql://", "mongodb://", "redis://", "amqp://")
#: ISO 13616: letters and digits of an IBAN, 15 to 34 signs.
IBAN = re.compile(rb"[ :=#]{0,4}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])")
LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = b"0123456789"
PARTS = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(rb"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
VALUE = re.compile(rb"[ ]{0,3}[=:][ ]{0,3}[\"']?([A-Za-z0-9_./+-]{8,})")
USER = re.compile(rb"[^\s/?#@:<>\"']+(?::[^\s/?#@<>\"']*)?@[A-Za-z0-9.-]+")
NOT_DIGITS = bytes(set(range(256)) - set(DIGITS))
SHAPE = bytes(48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Bytes that go on with a code point.
INSIDE = bytes(range(0x80, 0xC0))
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

Span = tuple[str, int, int]


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_holds(text: bytes) -> bool:
    """The check digits of an IBAN: the number with its first four signs last, letters as 10 to 35, is 1 modulo 97."""
    signs = text.replace(b" ", b"").decode()
    return 15 <= len(signs) <= 34 and int("".join(str(int(c, 36)) for c in signs[4:] + signs[:4])) % 97 == 1


def _left(data: bytes, at: int, signs: bytes, floor: int) -> int:
    """Where the run of ``signs`` that ends at ``at`` begins, not before ``floor``."""
    step = 64
    while at > floor:
        low = max(floor, at - step)
        rest = data[low:at].rstrip(signs)
        at = low + len(rest)
        if rest:
            break
        step *= 4
    return at


class Finder:
    """The automaton of anchors and the parsers behind it."""

    def __init__(self) -> None:
        self.anchors = ahocorasick.Automaton()
        for word, kind in (("@", "email"), ("0.0", "ip"), ("+0", "phone")):
            self.anchors.add_word(word, (kind, len(word)))
        for blanks in itertools.product(("", " ", "-"), repeat=4):
            word = "0" + "".join(b + "0" for b in blanks)
            self.anchors.add_word(word, ("card", len(word)))
        for word in SCHEMES:
            self.anchors.add_word(word, ("address", len(word)))
        for word in CUES:
            self.anchors.add_word(word, ("account", len(word)))
        self.anchors.make_automaton()
        self.parsers = {k: getattr(self, f"_{k}") for k in KINDS}

    def spans(self, data: bytes) -> list[Span]:
        """(kind, start, end) of a UTF-8 text by kind, then start; in code points, the end exclusive."""
        shape = data.translate(SHAPE).decode("latin-1")
        taken, found = dict.fromkeys(KINDS, 0), {k: [] for k in KINDS}
        for last, (kind, size) in self.anchors.iter(shape):
            start = last + 1 - size
            if start >= taken[kind]:
                stop, span = self.parsers[kind](data, start, last + 1, taken[kind])
                taken[kind] = max(stop, taken[kind])
                if span:
                    found[kind].append(span)
        spans = [(k, s, e) for k in KINDS for s, e in found[k]]
        if data.isascii():
            return spans
        points, before, at = {}, 0, 0
        for x in sorted({x for span in spans for x in span[1:]}):
            before += len(data[at:x].translate(None, INSIDE))
            points[x], at = before, x
        return [(k, points[s], points[e]) for k, s, e in spans]

    # Each parser gets the anchor's range and the end of what its kind has taken; it returns up to where it has read (from
    # where the kind goes on) and the span, if it is valid.

    @staticmethod
    def _email(data: bytes, start: int, end: int, floor: int):
        begin = _left(data, start, LOCAL, floor)
        domain = DOMAIN.match(data, end) if begin < start else None
        return (domain.end(), (begin, domain.end())) if domain else (floor, None)

    @staticmethod
    def _ip(data: bytes, start: int, end: int, floor: int):
        begin = _left(data, start + 1, DIGITS, floor)
        run = PARTS.match(data, begin)
        parts = run.group().split(b".")
        if len(parts) < 4:
            return run.end(), None
        stop = begin + len(b".".join(parts[:4]))
        holds = all(len(n := p.lstrip(b"0")) <= 3 and int(n or b"0") <= 255 for p in parts[:4])
        return stop, (begin, stop) if holds else None

    @staticmethod
    def _card(data: bytes, start: int, end: int, floor: int):
        run = CARD.match(data, start)
        digits = run.group().translate(None, NOT_DIGITS)
        return run.end(), run.span() if 13 <= len(digits) <= 19 and luhn(digits) else None

    @staticmethod
    def _phone(data: bytes, start: int, end: int, floor: int):
        run = PHONE.match(data, start)
        if not run:
            return floor, None
        return run.end(), run.span() if 9 <= len(run.group().translate(None, NOT_DIGITS)) <= 15 else None

    @staticmethod
    def _address(data: bytes, start: int, end: int, floor: int):
        user = USER.match(data, end)
        return (user.end(), user.span()) if user else (end, None)

    @staticmethod
    def _account(data: bytes, start: int, end: int, floor: int):
        if data[start:end].lower() == b"iban":
            number = IBAN.match(data, end)
            stop = number.end(1) if number else end
            while number and stop > number.start(1) and not iban_holds(data[number.start(1) : stop]):
                stop = data.rfind(b" ", number.start(1), stop)  # words that follow the number
            return (stop, (number.start(1), stop)) if number and stop > number.start(1) else (end, None)
        value = VALUE.match(data, end)
        if not value:
            return end, None
        text = value.group(1).rstrip(b"./-")
        stop = value.start(1) + len(text)
        holds = len(text) >= 8 and len(text.translate(None, NOT_DIGITS)) >= 4
        return max(stop, end), (value.start(1), stop) if holds else None


@lru_cache(maxsize=1)
def finder() -> Finder:
    """One automaton per Python worker."""
    return Finder()


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, stop in code points, stop exclusive; by kind, then start) of every row."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = finder().spans
        for batch in batches:
            found = [[{"kind": k, "start": s, "stop": e} for k, s, e in spans(x.as_py() or b"")] for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPANS)], ["doc_id", "spans"])

    kind = dict(docs.dtypes)["doc_id"]
    return small_batches(docs).select("doc_id", "text").mapInArrow(find, f"doc_id {kind}, spans array<struct<kind string, start long, stop long>>")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each span of a text replaced by its kind in angle brackets; of spans that overlap, the one that begins first
    (ties: ends last) gives the name and all are covered. Null texts stay null."""
    at = docs.columns.index("text")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = finder().spans
        for batch in batches:
            texts = batch.column(at).to_pylist()
            done = pa.array([x if x is None else _covered(x, spans(x.encode())) for x in texts], pa.string())
            yield batch.set_column(at, batch.schema.field(at).name, done)

    return small_batches(docs).mapInArrow(replace, docs.schema)


def _covered(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, start, stop in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, stop)
    return "".join([*out, text[at:]])


def op12(spark, sf_dir: str) -> DataFrame:
    """The op12 contract over the whole documents table."""
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def text(spans) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))))

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(text(of(*BASE)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
