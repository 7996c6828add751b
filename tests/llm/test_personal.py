"""Anchor expansion against the patterns themselves, on made-up texts and on the smallest table."""

import hashlib
import random
import re

import pandas as pd
import pytest

from glosswork.llm import personal
from tests.llm import helpers

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SF = "/root/testdata/sf0.001"


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def holds(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if holds(k, m.group())]


def base(text):
    return [s for s in personal.finder().spans(text.encode()) if s[0] in personal.BASE]


CASES = [
    "a@b@c.d", "a@b.c@d.e.f", "a..b@x..y@z.w", "@a.b", "a@", "x@a.b.", "1.2.3.4.5.6.7.8", "1.2.3.256 1.2.3.4", "999.1.2.3.4", "1.2.3", "0001.02.3.0255", "+12", "+1 2", "+1 (017) 555-7713", "+123456789+1 2345678-",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "x4111111111111111x", "4111  1111111111111111", "1 2 3 4 5 6 7 8 9 0 1 2 3", "+41111111111111111", "é+49 151 2345678 日本 a@b.co", "12.34.56.78@a.b", "a@1.2.3.4", "", "1" * 5000, "1." * 3000, "@" * 500, "a@a" * 400,
]


@pytest.mark.parametrize("text", CASES)
def test_base_cases(text):
    assert base(text) == brute(text)


def test_base_on_made_up_texts():
    made = random.Random(5)
    pieces = ["1", "23", "456", "255", "0", ".", "-", " ", "+", "(", ")", "@", "a", "Bc", "%", "é", "\n", "4111111111111111", "1.2.3.4", "x@y.z", "+4912345678", "token = "]
    for _ in range(4000):
        text = "".join(made.choices(pieces, k=made.randint(1, 40)))
        assert base(text) == brute(text), text


def test_every_document(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    got = personal.op12(spark, SF).toPandas()
    assert len(got) == len(docs) and got[["n_email", "n_ip", "n_card", "n_phone"]].to_numpy().sum() > 20
    for r in got.itertuples():
        want = brute(docs.text[r.doc_id] or "")
        text = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for x, _, _ in want) for k in personal.BASE)
        assert [s for s in r.spans.split(",") if s.split(":")[0] in personal.BASE] == (text.split(",") if text else [])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 is", [("account", 6, 33)]),
        ("iban GB82WEST12345698765432.", [("account", 5, 27)]),
        ("IBAN DE89 3704 0044 0532 0130 01", []),
        ("Token = \"9233A8ECF7C5B09F\" x", [("account", 9, 25)]),
        ("tokens 12345678", []),
        ("token: abcdefghij", []),
        ("password=ab12-cd34.", [("account", 9, 18)]),
        ("ftp://me:pw1@host.example/x", [("email", 9, 25), ("address", 6, 25)]),
        ("https://host.example/a?b=c", []),
    ],
)
def test_added_spans(text, want):
    found = personal.finder().spans(text.encode())
    assert [s for s in found if s[0] not in ("card", "ip", "phone")] == want


def test_awkward_rows(spark):
    got = personal.personal_data(helpers.make(spark)).toPandas()
    assert len(got) == len(helpers.documents()) and got.doc_id.isna().sum() == 1
    assert personal.personal_data(helpers.empty(spark)).count() == 0
    assert set(personal.personal_data(helpers.make(spark)).columns) == {"doc_id", "spans"}


def test_redacted(spark):
    rows = [(1, "é me@x.org, +49 151 2345678", "de", "a", 3, 0.5, "clash", 1), (2, None, None, None, None, None, None, None), (3, "", "en", "a", 0, 0.1, "w", 2)]
    docs = helpers.make(spark, rows)
    got = {r.doc_id: r for r in personal.redacted(docs).collect()}
    assert got[1].text == "é <email>, <phone>" and got[2].text is None and got[3].text == "" and got[1].word == "clash"
    assert personal.redacted(docs).schema == docs.schema
