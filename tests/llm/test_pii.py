import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatlens.llm import pii
from tests.conftest import SF_MID

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def brute(t):
    t = t or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    return {
        "email": [m.span() for m in EMAIL.finditer(t)],
        "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))],
        "phone": [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15],
    }


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet="ab.@+0159- ()%:/é,=\n", max_size=60))
def test_base_spans_equal_regular_expressions(text):
    got = pii.find_spans(text)
    assert {k: got[k] for k in pii.BASE} == brute(text)


@pytest.mark.parametrize("text, kind, value", [
    ("see ftp://bob:pw1@host.example/x now", "login", "bob:pw1"),
    ("IBAN: GB82 WEST 1234 5698 7654 32.", "iban", "GB82 WEST 1234 5698 7654 32"),
    ('TOKEN = "ff60d8d5b1b4"', "secret", "ff60d8d5b1b4"),
    ("account number: 123456789.", "secret", "123456789."),
])
def test_added_kinds(text, kind, value):
    assert [text[a:b] for a, b in pii.find_spans(text)[kind]] == [value]


@pytest.mark.parametrize("text", ["http://host.example/a@b", "IBAN: GB00 WEST 1234 5698 7654 32",
                                  "token = sentence", "the secret of it"])
def test_added_kinds_are_validated(text):
    got = pii.find_spans(text)
    assert not got["login"] and not got["iban"] and not got["secret"]


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = pii.scan(docs).collect()
    assert len(rows) == len(texts)
    hits = 0
    for r in rows:
        want = brute(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in pii.BASE]
        listed = ",".join(f"{k}:{a}:{b}" for k in pii.BASE for a, b in want[k])
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert r.spans.startswith(listed)
        hits += len(listed) > 0
    assert hits > 10


def test_odd_rows(make, odd):
    rows = pii.scan(make(odd)).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(r[0]) for r in odd)
    assert all(r.spans == "" and r.n_email == 0 for r in rows)
    assert pii.scan(make([])).collect() == []
    one = pii.scan(make([(2**60 + 1, "a@b.c"), (None, "x")])).filter("n_email = 1").collect()
    assert [r.doc_id for r in one] == [2**60 + 1] and one[0].spans == "email:0:5"


DE, GB, NL, NO = "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NL91ABNA0417164300", "NO93 8601 1117 947"


@pytest.mark.parametrize("text, found", [
    (f"IBAN {DE} BIC COBADEFFXXX", [DE]), (f"IBAN: {DE.replace(' ', '')} EUR 500", [DE.replace(" ", "")]),
    (f"IBAN {DE} 500 EUR", [DE]), (f"IBAN {DE}\nBIC X", [DE]), (f"IBAN {NO} A 1 B 2", [NO]),
    (f"IBAN {DE} IBAN {GB} BIC X", [DE, GB]), (f"IBAN {DE} {GB} EUR 1", [DE, GB]),
    (f"IBANs: {DE}", []), (f"IBAN {DE}, {GB}; {NL} and {NO}.", [DE, GB, NL, NO]),
    (f"IBAN {DE}00 x", []), (f"IBAN {DE.replace('89', '88')} BIC X", []), (f"IBAN {DE[:-3]}", []),
    ("IBAN MT84 MALT 0110 0001 2345 MTLC AST0 01S BIC X", ["MT84 MALT 0110 0001 2345 MTLC AST0 01S"]),
])
def test_account_numbers_end_where_their_country_says(text, found):
    assert [text[a:b] for a, b in pii.find_spans(text)["iban"]] == found


def test_account_number_of_a_country_without_an_entry():
    body = "ZZ00 1234 5678 9012"
    good = next(t for k in range(2, 99) if pii._mod97((t := body.replace("00", f"{k:02}", 1)).replace(" ", "")))
    text = f"IBAN {good} BIC ABCDEF"
    assert [text[a:b] for a, b in pii.find_spans(text)["iban"]] == [good]
