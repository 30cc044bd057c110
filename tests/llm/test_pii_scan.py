"""Base spans against the plain patterns; the added kinds and their checks."""

import random
import re

import pytest

from snapweave.llm import pii_scan as P

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(t):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    return [[m.span() for m in EMAIL.finditer(t)],
            [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
            [m.span() for m in CARD.finditer(t) if 16 <= len(digits(m[0])) <= 19 and P.luhn(digits(m[0]))],
            [m.span() for m in PHONE.finditer(t) if 8 <= len(digits(m[0])) <= 15]]


def test_base_spans_of_random_texts():
    r = random.Random(3)
    for _ in range(40_000):
        t = "".join(r.choice("a1234 567890..--@@+() bé%_\n") for _ in range(r.randint(0, 50)))
        assert P.spans_of(t)[:P.BASE] == brute(t), t


def test_query_over_real_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in P.scan(docs).collect():
        want = ",".join(f"{k}:{a}:{b}" for k, f in zip(P.KINDS, brute(texts[r["id"]] or "")) for a, b in f)
        assert r["base"] == want
        assert r["spans"] == want  # nothing is added to texts without cues


@pytest.mark.parametrize("text,kind,value", [
    ("IBAN: GB82 WEST 1234 5698 7654 32.", "iban", "GB82 WEST 1234 5698 7654 32"),
    ("my ssn is 123-45-6789!", "ssn", "123-45-6789"),
    ("Account number: 12345678", "account", "12345678"),
    ("see ftp://user:pa55@host.example/x", "login", "user:pa55"),
])
def test_added_kinds(text, kind, value):
    found = P.spans_of(text)[P.KINDS.index(kind)]
    assert [text[a:b] for a, b in found] == [value]


@pytest.mark.parametrize("text", ["IBAN: GB82 WEST 1234 5698 7654 33", "ssn 666-45-6789", "account of 123", "http://host:80/",
                                  "on account of rain"])
def test_invalid_values_are_left(text):
    assert P.spans_of(text)[P.BASE:] == [[]] * (len(P.KINDS) - P.BASE)


def test_very_long_runs():
    assert P.spans_of("9" * 200_000 + " " + "a" * 200_000)[:P.BASE] == [[], [], [], []]
    assert P.spans_of("a" * 100_000 + "@b.c")[0] == [(0, 100_004)]


@pytest.mark.parametrize("text,kind,value", [
    ("IBAN: DE89370400440532013000 for the payment", "iban", "DE89370400440532013000"),
    ("IBAN GB82 WEST 1234 5698 7654 32 is mine", "iban", "GB82 WEST 1234 5698 7654 32"),
    ("İ iBAN no. no93 8601 1117 947 and so on and on and on and on", "iban", "no93 8601 1117 947"),
    ("IBAN MT84 MALT 0110 0001 2345 MTLC AST0 01S a b c", "iban", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"),
    ("IBAN XX89 1234 5678 9012 is of a country that is not listed", "iban", "XX89 1234 5678 9012"),
    ("Social security number: 123-45-6789", "ssn", "123-45-6789"),
    ("sOCIAL sECURITY 123-45-6789", "ssn", "123-45-6789"),
    ("İ aCCt 12345678", "account", "12345678"),
])
def test_words_after_and_cues_in_any_case(text, kind, value):
    found = P.spans_of(text)[P.KINDS.index(kind)]
    assert [text[a:b] for a, b in found] == [value]


@pytest.mark.parametrize("text", ["IBAN DE89370400440532013001 for the payment", "IBAN DE8937040044053201300 0000",
                                  "IBAN DE89370400440532013000x", "IBAN GB82 KEST 1234 5698 7654 32"])
def test_ibans_that_are_none(text):
    assert P.spans_of(text)[P.KINDS.index("iban")] == []


@pytest.mark.parametrize("text,kind,value", [
    ("IBAN - DE89370400440532013000", "iban", "DE89370400440532013000"), ("IBAN (DE89370400440532013000)", "iban", "DE89370400440532013000"),
    ("IBAN:\n  DE89370400440532013000", "iban", "DE89370400440532013000"), ("iban\t\tDE89 3704 0044 0532 0130 00", "iban", "DE89 3704 0044 0532 0130 00"),
    ("Account Number \u2013 12345678", "account", "12345678"), ("My account, 12345678", "account", "12345678"),
    ("Kontonummer? konto nr. 12345678", "account", "12345678"), ("account no.: 1234-5678", "account", "1234-5678"),
    ("Routing number: 021000021.", "routing", "021000021"), ("passport no. C01X00T47 or passport: X1234567", "passport", "X1234567"),
    ("ping 2001:db8::ff00:42:8329, please", "ipv6", "2001:db8::ff00:42:8329"), ("fe80::1", "ipv6", "fe80::1"),
    ("mac 00:1A:2b:3c:4D:5e up", "mac", "00:1A:2b:3c:4D:5e"),
    ("I live at 221B Baker Street, London", "address", "221B Baker Street"),
    ("Send it to 1600 Pennsylvania Avenue, Washington, DC 20500.", "address", "1600 Pennsylvania Avenue, Washington, DC 20500"),
    ("wohnt in der Friedrichstra\u00dfe 12a, 10117 Berlin seit", "address", "Friedrichstra\u00dfe 12a, 10117 Berlin"),
    ("au 12 rue de Rivoli, 75001 Paris", "address", "12 rue de Rivoli, 75001 Paris"),
    ("en la Calle de Alcal\u00e1, 45, 28014 Madrid", "address", "Calle de Alcal\u00e1, 45, 28014 Madrid"),
])
def test_ordinary_forms(text, kind, value):
    found = P.spans_of(text)[P.KINDS.index(kind)]
    assert [text[a:b] for a, b in found] == [value]


@pytest.mark.parametrize("text", ["at 12:30:45 sharp", "Routing number 021000022", "std::vector<int>", "a::b", "the long road to 12 towns", "rue the day",
                                  "drive 55 miles", "ratio 1:2:3", "00:1A:2b:3c:4D:5e:77", "No. 5 and road", "account of 12345678x", "::"])
def test_what_is_none(text):
    assert P.spans_of(text)[P.BASE:] == [[]] * (len(P.KINDS) - P.BASE)


def plain_added(text):
    """The added kinds that follow a cue, without automaton: every place where the cue stands is tried."""
    kinds = {"iban": P.IBAN, "ssn": P.SSN, "account": P.ACCOUNT, "routing": P.ROUTING, "passport": P.PASSPORT}
    out = {k: set() for k in kinds}
    for cue, kind in P.CUES.items():
        if kind in kinds:
            for m in re.finditer(re.escape(cue), text, re.I | re.A):
                v = kinds[kind].match(text, m.end())
                if not v:
                    continue
                span = v.span(1)
                if kind == "iban":
                    end = P.iban_end(text, *span)
                    span = end and (span[0], end)
                elif kind == "ssn" and not P.valid_ssn(v[1]) or kind == "routing" and not P.valid_routing(v[1]):
                    span = None
                if span:
                    out[kind].add(span)
    base = [s for k in P.spans_of(text)[:P.BASE] for s in k]
    return {k: sorted(s for s in v if not any(b[0] <= s[0] and s[1] <= b[1] for b in base)) for k, v in out.items()}


def test_added_kinds_against_a_plain_version():
    r = random.Random(11)
    parts = ["IBAN", "iban ", "DE89370400440532013000", " GB82 WEST 1234 5698 7654 32", "ssn", "Social Security", " 123-45-6789", "account", "Acct",
             " number", " no.", ":", " - ", "\n", " is ", "12345678", "021000021", "routing", "passport", " X1234567", "a@b.co ", "+4912345678", " word "]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        found = dict(zip(P.KINDS, P.spans_of(text)))
        assert {k: found[k] for k in ("iban", "ssn", "account", "routing", "passport")} == plain_added(text), text


def test_long_texts_of_anchors_take_linear_time():
    import time
    start = time.perf_counter()
    for t in ("street " * 30_000, "1:" * 100_000, "account " * 30_000, "12 Main Street " * 10_000):
        P.spans_of(t)
    assert time.perf_counter() - start < 30
