import hashlib
import random
import re

import pytest
from conftest import SF_SMALL
from llm_helpers import docs_of

from barwise.llm.pii import KINDS, N_BASE, find_pii, luhn, mask_pii, op11_pii, personal_spans

RULES = [
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
]


def brute(text):
    return [(k, m.start(), m.end()) for k, (rule, good) in enumerate(RULES) for m in rule.finditer(text or "") if good(m)]


def base(text):
    return [s for s in personal_spans(text) if s[0] < N_BASE]


def said(spans):
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


CASES = [
    "", "@", "a@b", "a@b.c", "a@b@c.d", "a@b.c@d.e", "x..y@-.-", "a@b.c.", "a@b..c", "é@b.cé.d", "%@a.b%@c.d",
    "1.2.3.4", "1.2.3.4.5.6.7.8", "1.2.3.4.5.6.7", "256.1.1.1.2.3.4.5", "00255.0.0.0", "1..2.3.4.5", "1.2.3.4.",
    "4111 1111 1111 1111", "4111-1111-1111-1111", "4111  1111 1111 1111", "41111111111111111 1", "0" * 16, "0" * 20,
    "- 4111 1111-1111 1111 -", "+1 (499) 555-6503", "+1", "+12", "+1 2", "+1 23", "++4912345678", "+1 234 567 8+9 876 543 21",
    "+1 2345678).", "+1()))  ", "+1234567890123456", "٣٣٣٣ +٣٣٣٣٣٣٣٣٣", "+49 30 1234567 und a.b@c.de, 10.0.0.1;",
    "9" * 5000 + ".1.1.1", "1." * 3000, "a@" * 3000, "+1" * 3000, "1 " * 3000, "@b.c" * 2000,
]


@pytest.mark.parametrize("text", CASES)
def test_base_kinds(text):
    assert base(text) == [(k, s, e) for k, s, e in _slow(text)]


def _slow(text):
    import sys
    had = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    try:
        return brute(text)
    finally:
        sys.set_int_max_str_digits(had)


def test_base_kinds_random():
    rng = random.Random(7)
    pieces = ["@", ".", "-", " ", "+", "1", "42", "255", "4111", "a", "b.c", "(", ")", "%", "é", "\n", "x@y.z", "0000", "+49 1"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))
        assert base(text) == brute(text), text


def test_added_kinds():
    def added(text):
        return [(KINDS[k], text[s:e]) for k, s, e in personal_spans(text) if k >= N_BASE]

    assert added("write to jo.doe [at] host [dot] example.org now") == [("masked_email", "jo.doe [at] host [dot] example.org")]
    assert added("jo(at)host alone, look [at] me") == []
    assert added("see ftp://jo:pw@files.example.org/x and http://example.org/") == [("login", "ftp://jo:pw@files.example.org")]
    assert added("IBAN: DE89 3704 0044 0532 0130 00 ok") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert added("IBAN: DE88 3704 0044 0532 0130 00; ibandit") == []
    assert added("SSN 123-45-6789, ssn: 000-45-6789, SSN 123-45-67890") == [("ssn", "123-45-6789")]
    assert added("Account number: 12345678 and acct 123, accounts 12345678") == [("account", "12345678")]
    assert added("account no. 4111 1111 1111 1111") == []  # the card covers it
    assert added("Iban") == added("SSN") == added("acct:") == added("://") == added("[at]") == []


def test_operator(spark):
    rows = [(1, "a@b.c and +49 30 1234567"), (1, "a@b.c and +49 30 1234567"), (None, "10.0.0.1"), (2, None), (3, ""),
            (4, "word " * 200_000 + "z@y.x")]
    df = docs_of(spark, [(*r, "k") for r in rows], "doc_id long, text string, spans string")
    got = [(r.doc_id, [tuple(s) for s in r.spans]) for r in find_pii(df).collect()]
    assert sorted(got, key=str) == sorted([(i, brute(t)) for i, t in rows], key=str)
    assert find_pii(df.limit(0)).count() == 0
    masked = {(r.doc_id, r.text) for r in mask_pii(df).select("doc_id", "text").collect()}
    assert {(1, "<email> and <phone>"), (None, "<ip>"), (2, None), (3, "")} <= masked


def test_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op11_pii(spark, SF_SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        want, r = brute(d.text), got[d.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == n for k, *_ in want) for n in range(4))
        assert r.base_sha256 == hashlib.sha256(said(want).encode()).hexdigest()
        assert set(said(want).split(",")) <= set(r.spans.split(","))
