"""Personal data by anchor expansion.

One Aho-Corasick automaton passes over a text and reports its anchors: at-signs,
a plus before a digit, neighbouring digits, schemes and identifier cues (IBAN,
SSN, account). Each anchor goes to a local parser that reads left and right of
it over fixed character sets, never backtracks, and validates what it has found:
labels of a domain, parts of an address, the Luhn sum of a card, the mod-97 sum
of an IBAN, the closed number ranges of an SSN.

Base kinds are ``email``, ``ip``, ``card`` and ``phone``. The other kinds are
added: ``masked_email`` (name [at] host [dot] tld), ``login`` (an address whose
user part names an account, scheme://user@host), ``iban``, ``ssn`` and
``account`` (a number after an account cue); an added span that a base span
covers is left out. Nothing leaves a row, so nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import bound_batches, table

KINDS = ["email", "ip", "card", "phone", "masked_email", "login", "iban", "ssn", "account"]
EMAIL, IP, CARD, PHONE, MASKED, LOGIN, IBAN, SSN, ACCOUNT = range(len(KINDS))
N_BASE = 4

DIGITS = frozenset("0123456789")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LABEL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-")
ALNUM = LABEL - {"-"}
LOCAL = ALNUM | set("._%+-")
PHONE_BODY = DIGITS | set(" ().-")
USER_INFO = ALNUM | set("-._~!$&'()*+,;=:%")
AT_WORDS = ("[at]", "(at)", "{at}")
DOT_WORDS = ("[dot]", "(dot)", "{dot}", ".")
IBAN_CUES = ("iban",)
SSN_CUES = ("ssn", "social security")
ACCOUNT_CUES = ("account number", "account no", "acct", "routing number", "kontonummer", "numéro de compte", "número de cuenta")

Span = tuple[int, int]


def run_right(text: str, at: int, chars: frozenset) -> int:
    """End of the run of ``chars`` that starts at ``at``."""
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def run_left(text: str, at: int, chars: frozenset, least: int = 0) -> int:
    """Start of the run of ``chars`` that ends before ``at``, not before ``least``."""
    while at > least and text[at - 1] in chars:
        at -= 1
    return at


def chain_right(text: str, at: int, chars: frozenset, links: str) -> int:
    """End of runs of ``chars`` joined by single ``links``; ``at`` lies in the first."""
    at = run_right(text, at, chars)
    while at + 1 < len(text) and text[at] in links and text[at + 1] in chars:
        at = run_right(text, at + 1, chars)
    return at


def chain_left(text: str, at: int, chars: frozenset, links: str) -> int:
    at = run_left(text, at, chars)
    while at > 1 and text[at - 1] in links and text[at - 2] in chars:
        at = run_left(text, at - 1, chars)
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i & 1:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


class Scan:
    """Spans of one text. ``done`` holds, a kind, the end of the last stretch
    that was read: an anchor before it belongs to that stretch."""

    def __init__(self, text: str):
        self.text, self.done = text, [0] * len(KINDS)
        self.spans: list[list[Span]] = [[] for _ in KINDS]

    def email(self, at: int, _end: int) -> None:
        start = run_left(self.text, at, LOCAL, self.done[EMAIL])
        first = run_right(self.text, at + 1, LABEL)
        end = chain_right(self.text, at + 1, LABEL, ".")
        if start < at and at + 1 < first < end:
            self.spans[EMAIL].append((start, end))
            self.done[EMAIL] = end

    def numbers(self, at: int, end: int) -> None:
        if self.text[at + 1] == "." and end - at == 3:
            self.ip(at)
        else:
            self.card(at)

    def ip(self, at: int) -> None:
        if at < self.done[IP]:
            return
        start, end = chain_left(self.text, at, DIGITS, "."), chain_right(self.text, at, DIGITS, ".")
        self.done[IP] = end
        parts = self.text[start:end].split(".")
        for k in range(0, len(parts) - 3, 4):
            own = parts[k:k + 4]
            stop = start + sum(map(len, own)) + 3
            if all(len(short := p.lstrip("0")) <= 3 and int(short or 0) <= 255 for p in own):
                self.spans[IP].append((start, stop))
            start = stop + 1

    def card(self, at: int) -> None:
        if at < self.done[CARD]:
            return
        start, end = chain_left(self.text, at, DIGITS, " -"), chain_right(self.text, at, DIGITS, " -")
        self.done[CARD] = end
        if 16 <= end - start <= 37 and 16 <= len(digits := _only_digits(self.text[start:end])) <= 19 and luhn(digits):
            self.spans[CARD].append((start, end))

    def phone(self, at: int, _end: int) -> None:
        end = run_right(self.text, at + 2, PHONE_BODY)
        while end > at + 3 and self.text[end - 1] not in DIGITS:
            end -= 1
        if end > at + 3 and 8 <= len(_only_digits(self.text[at:end])) <= 15:
            self.spans[PHONE].append((at, end))

    def masked(self, at: int, end: int) -> None:
        stop = at - (at > 0 and self.text[at - 1] == " ")
        start = run_left(self.text, stop, LOCAL, self.done[MASKED])
        go = end + (self.text[end:end + 1] == " ")
        labels, last = 0, go
        while (stop_label := run_right(self.text, go, LABEL)) > go:
            labels, last = labels + 1, stop_label
            go = last + (self.text[last:last + 1] == " ")
            dot = next((d for d in DOT_WORDS if self.text[go:go + len(d)].lower() == d), None)
            if dot is None or dot == "." and go > last:
                break
            go += len(dot)
            if dot != ".":
                go += self.text[go:go + 1] == " "
        if start < stop and labels > 1:
            self.spans[MASKED].append((start, last))
            self.done[MASKED] = last

    def login(self, at: int, end: int) -> None:
        start = run_left(self.text, at, ALNUM, self.done[LOGIN])
        user = run_right(self.text, end, USER_INFO)
        if user == end or self.text[user:user + 1] != "@" or start == at:
            return
        stop = chain_right(self.text, user + 1, LABEL, ".")
        if stop > user + 1:
            self.spans[LOGIN].append((start, stop))
            self.done[LOGIN] = stop

    def _after_cue(self, at: int, end: int) -> int | None:
        """Where the value of a cue starts: past blanks, colons, # and =."""
        if at and self.text[at - 1] in ALNUM or self.text[end:end + 1] in ALNUM:
            return None
        return run_right(self.text, end + (self.text[end:end + 1] == "."), frozenset(" :#=\t"))

    def iban(self, at: int, end: int) -> None:
        start = self._after_cue(at, end)
        if start is None or start < self.done[IBAN]:
            return
        chars, stop = [], start
        best = None
        while stop < len(self.text) and len(chars) < 34:
            c = self.text[stop]
            if c in UPPER or c in DIGITS:
                chars.append(c)
            elif c != " " or self.text[stop - 1] == " ":
                break
            stop += 1
            if len(chars) >= 15 and c != " " and self._mod97("".join(chars)) and self.text[stop:stop + 1] not in ALNUM:
                best = stop
        if best:
            self.spans[IBAN].append((start, best))
            self.done[IBAN] = best

    @staticmethod
    def _mod97(s: str) -> bool:
        if not (s[0] in UPPER and s[1] in UPPER and s[2] in DIGITS and s[3] in DIGITS):
            return False
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1

    def ssn(self, at: int, end: int) -> None:
        start = self._after_cue(at, end)
        if start is None or start < self.done[SSN]:
            return
        stop = chain_right(self.text, start, DIGITS, "-")
        a, b, c = (*self.text[start:stop].split("-"), "", "")[:3]
        if stop - start == 11 and (len(a), len(b), len(c)) == (3, 2, 4) and a not in ("000", "666") \
                and a < "900" and b != "00" and c != "0000":
            self.spans[SSN].append((start, stop))
            self.done[SSN] = stop

    def account(self, at: int, end: int) -> None:
        start = self._after_cue(at, end)
        if start is None or start < self.done[ACCOUNT]:
            return
        stop = chain_right(self.text, start, DIGITS, " -")
        if stop - start <= 40 and 6 <= len(_only_digits(self.text[start:stop])) <= 17:
            self.spans[ACCOUNT].append((start, stop))
            self.done[ACCOUNT] = stop


@lru_cache(1)
def anchors() -> ahocorasick.Automaton:
    """Anchors and the parser of each. A cue is found in lower, upper and title case."""
    a = ahocorasick.Automaton()

    def add(word: str, parser: Callable) -> None:
        a.add_word(word, (len(word), parser))

    add("@", Scan.email)
    add("://", Scan.login)
    for x in sorted(DIGITS):
        add(f"+{x}", Scan.phone)
        for y in sorted(DIGITS):
            for link in ("", " ", "-", "."):
                add(x + link + y, Scan.numbers)
    for words, parser in ((AT_WORDS, Scan.masked), (IBAN_CUES, Scan.iban), (SSN_CUES, Scan.ssn), (ACCOUNT_CUES, Scan.account)):
        for w in words:
            for form in dict.fromkeys((w, w.upper(), w.capitalize(), w.title())):
                add(form, parser)
    a.make_automaton()
    return a


def personal_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start, in code points, end exclusive."""
    scan = Scan(text)
    for last, (length, parser) in anchors().iter(text):
        parser(scan, last + 1 - length, last + 1)
    base = [(k, s, e) for k in range(N_BASE) for s, e in scan.spans[k]]
    by_start = sorted((s, e) for _, s, e in base)
    starts, reach = [s for s, _ in by_start], list(accumulate((e for _, e in by_start), max))
    added = [(k, s, e) for k in range(N_BASE, len(KINDS)) for s, e in scan.spans[k]
             if not (n := bisect_right(starts, s)) or reach[n - 1] < e]
    return base + added


SPANS = "array<struct<kind:int,start:bigint,end:bigint>>"
_SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))


def _span_udf():
    @F.arrow_udf(SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        found = (personal_spans(t.as_py()) for t in texts)
        return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in own] for own in found], _SPANS)

    return spans


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans), one row per row of ``docs``; ``spans`` is an array of
    (kind: index in ``KINDS``, start, end) by kind, then start, in code points.

    Null and empty texts have no spans; a null id passes through; repeated rows
    each get theirs. A very long text is read whole: time follows its length, as
    a stretch of digits is read once however many anchors it holds. Two spans of
    one kind never overlap, so there are no ties in the order. An empty table
    gives an empty table; other columns are not read, whatever their names.
    """
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), _span_udf()(F.coalesce(F.col(text_col), F.lit(""))).alias("spans"))


def mask_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each found stretch of ``text_col`` replaced by its kind in
    angle brackets (overlapping spans: by the kind of the one that starts first,
    then the lower kind). A null text stays null; all other columns stay."""
    bound_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text = t.as_py()
            if text is None:
                out.append(None)
                continue
            parts, at = [], 0
            for start, kind, end in sorted((s, k, e) for k, s, e in personal_spans(text)):
                if start >= at:
                    parts += [text[at:start], f"<{KINDS[kind]}>"]
                at = max(at, end)
            out.append("".join([*parts, text[at:]]))
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, masked(F.col(text_col)))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: counts of the base kinds, a digest of their spans, all spans."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(N_BASE)],
        F.sha2(said(F.filter("spans", lambda s: s["kind"] < N_BASE)).cast("binary"), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"))
