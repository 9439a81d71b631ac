"""Secret scans: fixed patterns, plus a randomness test battery.

A candidate of the battery is a run of 16 or more token characters. Its encoding
is the smallest alphabet that holds it (digits, hex, letters of one case, base32,
lower-case alphanumeric, base64), and three tests ask whether it looks drawn
evenly from it: chi-squared uniformity, runs about the median, serial
correlation. Fisher's method joins them to one p-value of randomness.

Runs of letters in one case are the control group of the other encodings. Those
that several documents use are words for certain, and the control group of the
rest: letters in one case that a single document uses are candidates, too. The
chance that a control word looks as random as a candidate is read off the words
of its length band or shorter (shorter ones look more random, so this errs to
caution), over base64 for mixed candidates and over the letters for those of
letters alone; where few words are known, no candidate passes. Benjamini-Hochberg per length band keeps false discoveries under ``fdr``. Each
distinct token counts once; only the histogram of the scores (strata x bands x
bins, a fixed size) reaches the driver.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import bound_batches, cut, spread_join, table

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")

BINS = 1000
BANDS = [16, 20, 24, 32, 40, 64, 128, 1 << 62]  # lower ends of the length bands
HEX_DIGITS = "0123456789abcdef"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
LOWER36 = "0123456789abcdefghijklmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
LETTERS = "abcdefghijklmnopqrstuvwxyz"
_VALUES = [(set(a), {c: i for i, c in enumerate(a)})
           for a in (HEX_DIGITS[:10], HEX_DIGITS, LETTERS, LETTERS.upper(), BASE32, LOWER36, BASE64)]
#: candidates of letters in one case are held against words over the letters
MIXED, LETTERS_ONLY = 0, 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, leftmost non-overlapping a kind."""
    out = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(values: list[int], k: int) -> float:
    """Combined p-value of an even draw from an alphabet of ``k``: near 0 for
    text, uniform on [0, 1] for random strings."""
    n = len(values)
    chi = k / n * sum(c * c for c in Counter(values).values()) - n
    p = [0.5 * math.erfc((chi - (k - 1)) / math.sqrt(2 * (k - 1)) / math.sqrt(2))]
    high = [2 * v >= k for v in values]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p.append(_two_sided((runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    m = sum(values) / n
    d = [v - m for v in values]
    ss = sum(x * x for x in d)
    p.append(_two_sided((sum(x * y for x, y in zip(d, d[1:])) / ss + 1 / n) * math.sqrt(n)) if ss else 0.0)
    h = -sum(math.log(max(x, 1e-300)) for x in p)
    return math.exp(-h) * (1 + h + h * h / 2)


@lru_cache(1 << 17)
def battery(token: str) -> tuple[int, int, int, int] | None:
    """(stratum, length band, score bin, score bin over base64) of a token; None:
    no candidate. The last one is for letters in one case only, else -1."""
    body = token.rstrip("=")
    band = sum(len(body) >= b for b in BANDS) - 1
    bare = body.replace("-", "").replace("_", "")
    if len(body) < BANDS[0] or len(set(bare)) < 2:
        return None
    letters = body.isalpha() and (body[1:].islower() or body.isupper())

    def score(use: str, value: dict[str, int]) -> int:
        return min(BINS - 1, int(randomness([value[c] for c in use], len(value)) * BINS))

    whole = body.replace("-", "+").replace("_", "/")
    if letters:  # a capital in front is a word's, too
        return LETTERS_ONLY, band, score(body.lower(), _VALUES[2][1]), score(whole, _VALUES[-1][1])
    for n, (chars, value) in enumerate(_VALUES):
        use = bare if n < len(_VALUES) - 1 else whole
        if chars.issuperset(use):
            return MIXED, band, score(use, value), -1
    return None


def _scan(text: str) -> dict:
    cand = []
    for m in TOKEN.finditer(text):
        if (b := battery(m[0])) is not None:
            cand.append({"start": m.start(), "end": m.end(), "stratum": b[0], "band": b[1], "bin": b[2], "word_bin": b[3],
                         "h": xxhash.xxh64_intdigest(m[0], 7) - (1 << 63)})
    return {"base": [{"start": s, "end": e, "kind": k} for s, e, k in base_spans(text)], "cand": cand}


def thresholds(cand: dict[tuple[int, int], int], control: dict[tuple[int, int], int], fdr: float) -> list[int]:
    """Least accepted score bin of each band (``BINS``: nothing accepted), from
    the counts by (band, bin)."""
    out = []
    for band in range(len(BANDS) - 1):
        below = [sum(control.get((b, k), 0) for b in range(band + 1)) for k in range(BINS)]
        own = [cand.get((band, k), 0) for k in range(BINS)]
        total, m, least = sum(below), sum(own), BINS
        over = found = 0
        for k in range(BINS - 1, -1, -1):
            over, found = over + below[k], found + own[k]
            if own[k] and (1 + over) / (1 + total) <= fdr * found / m:
                least = k
        out.append(least)
    return out


def find_secrets(docs: DataFrame, fdr: float = 0.05, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans), one row per row of ``docs``; ``spans`` is an array of
    (start, end, kind) in code points, end exclusive, by start, then kind.

    Fixed patterns are always reported; a random token is added where it
    overlaps none of them. Null and empty texts have no spans; repeated rows
    each get theirs; a null id passes through and tells no documents apart. A
    very long text is read whole. Spans that start alike come by kind. An empty
    table gives an empty table; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    span = [("start", pa.int64()), ("end", pa.int64())]
    kind = pa.struct([("base", pa.list_(pa.struct([*span, ("kind", pa.int32())]))),
                      ("cand", pa.list_(pa.struct([*span, *((c, pa.int32()) for c in ("stratum", "band", "bin", "word_bin")), ("h", pa.int64())])))])

    @F.arrow_udf("struct<base:array<struct<start:bigint,end:bigint,kind:int>>,"
                 "cand:array<struct<start:bigint,end:bigint,stratum:int,band:int,bin:int,word_bin:int,h:bigint>>>")
    def scan(texts: pa.Array) -> pa.Array:
        return pa.array([_scan(t.as_py()) for t in texts], kind)

    # written once, so the row numbers are the same in every job
    seen = cut(docs.select(F.col(id_col).alias("doc_id"), scan(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))
               .select("doc_id", "s.*", F.monotonically_increasing_id().alias("row")))
    tokens = (seen.select("doc_id", F.explode("cand").alias("c")).select("doc_id", "c.*")
              .groupBy("h", "stratum", "band", "bin", "word_bin").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")))
    word = (F.col("stratum") == LETTERS_ONLY) & F.coalesce(F.col("a") != F.col("b"), F.lit(False))
    counts: dict[tuple, dict] = {}
    own = F.struct(word.alias("word"), F.col("stratum").alias("stratum"), F.col("bin").alias("bin"))
    control = F.struct(F.lit(True).alias("word"), F.lit(MIXED).alias("stratum"), F.col("word_bin").alias("bin"))
    bins = F.when(F.col("stratum") == LETTERS_ONLY, F.array(own, control)).otherwise(F.array(own))
    scores = tokens.select("band", F.explode(bins).alias("s")).select("band", "s.*")
    for r in scores.groupBy("word", "stratum", "band", "bin").count().collect():
        counts.setdefault((r.word, r.stratum), {})[r.band, r.bin] = r["count"]
    least = F.array(*[F.lit(x) for stratum in (MIXED, LETTERS_ONLY)
                      for x in thresholds(counts.get((False, stratum), {}), counts.get((True, stratum), {}), fdr)])
    bands = len(BANDS) - 1
    random_ = lambda c: c["bin"] >= F.element_at(least, c["stratum"] * bands + c["band"] + 1)
    base = F.col("base")
    apart = lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    found = seen.select("doc_id", "row", "base", F.filter("cand", lambda c: random_(c) & apart(c)).alias("cand"))
    # words that look random all the same are no finding
    letters = found.select("row", F.explode(F.filter("cand", lambda c: c["stratum"] == LETTERS_ONLY)).alias("c")).select("row", "c.h")
    words = spread_join(letters, tokens.filter(word).select("h").distinct(), ["h"]).groupBy("row").agg(F.collect_set("h").alias("words"))
    found = found.join(words, "row", "left")
    added = F.transform(
        F.filter("cand", lambda c: ~F.coalesce(F.array_contains("words", c["h"]), F.lit(False))),
        lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(3).alias("kind")))
    order = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    ranked = F.array_sort(F.transform(F.concat(base, added), order))
    return found.select("doc_id", F.transform(ranked, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("spans"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(said(F.filter("spans", lambda s: s["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"))
