"""Line dedup: explode normalised lines, hash them, count the distinct documents
of each hash, drop the lines over the threshold, reassemble by position.

Only 16-byte hashes and ids cross the shuffles of the count; the text is moved
once, to meet the hashes its document loses. The count is a two-step distinct
aggregate (by hash and document, then by hash), so a line that a third of all
documents hold is spread over the tasks by document before it is counted.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import LOWER, SPACE, UPPER_AZ, as_bytes, bound_batches, free_names, spread_join, table

RESULT = "struct<text:string,n_lines:bigint,n_dropped:bigint>"


def _key(line: bytes) -> bytes:
    return line.strip(SPACE).translate(LOWER)


def _long_enough(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode("utf-8", "replace")) >= min_chars)


def line_hashes(text_col, min_chars: int = 1):
    """Array of the 16-byte hashes of a text's distinct line keys."""
    @F.arrow_udf("array<binary>")
    def hashes(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            keys = {_key(x) for x in t.as_py().split(b"\n")}
            out.append([xxhash.xxh3_128_digest(k) for k in keys if _long_enough(k, min_chars)])
        return pa.array(out, pa.list_(pa.binary()))

    return hashes(as_bytes(text_col))


def _reassemble(min_chars: int):
    @F.arrow_udf(RESULT)
    def kept(texts: pa.Array, lost: pa.Array) -> pa.Array:
        out, n_lines, n_dropped = [], [], []
        for t, gone in zip(texts, lost):
            lines = t.as_py().split(b"\n")
            gone = set(gone.as_py() or ())
            left = lines if not gone else [
                x for x in lines
                if not _long_enough(k := _key(x), min_chars) or xxhash.xxh3_128_digest(k) not in gone]
            out.append(b"\n".join(left))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(left))
        return pa.StructArray.from_arrays(
            [pc.cast(pa.array(out, pa.binary()), pa.string()), pa.array(n_lines, pa.int64()),
             pa.array(n_dropped, pa.int64())], ["text", "n_lines", "n_dropped"])

    return kept


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text_col`` rid of the lines whose key is found in at least
    ``min_docs`` documents, plus ``n_lines`` (before) and ``n_dropped``.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased;
    keys under ``min_chars`` code points are never dropped. A null or empty text
    is one empty line (and comes back empty). Repeated rows of one id count as
    one document and each is rebuilt; rows without an id count as no document
    but lose the lines that others made frequent. An empty table gives an empty
    table. Other columns pass through; ones named ``n_lines`` or ``n_dropped``
    are replaced. A very long text is split whole. A line at the threshold in as many
    documents as ``min_docs`` goes.
    """
    bound_batches(docs.sparkSession)
    i, t, lost, r = free_names(docs, "__i", "__t", "__lost", "__r")
    # a row's lines are told by its id and a hash of its text, so the rows without
    # an id are no group; where a hash is shared, all lines of the set are frequent
    # anyway and none is lost wrongly
    key = [F.coalesce(F.concat(F.lit("#"), F.col(id_col).cast("string")), F.lit("")).alias(i), F.xxhash64(text_col).alias(t)]
    seen = docs.select(*key, F.col(id_col).alias("__id"), F.explode(line_hashes(text_col, min_chars)).alias("__h"))
    frequent = (seen.groupBy("__h").agg(F.count_distinct("__id").alias("__n"))
                .filter(F.col("__n") >= min_docs).select("__h"))
    sets = spread_join(seen, frequent, ["__h"]).groupBy(i, t).agg(F.collect_set("__h").alias(lost))
    both = spread_join(docs.select("*", *key), sets, [i, t], "left")
    out = both.withColumn(r, _reassemble(min_chars)(as_bytes(text_col), F.col(lost)))
    cols = [F.col(f"{r}.text").alias(c) if c == text_col else F.col(f"`{c}`")
            for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*cols, F.col(f"{r}.n_lines").alias("n_lines"), F.col(f"{r}.n_dropped").alias("n_dropped"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_frequent_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def lines_sql(source: str, min_docs: int = 10) -> tuple[str, str]:
    """Two CTEs over ``source``: ``ld_lines`` and the rebuilt ``ld_kept``."""
    key = f"translate(trim(line, {_WS}), '{UPPER_AZ}', '{UPPER_AZ.lower()}')"
    lines = f"""ld_lines AS (
  SELECT doc_id, pos, line, {key} AS k FROM (
    SELECT doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {source})))"""
    kept = f"""ld_kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(b.k) AS n_dropped,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE b.k IS NULL), '') AS text
  FROM ld_lines l LEFT JOIN (
    SELECT k FROM ld_lines WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= {min_docs}) b
    ON l.k = b.k GROUP BY l.doc_id)"""
    return lines, kept


OP4_SQL = "WITH " + ",\n".join(lines_sql("documents")) + """
SELECT doc_id, n_lines, n_dropped, sha256(text) AS kept_sha256 FROM ld_kept"""
