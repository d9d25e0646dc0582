"""Line deduplication across documents, with built-in functions only (operator 13).

Every text is split at ``\\n``.  A line's key is the line without blanks and 0x09-0x0D at both ends,
A-Z in lower case.  Keys of ``min_chars`` code points or more that ``min_docs`` documents or
more hold are shared: they lose all their lines except those in the largest ``doc_id`` that
holds them.  The other lines are put together again in their order.

1. Lines are exploded with their positions; a key goes on as two 64-bit hashes.
2. Counting distinct documents per key is two aggregations: one row per (key, document), dealt by
   both, then a partial count per key, so a line that a third of all documents hold is spread.
3. The lines meet the shared keys in a join whose hot keys are salted (``common.spread_join``).
4. What comes back to a document are the positions to leave out, never the lines; the text is
   shuffled once, to meet them.  Positions become an array of flags, zipped with the lines, so
   the work of a document grows with its length.

Edge cases: a NULL or empty text is one empty line and comes back empty; all rows with a NULL
``doc_id`` count as one document, smaller than every id; rows with equal id and text get the same
result, each of them; rows that repeat the largest id all keep their lines; columns named
``n_lines`` or ``n_dropped`` are replaced, all others are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, spread_join

MIN_CHARS, MIN_DOCS = 40, 5
BLANKS = " \t\n\x0b\f\r"


def _two_hashes(*columns):
    """128 bits from two differently seeded hashes."""
    return F.xxhash64(*columns), F.xxhash64(F.lit("line"), *columns)


def _with_row_key(docs: DataFrame) -> DataFrame:
    r1, r2 = _two_hashes("doc_id", "text")
    return docs.withColumns({"_r1": r1, "_r2": r2})


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``_r1, _r2`` (row), ``doc_id, pos``, ``h1, h2`` (key) of each line whose key is long enough."""
    lines = (_with_row_key(docs.select("doc_id", "text"))
             .select("_r1", "_r2", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
             .withColumn("line", F.btrim("line", F.lit(BLANKS)))
             .where(F.length("line") >= min_chars))
    h1, h2 = _two_hashes(F.translate("line", string.ascii_uppercase, string.ascii_lowercase))
    return lines.select("_r1", "_r2", "doc_id", "pos", h1.alias("h1"), h2.alias("h2"))


def shared_keys(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``h1, h2, n_docs, last`` (largest id), ``n_rows`` (lines) of each key in ``min_docs`` documents or more."""
    per_doc = lines.groupBy("h1", "h2", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return (per_doc.groupBy("h1", "h2")
            .agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last"), F.sum("n").alias("n_rows"))
            .where(F.col("n_docs") >= min_docs))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the shared lines taken out of ``text``, plus ``n_lines`` (before) and ``n_dropped``."""
    lines = line_keys(docs, min_chars)
    shared = scratch(shared_keys(lines, min_docs), "lines-shared")
    found = spread_join(lines, shared, ["h1", "h2"], weight="n_rows", spread=["_r1", "pos"])
    at = F.array_sort(F.collect_set("pos"))
    drops = (found.where(~F.col("doc_id").eqNullSafe(F.col("last")))
             .groupBy("_r1", "_r2").agg(at.alias("_at"))
             .withColumn("_before", F.slice(F.concat(F.array(F.lit(-1)), "_at"), F.lit(1), F.size("_at")))
             .withColumn("_flags", F.flatten(F.transform(
                 F.arrays_zip("_at", "_before"),
                 lambda x: F.concat(F.array_repeat(F.lit(True), x["_at"] - x["_before"] - 1), F.array(F.lit(False))))))
             .select("_r1", "_r2", "_flags", F.size("_at").alias("_n")))

    text = F.coalesce("text", F.lit(""))
    zipped = F.arrays_zip(F.col("_lines"), F.col("_flags"))
    kept = F.transform(F.filter(zipped, lambda x: F.coalesce(x["_flags"], F.lit(True))), lambda x: x["_lines"])
    return (_with_row_key(docs.drop("n_lines", "n_dropped")).join(drops, ["_r1", "_r2"], "left")
            .withColumn("_lines", F.split(text, "\n", -1))
            .withColumns({"text": F.when(F.col("_n").isNull(), text).otherwise(F.array_join(kept, "\n")),
                          "n_lines": F.size("_lines").cast("long"),
                          "n_dropped": F.coalesce("_n", F.lit(0)).cast("long")})
            .drop("_r1", "_r2", "_flags", "_n", "_lines"))


#: the same in DuckDB, on the lines themselves
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS row_key, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT row_key, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM docs),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM lines),
shared AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {MIN_CHARS}
           GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.last AS dropped
           FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY row_key, doc_id
"""
