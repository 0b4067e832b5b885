"""Quality rules: base counts of every text, and lines that too many documents of a host share.

Normalised lines are hashed; the distinct documents that hold a line are counted per host;
lines above the limit are removed; a document that loses most of its words so is rejected.
Equal texts count as one document, so copies do not turn an article into boilerplate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written
from .textgrams import mix64, word_hashes

LINE_LIMIT = 50
LEAST_LEFT = 0.5
SALTS = 16
_BLANK = " \t\n\x0b\x0c\r"
_DIGITS = re.compile(r"[0-9]+")
_GAPS = re.compile(r"[ \t\x0b\x0c\r]+")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def normalised(line: str) -> str:
    """Lower case, runs of digits as 0, single gaps, trimmed."""
    return _GAPS.sub(" ", _DIGITS.sub("0", line.lower())).strip()


def repeated_words(words: np.ndarray) -> int:
    """Words that lie in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    with np.errstate(over="ignore"):
        windows = mix64((words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + words[2:])
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(len(windows) + 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = again.copy()
    covered[1:] |= again[:-1]
    covered[2:] |= again[:-2]
    return int(covered.sum())


def measures(text: str | None) -> dict:
    """Base counts and the hashed lines with their words; zeros and no lines for a null or empty text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space alone
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    own = [normalised(x) for x in lines]
    return {
        "n_words": len(words),
        "word_chars": len(text) - sum(map(text.count, _BLANK)),
        "n_symbols": sum(map(text.count, "#*$%&|<>")),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(word_hashes([text])[0]),
        "text_hash": _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))),
        "lines": [_signed(xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"))) for x in own],
        "line_words": [len(x.encode("utf-8", "surrogatepass").split()) for x in lines],
    }


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, text_hash long, lines array<long>, line_words array<int>"


def with_measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    @F.pandas_udf(_FIELDS)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield pd.DataFrame([measures(t) for t in batch], columns=[f.strip().split(" ")[0] for f in _FIELDS.split(",")])

    return docs.withColumn("_m", of(F.col(text_col)))


def shared_lines(lines: DataFrame, limit: int = LINE_LIMIT) -> DataFrame:
    """``host, line`` of lines in more than ``limit`` distinct texts of a host, from rows (host, line, text_hash).

    Distinct first by all three columns and then counted, both with partial aggregation, so
    a line that every document holds is spread like any other."""
    return lines.groupBy("host", "line", "text_hash").agg(F.lit(1).alias("_x")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") > limit).select("host", "line")


def rule(docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: int = LINE_LIMIT, least_left: float = LEAST_LEFT) -> DataFrame:
    """``docs`` without its text, with the base counts, ``base_failed``, ``shared_words`` and ``kept``.

    Rows are judged one by one (repeated rows alike); a null host is a host of its own; a
    null or empty text has no words and fails the base rules. Columns of the input that are
    named like a result or a measure are replaced."""
    measured = with_measures(docs, text_col).withColumn("_row", F.monotonically_increasing_id())
    own = {f.strip().split(" ")[0] for f in _FIELDS.split(",")} | {"_row", "_host", "_m", "shared_words", "base_failed", "kept"}
    keep = [c for c in docs.columns if c != text_col and c not in own]
    rows = written(measured.select(*keep, F.col(host_col).alias("_host"), "_row", "_m.*"), "measures")
    each = rows.select("_row", "text_hash", F.struct(F.col("_host").alias("h")).alias("host"), F.explode(F.arrays_zip("lines", "line_words")).alias("_l")).select("_row", "text_hash", "host", F.col("_l.lines").alias("line"), F.col("_l.line_words").alias("_words"))
    bad = written(shared_lines(each, limit), "shared-lines").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lost = each.withColumn("_salt", F.pmod("_row", F.lit(SALTS)).cast("int")).join(bad, ["host", "line", "_salt"]).groupBy("_row").agg(F.sum("_words").alias("shared_words"))
    out = rows.join(lost, "_row", "left").withColumn("shared_words", F.coalesce("shared_words", F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    depleted = F.col("n_words") - F.col("shared_words") < least_left * F.col("n_words")
    return out.withColumns({"base_failed": failed, "kept": ~failed & ~depleted}).drop("_row", "_host", "text_hash", "lines", "line_words")


def query(spark, sf_dir: str) -> DataFrame:
    judged = rule(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "shared_words")


ORACLE = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
l AS MATERIALIZED (SELECT rid, unnest(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l GROUP BY 1),
g AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY 1),
norm AS MATERIALIZED (SELECT rid, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09\x0B-\x0D]+', ' ', 'g')) AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
bad AS (SELECT source, line FROM norm JOIN d USING (rid) GROUP BY 1, 2 HAVING count(DISTINCT t) > 50),
lost AS (SELECT rid, sum(n) AS n FROM norm JOIN d USING (rid) JOIN bad ON bad.line = norm.line AND bad.source IS NOT DISTINCT FROM d.source GROUP BY 1),
m AS (SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS shared_words
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND n_words - shared_words >= 0.5 * n_words AS kept, shared_words FROM f
"""
