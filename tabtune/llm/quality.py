"""Quality rules at host level.

Each document is measured against simple rules; the failures are counted for
each host, the failure rates are shrunk towards the rate of all hosts with an
empirical beta prior, and the verdict on a host goes back to its documents.

Defined results: a null or wordless text has zero counts and fails the rule
on length; a null host is a host of its own; repeated rows count and come
back as often as they appear; an empty table gives an empty result; all other
columns of the input are kept, and the measures take other names if theirs
are in use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tabtune.llm import words as W
from tabtune.llm.frames import fresh, saved

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True
#: Rules: the condition under which a document fails.
RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
}
BASE = ("short", "repetitive")


def _repeats(part: W.Part) -> np.ndarray:
    """Of each text, the words inside windows of three that it has twice."""
    n = len(part.hash) - 2
    if n <= 0:
        return np.zeros(part.rows, dtype=np.int64)
    own = part.doc[:n] == part.doc[2:]
    at = np.flatnonzero(own)
    grams = W.mix(W.grams_hash(part.hash, 3)[at] + part.doc[at].astype(np.uint64) * W._GOLD)
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n + 2, dtype=bool)
    for i in range(3):
        covered[at[twice] + i] = True
    return np.bincount(part.doc[covered], minlength=part.rows)


def _lines(part: W.Part) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word of each text, and those equal to an earlier line."""
    every = np.zeros(part.rows, dtype=np.int64)
    again = np.zeros(part.rows, dtype=np.int64)
    for i in range(part.rows):
        lines = part.data[part.offs[i]:part.offs[i + 1]].tobytes().split(b"\n")
        lines = [x for x in lines if x.strip()]
        every[i], again[i] = len(lines), len(lines) - len(set(lines))
    return every, again


def measure_column(column: pa.Array) -> list[np.ndarray]:
    """The measures of each text, in the order of MEASURES."""
    out = [np.zeros(len(column), dtype=np.int64) for _ in MEASURES]
    for part in W.parts(column):
        at = slice(part.row, part.row + part.rows)
        lead = (part.data & 0xC0) != 0x80
        out[0][at] = np.diff(part.words_of())
        out[1][at] = part.per_text(lead & ~W.SPACE[part.data])
        out[2][at] = part.per_text(SYMBOL[part.data])
        out[5][at], out[3][at] = _lines(part)
        out[4][at] = _repeats(part)
    return out


def measure(docs: DataFrame, text: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the measures of its text, and the columns they are in."""
    names = fresh(docs, *MEASURES)
    index = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in names)])
    columns = [*docs.columns, *names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = measure_column(batch.column(index))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=columns)

    return docs.mapInArrow(run, schema), dict(zip(MEASURES, names))


def failed(rule: str, columns: dict[str, str]) -> Column:
    words = [f"`{columns[w]}`" if w in columns else w for w in RULES[rule].split()]
    return F.expr(" ".join(words))


def base_failed(columns: dict[str, str]) -> Column:
    out = F.lit(False)
    for rule in BASE:
        out = out | failed(rule, columns)
    return out


def host_verdicts(measured: DataFrame, columns: dict[str, str], host: str,
                  max_rate: float = 0.5, max_strength: float = 1000.0) -> DataFrame:
    """For each host: documents, the highest shrunk failure rate of a rule,
    and whether it exceeds ``max_rate``.

    For each rule the hosts' rates have mean m (over documents) and variance
    v between hosts, less what sampling explains; the prior is
    Beta(m s, (1 - m) s) with s = m (1 - m) / v - 1, at most ``max_strength``
    (also where v is not above 0).  A host's rate is its posterior mean.
    """
    counts = measured.groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(failed(r, columns).cast("long")).alias(r) for r in RULES])
    rates = counts.select("host", "n", F.explode(F.array(*[F.struct(
        F.lit(r).alias("rule"), F.col(r).alias("f")) for r in RULES])).alias("x"))
    rates = saved(rates.select("host", "n", "x.rule", "x.f"), "host-rates")
    mean = rates.groupBy("rule").agg((F.sum("f") / F.sum("n")).alias("m"))
    rates = rates.join(F.broadcast(mean), "rule")      # one row a rule
    m = F.col("m")
    prior = rates.groupBy("rule", "m").agg(
        (F.avg((F.col("f") / F.col("n") - m) * (F.col("f") / F.col("n") - m))
         - F.avg(m * (1 - m) / F.col("n"))).alias("v"))
    strength = F.when(F.col("v") > 0, F.greatest(F.lit(1.0), F.least(
        F.lit(max_strength), F.try_divide(m * (1 - m), F.col("v")) - 1))).otherwise(max_strength)
    prior = prior.select("rule", strength.alias("s"))
    rate = (F.col("f") + m * F.col("s")) / (F.col("n") + F.col("s"))
    return (rates.join(F.broadcast(prior), "rule").groupBy("host")
            .agg(F.max("n").alias("n_docs"), F.max(rate).alias("rate"))
            .withColumn("rejected", F.col("rate") > max_rate))


def judge(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = 0.5,
          keep_text: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with measures, ``base_failed``, ``host_rejected`` and ``kept``.

    Returned with the names of these columns.  With ``keep_text`` the texts
    are measured twice (once for the hosts, once for the result) instead of
    being written in between; without, the small measures are written.
    """
    few = docs.select(host, text) if keep_text else docs
    measured, columns = measure(few, text)
    measured = saved(measured.drop(text), "measures") if not keep_text else measured.drop(text)
    verdicts = host_verdicts(measured, columns, host, max_rate)
    if keep_text:
        measured, columns = measure(docs, text)
    *new, key = fresh(measured, "base_failed", "host_rejected", "kept", "_host")
    names = dict(zip(["base_failed", "host_rejected", "kept"], new))
    verdicts = verdicts.select(F.col("host").alias(key),
                               F.col("rejected").alias(names["host_rejected"]))
    out = (measured.join(verdicts, measured[host].eqNullSafe(verdicts[key]), "left")
           .drop(key)
           .withColumn(names["base_failed"], base_failed(columns)))
    out = out.withColumn(names["kept"], ~F.col(names["base_failed"]) & ~F.col(names["host_rejected"]))
    return out, columns | names


def keep_good(docs: DataFrame, text: str = "text", host: str = "source",
              max_rate: float = 0.5) -> DataFrame:
    """The documents that pass, with their columns as they came."""
    judged, names = judge(docs, text, host, max_rate)
    return judged.where(F.col(names["kept"])).select(*docs.columns)


QUERY_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed", "host_rejected", "kept"]


def query(docs: DataFrame) -> DataFrame:
    judged, names = judge(docs.select("doc_id", "source", "text"), keep_text=False)
    return judged.select(*[F.col(names.get(c, c)).alias(c) for c in QUERY_COLUMNS])


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS x FROM d)
), g AS (
  SELECT doc_id, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3
  FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) >= 2 AS twice
  FROM g
), c AS (
  SELECT doc_id, i, twice OR coalesce(lag(twice, 1) OVER o, false) OR coalesce(lag(twice, 2) OVER o, false) AS covered
  FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), rep AS (
  SELECT doc_id, count(*) AS n_words, sum(covered::INT) AS n_repeat_words FROM c GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, d.source, coalesce(n_words, 0) AS n_words, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN l USING (doc_id)
), f AS (
  SELECT *, n_words < 50 AS r1, 100 * n_repeat_words > 50 * n_words AS r2,
    10 * n_symbols > n_words AS r3, 10 * n_dup_lines > 3 * n_lines AS r4,
    word_chars < 2 * n_words OR word_chars > 20 * n_words AS r5
  FROM m
), h AS (
  SELECT source, count(*) AS n, sum(r1::INT) AS f1, sum(r2::INT) AS f2, sum(r3::INT) AS f3,
    sum(r4::INT) AS f4, sum(r5::INT) AS f5 FROM f GROUP BY source
), x AS (
  SELECT source, n, 1 AS rule, f1 AS f FROM h UNION ALL SELECT source, n, 2, f2 FROM h
  UNION ALL SELECT source, n, 3, f3 FROM h UNION ALL SELECT source, n, 4, f4 FROM h
  UNION ALL SELECT source, n, 5, f5 FROM h
), mm AS (
  SELECT rule, sum(f)::DOUBLE / sum(n) AS m FROM x GROUP BY rule
), v AS (
  SELECT rule, m, avg((f / n - m) * (f / n - m)) - avg(m * (1 - m) / n) AS v
  FROM x JOIN mm USING (rule) GROUP BY rule, m
), s AS (
  SELECT rule, m, CASE WHEN v > 0 THEN greatest(1.0, least(1000.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS s FROM v
), verdict AS (
  SELECT source, max((f + m * s) / (n + s)) > 0.5 AS host_rejected
  FROM x JOIN s USING (rule) GROUP BY source
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (r1 OR r2) AS base_failed, host_rejected, (NOT (r1 OR r2) AND NOT host_rejected) AS kept
FROM f LEFT JOIN verdict ON f.source IS NOT DISTINCT FROM verdict.source
"""
