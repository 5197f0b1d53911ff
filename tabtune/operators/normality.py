"""Shapiro-Wilk normality test per numeric column, distributed.

Statistic and p-value follow Royston (1995), "Remark AS R94", the public
algorithm behind the common Shapiro-Wilk implementations:

* m_i = Phi^-1((i - 3/8) / (n + 1/4)), mm = sum m_i^2, u = 1/sqrt(n);
* the two extreme coefficients get polynomial corrections in u, the rest
  are m_i / sqrt(phi) so that sum a_i^2 = 1; a is antisymmetric;
* W = (sum a_i x_(i))^2 / sum (x - mean)^2;
* n >= 12: log(1 - W) is normal with mean/sd polynomials in log(n);
  4 <= n <= 11: a gamma-transformed version; n = 3: exact.

Distribution: the order statistics come from ``ranks.column_value_ranks``
(range partitioned, no single-task sort).  A value repeated ``cnt`` times
occupies ranks ``start+1..start+cnt`` and takes part with the sum of their
scores.  The scores depend on n alone: their sums over blocks of ranks are
computed once for each distinct n, so a hot value (a third of all rows) costs
two lookups and the ranks at its ends, and mm is not summed for each column.

The summary per column (n, sum m_i x_(i), mm, x_(1), x_(2), x_(n-1), x_(n),
sum of squares) turns into W, z and p with the SQL text of
``shapiro_summary_sql``, which the DuckDB twin uses verbatim.
"""

from __future__ import annotations

import functools
import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabtune.functions.columns import numeric_columns, unpivot_numeric
from tabtune.functions.formulas import lit_sql, norm_ppf_sql, norm_sf_sql, poly_sql
from tabtune.operators.ranks import column_value_ranks, small_result

#: Least ranks of a block of scores.
MIN_BLOCK = 1024

# Royston (1995) AS R94 polynomial coefficients (constant term first).
SW_C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
SW_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SW_C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
SW_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
SW_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
SW_C6 = [-0.4803, -0.082676, 0.0030302]
SW_G = [-2.273, 0.459]
SW_SMALL_P = 1e-99  # p reported when log(1-W) is beyond the small-n gamma bound
P_RELIABLE_MAX_N = 5000  # published range of the p-value approximation


def m_sql(i: str, n: str) -> str:
    """Expected normal order statistic approximation m_i (SQL text)."""
    return norm_ppf_sql(f"((({i}) - {lit_sql(0.375)}) / (({n}) + {lit_sql(0.25)}))")


def shapiro_summary_steps() -> list[tuple[str, str]]:
    """Ordered (name, SQL) steps over summary columns n, mm, sm, ss, x1, x2,
    xn1, xn; each step may use the names of earlier steps.  Shared verbatim
    by the Spark operator and the DuckDB twin.  Ends with ``w``, ``z``, ``p``.
    """
    zero, one, two = lit_sql(0.0), lit_sql(1.0), lit_sql(2.0)
    nd = "CAST(n AS DOUBLE)"
    return [
        ("sw_u", f"({one} / sqrt({nd}))"),
        ("sw_mn", m_sql(nd, nd)),
        ("sw_mn1", m_sql(f"({nd} - {one})", nd)),
        ("sw_an", f"(sw_mn / sqrt(nullif(mm, {lit_sql(0.0)})) + {poly_sql(SW_C1, 'sw_u')})"),
        ("sw_an1", f"(sw_mn1 / sqrt(nullif(mm, {lit_sql(0.0)})) + {poly_sql(SW_C2, 'sw_u')})"),
        ("sw_d1", "(xn - x1)"),
        ("sw_d2", "(xn1 - x2)"),
        ("sw_fac", f"(CASE WHEN n > 5 THEN sqrt((mm - {two} * sw_mn * sw_mn - {two} * sw_mn1 * sw_mn1)"
                   f" / nullif({one} - {two} * sw_an * sw_an - {two} * sw_an1 * sw_an1, {zero}))"
                   f" ELSE sqrt((mm - {two} * sw_mn * sw_mn)"
                   f" / nullif({one} - {two} * sw_an * sw_an, {zero})) END)"),
        ("sw_ax", f"(CASE WHEN n > 5 THEN (sm - sw_mn * sw_d1 - sw_mn1 * sw_d2) / nullif(sw_fac, {zero})"
                  f" + sw_an * sw_d1 + sw_an1 * sw_d2"
                  f" WHEN n >= 4 THEN (sm - sw_mn * sw_d1) / nullif(sw_fac, {zero}) + sw_an * sw_d1"
                  f" ELSE sqrt({lit_sql(0.5)}) * sw_d1 END)"),
        ("w", f"(CASE WHEN ss <= {lit_sql(0.0)} THEN {one}"
              f" ELSE least(sw_ax * sw_ax / nullif(ss, {zero}), {one}) END)"),
        ("sw_y", f"(CASE WHEN w < {one} THEN ln({one} - w) END)"),
        ("sw_gamma", poly_sql(SW_G, nd)),
        ("z", f"(CASE WHEN w >= {one} OR n < 4 THEN NULL"
              f" WHEN n >= 12 THEN (sw_y - {poly_sql(SW_C5, f'ln({nd})')})"
              f" / exp({poly_sql(SW_C6, f'ln({nd})')})"
              f" WHEN sw_y >= sw_gamma THEN NULL"
              f" ELSE (-ln(sw_gamma - sw_y) - {poly_sql(SW_C3, nd)}) / exp({poly_sql(SW_C4, nd)}) END)"),
        ("p", f"(CASE WHEN w >= {one} THEN {one}"
              f" WHEN n = 3 THEN greatest({lit_sql(0.0)}, {lit_sql(1.90985931710274)}"
              f" * (asin(sqrt(w)) - {lit_sql(1.04719755119660)}))"
              f" WHEN n < 12 AND sw_y >= sw_gamma THEN {lit_sql(SW_SMALL_P)}"
              f" ELSE {norm_sf_sql('z')} END)"),
    ]


def _block(n: int) -> int:
    """Ranks of a block of scores: near the root of n, so that neither the blocks
    nor the ranks of one are many."""
    return max(MIN_BLOCK, 1 << math.ceil(math.log2(max(n, 2)) / 2))


def order_scores(spark: SparkSession, n: int) -> tuple[float, DataFrame]:
    """Of the n expected normal order statistics: the sum of their squares, and
    the sum of those before each block of ranks (n, blk, before).  Both depend
    on n alone, so columns with as many values share them."""
    block = _block(n)
    m = F.expr(m_sql("(id + 1)", f"CAST({n} AS BIGINT)"))
    sums = (spark.range(n).select(F.expr(f"id div {block}").alias("blk"), m.alias("m"))
            .groupBy("blk").agg(F.sum("m").alias("s"), F.sum(F.col("m") * F.col("m")).alias("s2"))
            .persist(StorageLevel.MEMORY_AND_DISK))
    upto = Window.orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)     # about the root of n rows
    before = sums.select(F.lit(n).cast("long").alias("n"), "blk",
                         F.coalesce(F.sum("s").over(upto), F.lit(0.0)).alias("before"))
    last = sums.agg(F.sum("s2"), F.sum("s"), F.max("blk") + 1).first()
    end = spark.createDataFrame([(n, last[2], last[1])], "n long, blk long, before double")
    return float(last[0]), before.unionAll(end)


def shapiro_summaries(ranked: DataFrame) -> DataFrame:
    """Per-column summary (column, n, mm, sm, ss, x1, x2, xn1, xn) from ranks.

    A value takes part with the sum of the scores of its ranks.  Up to two
    blocks of ranks are added one by one; those of a value that is repeated
    more often come from the sums of whole blocks and the ranks at either
    end, so a value costs the same from some repeats to any number."""
    spark = ranked.sparkSession
    v, cnt, start = F.col("value"), F.col("cnt"), F.col("start")
    stats = (ranked.groupBy("column")
             .agg((F.sum(v * cnt) / F.first("n")).alias("mean"), F.max("cnt").alias("most"), F.first("n").alias("n"))
             .collect())  # one row per column
    tables = {n: order_scores(spark, n) for n in sorted({int(r["n"]) for r in stats})}
    columns = spark.createDataFrame(
        [(r["column"], float(r["mean"]), _block(r["n"]), tables[int(r["n"])][0]) for r in stats],
        "column string, mean double, block long, mm double")
    rows = ranked.join(F.broadcast(columns), "column")       # one row per column: bounded
    block = F.col("block")
    hot = cnt > 2 * block
    first, last = F.ceil(start / block).cast("long"), F.floor((start + cnt) / block).cast("long")
    ends = F.when(hot, F.array(F.struct((start + 1).alias("lo"), (first * block).alias("hi")),
                               F.struct((last * block + 1).alias("lo"), (start + cnt).alias("hi")))).otherwise(
        F.array(F.struct((start + 1).alias("lo"), (start + cnt).alias("hi"))))
    pieces = rows.select("column", "value", "n", F.explode(ends).alias("e")).where("e.lo <= e.hi")
    single = (pieces.select("column", "value", "n", F.explode(F.sequence("e.lo", "e.hi")).alias("i"))
              .groupBy("column").agg(F.sum(F.col("value") * F.expr(m_sql("i", "n"))).alias("sm")))
    if any(r["most"] > 2 * _block(r["n"]) for r in stats):
        before = functools.reduce(DataFrame.unionAll, [t for _, t in tables.values()])
        whole = rows.where(hot).select("column", "value", "n", F.explode(F.array(
            F.struct(first.alias("blk"), F.lit(-1.0).alias("sign")),
            F.struct(last.alias("blk"), F.lit(1.0).alias("sign")))).alias("e"))
        whole = (whole.select("column", "value", "n", F.col("e.blk").alias("blk"), "e.sign").join(before, ["n", "blk"])
                 .groupBy("column").agg(F.sum(F.col("value") * F.col("sign") * F.col("before")).alias("sm")))
        single = single.unionAll(whole).groupBy("column").agg(F.sum("sm").alias("sm"))

    def at(rank):       # the value that holds a rank
        return F.max(F.when((start < rank) & (rank <= start + cnt), v))
    n = F.col("n")
    rest = rows.groupBy("column").agg(
        F.first("n").alias("n"), F.first("mm").alias("mm"),
        F.sum(cnt * F.pow(v - F.col("mean"), 2)).alias("ss"),
        at(F.lit(1)).alias("x1"), at(F.lit(2)).alias("x2"), at(n - 1).alias("xn1"), at(n).alias("xn"))
    return rest.join(single, "column").select("column", "n", "sm", "mm", "ss", "x1", "x2", "xn1", "xn")


def normality_from_summary(summary: DataFrame, alpha: float = 0.05) -> DataFrame:
    out = summary
    for name, text in shapiro_summary_steps():
        out = out.withColumn(name, F.expr(text))
    enough = F.col("n") >= 3  # the test needs three values; fewer gives nulls
    return out.select(
        "column", F.col("n").cast("long").alias("n"),
        *[F.when(enough, F.col(c)).alias(c) for c in ("w", "z", "p")],
        F.when(enough, F.col("p") > F.lit(float(alpha))).alias("is_normal"),
        (F.col("n") <= P_RELIABLE_MAX_N).alias("p_reliable"))


def normality_test(df: DataFrame, cols=None, alpha: float = 0.05,
                   ranked: DataFrame | None = None) -> DataFrame:
    """One row per numeric column: n, w, z, p, is_normal, p_reliable.

    Columns with fewer than 3 values get null statistics (the test is
    undefined there); the outlier gate then treats them as not normal.
    """
    cols = cols or numeric_columns(df)
    own = None
    if ranked is None:
        ranked = own = column_value_ranks(unpivot_numeric(df, cols))
    result = normality_from_summary(shapiro_summaries(ranked), alpha)
    return small_result(result, own) if own is not None else result
