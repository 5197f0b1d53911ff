"""Mixing sources to target weights by hierarchical budgets.

The leaves of a tree (here domain - language - source) hold documents.  A
token budget goes down the tree by the nodes' weights.  A node can take at
most what its leaves hold over ``max_epochs`` epochs; what a short node leaves
goes to its siblings in proportion to their weights, and only what a whole
family cannot take goes to the siblings of its parent.  Each leaf then gives
whole epochs and, of one more, a prefix in that epoch's seeded order.

Everything is integer arithmetic on DataFrames.  A leaf's prefix is found by
refining MD5 digits of the order, level by level, so that no leaf is sorted
or summed in one task.

Defined results: null or wordless texts hold no tokens and go with the prefix
they fall into; null tree columns form nodes of their own; repeated rows are
separate rows, ordered by tokens and id where the seeded order ties; nodes of
weight 0 give nothing; a document that crosses the budget is taken whole, with
the tokens up to the budget in ``take_tokens``; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabtune.llm.frames import fresh, n_words, saved

#: Hex digits by which each refinement narrows a leaf's order, and how often.
DIGITS, LEVELS = 2, 3
BIG = "decimal(38,0)"
#: Budget, as a share of all tokens, and most epochs of the registered query
#: and of the pipeline's stage.
FRACTION, EPOCHS = (1, 2), 2


def _weight(column: str, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for value, weight in sorted(weights.items()):
        out = F.when(F.col(column) == value, weight).otherwise(out)
    return F.coalesce(out, F.lit(default)).cast("long")


def _on(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    out = F.lit(True)
    for c in names:
        out = out & left[c].eqNullSafe(right[f"_{c}"])
    return out


def _under(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"_{c}" for c in names})


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budgets of the children of each parent: columns cap, w and the
    parent's b in, column budget out.  Children that are filled come first
    when ordered by cap / w; the rest share what is left by weight."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = family.orderBy(F.col("cap") / F.col("w"), F.col(name))
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    nodes = nodes.withColumns({
        "s": F.coalesce(F.sum("cap").over(past), F.lit(0)),
        "ws": F.sum("w").over(rest)})
    nodes = nodes.withColumn("full", F.expr(
        f"cast(cap as {BIG}) * ws <= cast(b - s as {BIG}) * w"))
    nodes = nodes.withColumns({
        "s": F.min(F.when(~F.col("full"), F.col("s"))).over(family),
        "ws": F.max(F.when(~F.col("full"), F.col("ws"))).over(family)})
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("cap")).otherwise(
        F.expr(f"cast((cast(b - s as {BIG}) * w) div ws as long)"))).drop("s", "ws", "full", "b")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: list[dict[str, int]],
                 default: int, fraction: tuple[int, int], max_epochs: int) -> DataFrame:
    """Token budget of each leaf (columns: levels, tokens -> + budget)."""
    weighted = leaves.select(*levels, "tokens", (F.col("tokens") * max_epochs).alias("cap"),
                             *[_weight(c, w, default).alias(f"w{i}")
                               for i, (c, w) in enumerate(zip(levels, weights))])
    for i in range(len(levels)):
        weighted = weighted.where(f"w{i} > 0")
    weighted = saved(weighted, "leaves")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    most = weighted.agg(F.coalesce(F.sum("cap"), F.lit(0))).first()[0]
    up, down = fraction
    budgets = leaves.sparkSession.range(1).select(
        F.lit(min(total * up // down, most)).cast("long").alias("b"))
    for i, name in enumerate(levels):
        parent, path = levels[:i], levels[:i + 1]
        nodes = weighted.groupBy(*path).agg(F.sum("cap").alias("cap"), F.max(f"w{i}").alias("w"))
        above = _under(budgets, parent)
        nodes = nodes.join(above, _on(nodes, above, parent)).drop(*[f"_{c}" for c in parent])
        budgets = _fill(nodes, parent, name).select(*path, F.col("budget").alias("b"))
    below = _under(budgets, levels)
    return (leaves.join(below, _on(leaves, below, levels), "left")
            .select(*levels, "tokens", F.coalesce("b", F.lit(0)).cast("long").alias("budget")))


def select(docs: DataFrame, levels: list[str], weights: list[dict[str, int]], id_col: str = "doc_id",
           text: str = "text", default: int = 1, fraction: tuple[int, int] = FRACTION,
           max_epochs: int = EPOCHS, seed: int = 42, mark: str | None = None) -> DataFrame:
    """Which rows the mixture takes: levels, id, n_tokens, epoch, take_tokens;
    and ``mark``, a column that tells rows apart which share an id."""
    marks = [F.col(mark).alias("mark")] if mark else []
    rows = docs.select(*levels, F.col(id_col).alias("id"), n_words(F.col(text)).alias("n_tokens"), *marks)
    rows = saved(rows, "mixing-rows")
    leaves = saved(rows.groupBy(*levels).agg(F.sum("n_tokens").alias("tokens")), "mixing-leaves")
    budgets = leaf_budgets(leaves, levels, weights, default, fraction, max_epochs)
    budgets = saved(budgets.where("budget > 0").withColumns({
        "whole": F.expr("budget div tokens"), "r": F.expr("budget % tokens")}), "mixing-budgets")

    top = _under(budgets.drop("tokens", "budget"), levels)
    under = [f"_{c}" for c in levels]
    rows = rows.join(top, _on(rows, top, levels)).drop(*under)
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"),
                               F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = saved(rows.withColumn("key", digest), "mixing-keys")
    # The bucket of each leaf in which its prefix ends, and the tokens before it.
    cut = budgets.where("r > 0").select(*levels, "r", F.lit("").alias("cut"), F.lit(0).cast("long").alias("before"))
    for level in range(1, LEVELS + 1):
        inside = _under(cut, levels)
        near = rows.drop("r").join(inside, _on(rows, inside, levels)
                                   & F.col("key").startswith(F.col("cut"))).drop(*under)
        sums = near.groupBy(*levels, "r", "before", F.substring("key", 1, DIGITS * level).alias("bucket")
                            ).agg(F.sum("n_tokens").alias("t"))
        past = (Window.partitionBy(*levels).orderBy("bucket")
                .rowsBetween(Window.unboundedPreceding, -1))
        sums = sums.withColumn("before", F.col("before") + F.coalesce(F.sum("t").over(past), F.lit(0)))
        cut = saved(sums.where("before + t >= r").groupBy(*levels, "r").agg(
            F.min_by("before", "bucket").alias("before"), F.min("bucket").alias("cut")), "mixing-cut")

    ends = _under(cut.drop("r"), levels)
    prefix = F.substring("key", 1, DIGITS * LEVELS)
    rows = rows.join(ends, _on(rows, ends, levels), "left").drop(*under)
    sure = rows.where(F.col("cut").isNull() | (prefix != F.col("cut")))
    sure = sure.withColumns({"more": F.coalesce((prefix < F.col("cut")).cast("int"), F.lit(0)),
                             "last": F.col("n_tokens")})
    past = (Window.partitionBy(*levels).orderBy("key", "n_tokens", "id", *["mark" for _ in marks])
            .rowsBetween(Window.unboundedPreceding, -1))
    edge = rows.where(prefix == F.col("cut"))
    edge = edge.withColumn("before", F.col("before") + F.coalesce(F.sum("n_tokens").over(past), F.lit(0)))
    edge = edge.withColumns({"more": (F.col("before") < F.col("r")).cast("int"),
                             "last": F.least(F.col("n_tokens"), F.col("r") - F.col("before"))})
    taken = sure.unionByName(edge).withColumn("times", F.col("whole") + F.col("more")).where("times > 0")
    taken = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return taken.select(*levels, "id", "n_tokens", "epoch",
                        F.when(F.col("epoch") < F.col("whole"), F.col("n_tokens"))
                        .otherwise(F.col("last")).alias("take_tokens"), *["mark" for _ in marks])


#: Target weights of the registered query.
LANG_WEIGHTS = {"en": 4, "fr": 2, "de": 2, "es": 1}
DOMAIN_WEIGHTS = {"0": 1, "1": 3, "2": 2}


def with_domain(docs: DataFrame, name: str = "domain") -> DataFrame:
    """The top of the tree: sources whose names end alike form a domain."""
    return docs.withColumn(name, F.right(F.col("source"), F.lit(1)))


def query(docs: DataFrame) -> DataFrame:
    taken = select(with_domain(docs.select("doc_id", "lang", "source", "text")),
                   ["domain", "lang", "source"], [DOMAIN_WEIGHTS, LANG_WEIGHTS, {}])
    return taken.withColumnRenamed("id", "doc_id")


def mix_documents(docs: DataFrame, fraction: tuple[int, int] = FRACTION, max_epochs: int = EPOCHS,
                  seed: int = 42) -> DataFrame:
    """A mixture as documents with their columns: a row stands as often as
    epochs take it, and whole where the budget ends.  A budget of nearly all
    tokens in one epoch takes each leaf almost whole and so misses the weights;
    the defaults, as in ``query``, leave room to reach them."""
    name, mark = fresh(docs, "domain", "_mixed")
    rows = saved(docs.withColumn(mark, F.monotonically_increasing_id()), "mixing-docs")
    taken = select(with_domain(rows, name), [name, "lang", "source"], [DOMAIN_WEIGHTS, LANG_WEIGHTS, {}],
                   fraction=fraction, max_epochs=max_epochs, seed=seed, mark=mark)
    taken = taken.select(F.col("mark").alias(mark))
    return rows.join(taken, mark).select(*docs.columns)


_LEVEL = """
n{k} AS (SELECT {path}, sum(cap) AS cap, max(w{i}) AS w FROM leaf GROUP BY ALL),
o{k} AS (
  SELECT *, coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
    sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM (SELECT n{k}.*, b{i}.b FROM n{k} JOIN b{i} ON {on})
),
p{k} AS (SELECT *, cap * ws <= (b - s) * w AS filled FROM o{k}),
q{k} AS (SELECT *, min(s) FILTER (NOT filled) OVER (PARTITION BY {parent}) AS su,
  max(ws) FILTER (NOT filled) OVER (PARTITION BY {parent}) AS wu FROM p{k}),
b{k} AS (SELECT {path}, CASE WHEN filled THEN cap ELSE ((b - su) * w) // wu END AS b FROM q{k}),"""


def oracle() -> str:
    levels = ["domain", "lang", "source"]
    case = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS, "source": {}}
    weights = ", ".join(
        (f"CASE {c} " + " ".join(f"WHEN '{v}' THEN {w}" for v, w in case[c].items()) + " ELSE 1 END"
         if case[c] else "1") + f"::HUGEINT AS w{i}" for i, c in enumerate(levels))
    chain = "".join(_LEVEL.format(
        k=i + 1, i=i, path=", ".join(levels[:i + 1]), name=c, parent=", ".join(levels[:i]) or "1",
        on=" AND ".join(f"n{i + 1}.{x} IS NOT DISTINCT FROM b{i}.{x}" for x in levels[:i]) or "true")
        for i, c in enumerate(levels))
    return rf"""
WITH d AS (
  SELECT right(source, 1) AS domain, lang, source, doc_id,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens FROM documents
),
tot AS (SELECT domain, lang, source, sum(n_tokens)::HUGEINT AS tokens FROM d GROUP BY ALL),
leaf AS (SELECT *, tokens * 2 AS cap, {weights} FROM tot),
b0 AS (SELECT least((SELECT sum(tokens) FROM tot) // 2, (SELECT sum(cap) FROM leaf)) AS b),{chain}
x AS (
  SELECT d.*, b3.b // t.tokens AS whole, b3.b % t.tokens AS r
  FROM d JOIN b3 ON d.domain IS NOT DISTINCT FROM b3.domain AND d.lang IS NOT DISTINCT FROM b3.lang AND d.source IS NOT DISTINCT FROM b3.source
  JOIN tot t ON d.domain IS NOT DISTINCT FROM t.domain AND d.lang IS NOT DISTINCT FROM t.lang AND d.source IS NOT DISTINCT FROM t.source
  WHERE b3.b > 0
),
y AS (
  SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5(concat_ws(':', '42', whole::BIGINT::VARCHAR, coalesce(doc_id::VARCHAR, ''))), n_tokens, doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x
),
z AS (SELECT *, whole + (before < r)::INT AS times FROM y),
e AS (SELECT *, unnest(range(0, times::BIGINT)) AS epoch FROM z)
SELECT domain, lang, source, doc_id, n_tokens, epoch::BIGINT AS epoch,
  (CASE WHEN epoch < whole THEN n_tokens ELSE least(n_tokens, r - before) END)::BIGINT AS take_tokens FROM e
"""
