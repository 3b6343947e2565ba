"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

The tree has one level per entry of `levels` (domain, language, source). The token budget of a node goes to its children in
proportion to their weights; what a child cannot hold (its tokens times `max_epochs`, summed over its subtree) is shared out
among its siblings by weight, again and again, and only what the whole family cannot hold is left to the
ancestor's other children, whose share was fixed with the same rule one level up. All amounts are whole tokens; the remainder of
a division goes one token each to the first children by name that can still hold it.

A leaf's budget is filled from seeded epochs: in every epoch the rows of the leaf are ordered by a seeded digest, whole epochs
are taken as often as they fit, and the last one is taken as a prefix: rows as long as their running token count stays
within the rest. The running count is found from sums per (leaf, digest range); only the one range in which a prefix ends is
ordered row by row, so a source with a third of all rows is never one task's sort.

Defined cases: null levels form a group of their own (key ''); null text has no tokens, and such rows are taken with every
epoch that is taken whole and inside a prefix that has room for a token; repeated rows are rows of their own, of which as many are taken as the budget holds; an empty table gives
an empty result; weights that are not given are `default_weight`, and those of 0 or below exclude the subtree with all its rows; other columns are ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayglass.llm.shared import written

WIDE = "decimal(38,0)"


def count_tokens(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def weight_of(level: str, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for key, w in sorted(weights.items()):
        out = F.when(F.col(level) == key, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def fill(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share `have` of each parent among its children (weight w, capacity cap) and call the amounts `got`.

    In order of cap / w, a child is full exactly if its capacity is at most its share of what is left when all before it are
    full; the rest share what remains in proportion.
    """
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy((F.col("cap") / F.col("w").cast("double")), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    dec = lambda c: F.col(c).cast(WIDE)
    ranked = (
        children.withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("w_rest", F.sum("w").over(by) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("full", dec("cap") * dec("w_rest") <= (F.col("have") - F.col("cap_before")).cast(WIDE) * dec("w"))
    )
    shared = (
        ranked.withColumn("left", F.col("have") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by))
        .withColumn("w_open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("w"))).over(by))
        .withColumn("base", F.when(F.col("full"), F.col("cap")).otherwise(
            F.expr("cast((cast(left as decimal(38,0)) * cast(w as decimal(38,0))) div cast(w_open as decimal(38,0)) as bigint)")))
    )
    spare = F.col("have") - F.sum("base").over(by)
    takers = F.row_number().over(by.orderBy(F.when(F.col("base") < F.col("cap"), 0).otherwise(1), name))
    return (
        shared.withColumn("got", F.col("base") + F.when((F.col("base") < F.col("cap")) & (takers <= spare), 1).otherwise(0))
        .drop("cap_before", "w_rest", "full", "left", "w_open", "base", "have")
    )


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int | None, share: float, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """leaves (levels, tokens, n_rows) with their `budget`; a budget of None is `share` of all tokens."""
    capped = leaves.withColumn("cap", F.col("tokens") * F.lit(max_epochs))
    for level in levels:
        capped = capped.where(weight_of(level, weights.get(level, {}), default_weight) > 0)
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    have = F.lit(budget).cast("long") if budget is not None else F.floor(F.col("all_tokens") * F.lit(share)).cast("long")
    top = total.select(have.alias("got"))
    above: list[str] = []
    for depth, level in enumerate(levels):
        path = levels[: depth + 1]
        nodes = capped.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("w", weight_of(level, weights.get(level, {}), default_weight))
        if above:
            given = nodes.join(top.withColumnRenamed("got", "have"), above)
        else:  # one row of the whole corpus' tokens
            given = nodes.withColumn("have", top.scalar())
        given = given.withColumn("have", F.least("have", F.sum("cap").over(Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0)))))
        top, above = fill(given, above, level).select(*path, "got"), path
    return leaves.join(top.withColumnRenamed("got", "budget"), levels, "left").withColumn("budget", F.coalesce("budget", F.lit(0)))


def mix(docs: DataFrame, levels: list[str], weights: dict[str, dict[str, int]], budget: int | None = None, share: float = 1.0, max_epochs: int = 4, seed: int = 17, default_weight: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __tokens and __copies: how often each row is taken (whole epochs, and one more inside the last prefix)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    keyed = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in levels],
        F.col(id_col).alias("__id"), count_tokens(F.col(text_col)).alias("tokens"), digest.alias("digest"),
    )
    rows = written(keyed.withColumn("range", F.substring("digest", 1, 3)), "rows")
    sums = rows.groupBy(*levels, "range").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows"))
    leaves = sums.groupBy(*levels).agg(F.sum("tokens").alias("tokens"), F.sum("n_rows").alias("n_rows"))
    plan = written(leaf_budgets(leaves, levels, weights, budget, share, max_epochs, default_weight), "leaves").withColumn(
        "epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long")
    ).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")).drop("tokens", "n_rows")
    in_order = Window.partitionBy(*levels).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        sums.withColumn("before", F.coalesce(F.sum("tokens").over(in_order), F.lit(0))).join(plan, levels)
        .withColumn("side", F.when((F.col("rest") <= 0) | (F.col("before") > F.col("rest")), -1).when(F.col("before") + F.col("tokens") <= F.col("rest"), 1).otherwise(0))
        .select(*levels, "range", "before", "epochs", "rest", "side")
    )
    placed = rows.join(ranges, [*levels, "range"])
    inner = Window.partitionBy(*levels, "range").orderBy("digest", "__id").rowsBetween(Window.unboundedPreceding, 0)
    whole = placed.where("side <> 0").withColumn("copies", F.col("epochs") + F.when(F.col("side") == 1, 1).otherwise(0))
    cut = placed.where("side = 0").withColumn("copies", F.col("epochs") + F.when(F.col("before") + F.sum("tokens").over(inner) <= F.col("rest"), 1).otherwise(0))
    columns = [*levels, "__id", "digest", "tokens", "copies"]
    return whole.select(columns).unionByName(cut.select(columns))


def mixed_documents(docs: DataFrame, taken: DataFrame, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, each as many times as `taken` (a result of mix over the same docs) says, with all their columns.

    Rows alike in id, text and levels share a digest; what `taken` says of them is dealt to them in the order of their other columns, the greatest counts first.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))))
    levels = [c for c in taken.columns if c in docs.columns and c not in ("__id", "digest", "tokens", "copies")]
    keys = ["__digest", *[f"__level_{c}" for c in levels]]
    # Copies of a row differ by one at most inside a leaf, so the list of a digest has two entries at most: (copies, rows up to and with it).
    n = taken.withColumnsRenamed({"digest": "__digest"} | {c: f"__level_{c}" for c in levels}).groupBy(*keys, "copies").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy(F.desc("copies")).rowsBetween(Window.unboundedPreceding, 0))
    counts = n.withColumn("upto", upto).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("upto", "copies"))).alias("__counts"), F.max("copies").alias("__most"))
    counts = counts.where("__most > 0").drop("__most")
    own = docs.withColumn("__digest", digest).withColumns({f"__level_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in levels})
    plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    joined = own.join(counts, keys).withColumn("__twin", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*plain))))
    copies = F.filter("__counts", lambda x: x["upto"] >= F.col("__twin"))[0]["copies"]
    joined = joined.withColumn("__n", copies).where("__n > 0")
    return joined.withColumn("__copy", F.explode(F.expr("sequence(1, cast(__n as int))"))).select(*[F.col(f"`{c}`") for c in docs.columns])
