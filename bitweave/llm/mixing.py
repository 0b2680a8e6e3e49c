"""Mix sources to target weights: budgets down a domain-language-source tree, then seeded token prefixes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import boxed, free_names, local_frame, partitions, spread_join, written

UNITS = 1_000_000  # a weight of 1 in whole units: shares are computed in whole numbers, so they are exact


@dataclass(frozen=True)
class Targets:
    """Weights of the tree's nodes by their path, e.g. ("web",) or ("web", "en"); a node without one has `default`.

    budget_share: tokens to draw as a share of the tokens there are. max_epochs: how often a leaf may be repeated.
    """

    weights: dict[tuple[str, ...], float] = field(default_factory=dict)
    default: float = 1.0
    budget_share: float = 0.5
    max_epochs: int = 4
    seed: int = 17


def units(weight: float) -> int:
    """A weight in millionths; a negative one counts as 0."""
    return max(0, round(weight * UNITS))


def _whole(column):
    return F.col(column).cast("decimal(20,0)")


RANGE = 100_000  # rows that one task sums


def running(rows: DataFrame, group: list[str], order: list, sums: dict[str, str], name: str, n: int) -> DataFrame:
    """rows, n at most, with running sums in the given order within each group; sums: result -> column.

    Beyond RANGE rows they are dealt by range of (group, order) and each range is summed for itself, so that a group of
    any size is spread over tasks; what comes before a range is the sum of the ranges' totals.
    """
    if n <= RANGE:
        upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({s: F.sum(c).over(upto) for s, c in sums.items()})
    spread = rows.repartitionByRange(min(-(-n // RANGE), 100 * partitions(rows.sparkSession)), *group, *order).withColumn("_range", F.spark_partition_id())
    spread = written(spread, name)
    totals = spread.groupBy(*group, "_range").agg(*[F.sum(c).alias(f"_t_{s}") for s, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*group, "_range", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_b_{s}") for s in sums])
    here = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = spread.withColumns({s: F.sum(c).over(here) for s, c in sums.items()}).join(totals, [*group, "_range"])
    return rows.withColumns({s: F.col(s) + F.col(f"_b_{s}") for s in sums}).drop("_range", *[f"_b_{s}" for s in sums])


def totals(rows: DataFrame, group: list[str], sums: dict[str, str], n: int) -> DataFrame:
    """rows, n at most, with the sums of their whole groups; sums: result -> column."""
    if n <= RANGE:
        return rows.withColumns({s: F.sum(c).over(Window.partitionBy(*group)) for s, c in sums.items()})
    return rows.join(rows.groupBy(*group).agg(*[F.sum(c).alias(s) for s, c in sums.items()]), group)


def share_out(parents: DataFrame, children: DataFrame, keys: list[str], name: str, n: int) -> DataFrame:
    """Split each parent's budget by weight among its children; what a full child cannot take goes to the others by
    weight. Whole tokens left by rounding go to the largest remainders, then to the first names.

    keys name a child, all but the last its parent. parents holds _budget, children, n at most, _weight (whole units)
    and _capacity. Gives keys and _budget of the children that get any.
    """
    up, child = keys[:-1], keys[-1]
    rows = children.where("_weight > 0 AND _capacity > 0").join(parents.where("_budget > 0"), up)
    rows = totals(rows, up, {"_room": "_capacity", "_weights": "_weight"}, n).withColumn("_budget", F.least("_budget", "_room"))
    # by capacity for a unit of weight: the smallest are full first, and the others share what those leave
    rows = running(rows, up, [F.col("_capacity") / F.col("_weight"), F.col(child)], {"_caps": "_capacity", "_upto": "_weight"}, f"{name}_order", n)
    left, live = (F.expr(f"CAST({x} AS DECIMAL(20,0))") for x in ("_budget - _caps + _capacity", "_weights - _upto + _weight"))
    rows = rows.withColumn("_full", left * _whole("_weight") >= _whole("_capacity") * live)
    rows = rows.withColumns({"_taken": F.when(F.col("_full"), F.col("_capacity")).otherwise(0), "_open": F.when(F.col("_full"), 0).otherwise(F.col("_weight"))})
    rows = totals(rows, up, {"_all": "_taken", "_live": "_open"}, n).withColumn("_left", F.col("_budget") - F.col("_all"))
    product = "CAST(_left AS DECIMAL(20,0)) * CAST(_weight AS DECIMAL(20,0))"
    rows = rows.withColumn("_part", F.expr(f"if(_full, 0L, ({product}) DIV CAST(_live AS DECIMAL(20,0)))"))
    rows = rows.withColumn("_over", F.expr(f"if(_full, NULL, {product} - CAST(_part AS DECIMAL(20,0)) * CAST(_live AS DECIMAL(20,0)))"))
    rows = totals(rows.withColumn("_one", F.lit(1)), up, {"_parts": "_part"}, n)
    rows = running(rows, up, [F.col("_full"), F.col("_over").desc(), F.col(child)], {"_place": "_one"}, f"{name}_rest", n)
    more = F.least(F.col("_part") + (F.col("_place") <= F.col("_left") - F.col("_parts")).cast("long"), F.col("_capacity"))
    return rows.select(*keys, F.when(F.col("_full"), F.col("_capacity")).otherwise(more).alias("_budget")).where("_budget > 0")


def leaf_budgets(leaves: DataFrame, keys: list[str], targets: Targets) -> DataFrame:
    """Whole-token budgets of the leaves that draw: keys and _budget. leaves holds keys and tokens.

    The budget goes down the tree level by level. A node never gets more than its leaves hold over max_epochs, so a
    leaf's shortage is made up by its siblings first, and by its parent's siblings only when the parent is full.
    """
    spark, n = leaves.sparkSession, leaves.count()
    root = (F.length(keys[0]) < 0).cast("int")  # 0 in every row, and a key like the others
    leaves = leaves.where("tokens > 0").withColumn("_root", root)
    out = leaves.groupBy("_root").agg(F.floor(F.lit(float(targets.budget_share)) * F.sum("tokens")).alias("_budget"))
    for depth in range(1, len(keys) + 1):
        path = keys[:depth]
        given = [(*k, units(w)) for k, w in targets.weights.items() if len(k) == depth]
        weights = local_frame(spark, given, ", ".join(f"{k} string" for k in path) + ", _weight long")
        children = leaves.groupBy("_root", *path).agg((F.sum("tokens") * targets.max_epochs).alias("_capacity")).join(weights, path, "left")
        children = children.withColumn("_weight", F.coalesce("_weight", F.lit(units(targets.default)).cast("long")))
        out = written(share_out(out, children, ["_root", *path], f"level{depth}", n), f"budgets{depth}")
    return out.drop("_root")


def count_tokens(text):
    """Tokens here are words: runs without ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(seed: int, epoch, doc_id, text):
    """Where a document stands in the seeded order of an epoch; without a doc_id its text decides."""
    return F.xxhash64(F.lit(seed), epoch.cast("int"), doc_id, F.when(doc_id.isNull(), text))


def mix(docs: DataFrame, domain, targets: Targets, per_bucket: int = 1000) -> DataFrame:
    """Draw documents so that leaf tokens meet the hierarchical budgets.

    domain is a Column over docs; language and source are docs' lang and source. A leaf takes whole epochs first and
    then, in the seeded order of the next epoch, the longest prefix of documents that fits the rest of its budget (rows
    of one doc_id stand together; the document that would pass the budget and all after it are left out). Returns docs'
    own columns with _domain, _tokens and _epoch appended, one row per document and epoch drawn.

    Prefixes come from token sums per hash range of a leaf, so no task holds a leaf: only the range at the edge is
    ordered, after rows that stand together have been summed. The tree is planned in DataFrames, whatever its size.
    Null domain, lang or source counts as 'none'; null and empty texts have no tokens and a leaf without tokens draws
    nothing; rows without doc_id stand by their texts; repeated rows count and are drawn as often as they occur; an empty
    table or budget gives an empty result. docs' columns may have any names: an appended column whose name is taken gets
    as many more leading underscores as it needs.
    """
    keys = ["_domain", "_language", "_source"]
    label = [F.coalesce(c.cast("string"), F.lit("none")) for c in (domain, F.col("lang"), F.col("source"))]
    doc_id = F.col("doc_id").cast("long")
    who = F.when(doc_id.isNull(), F.xxhash64("text"))  # stands for the text of a row without doc_id
    rows = boxed(docs, **dict(zip(keys, label)), _tokens=count_tokens(F.col("text")), _id=doc_id, _who=who)
    narrow = written(rows.drop("doc"), "tokens")
    sizes = written(narrow.groupBy(*keys).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")), "leaves")
    leaves, largest, total = sizes.agg(F.count(F.lit(1)), F.max("n"), F.sum("n")).first()
    counts, by = sizes.select(*keys, "n"), ["_id", "_who"]
    plan = leaf_budgets(sizes, keys, targets).join(sizes, keys)
    plan = written(plan.select(*keys, F.expr("_budget DIV tokens").alias("_whole"), (F.col("_budget") % F.col("tokens")).alias("_rest")), "plan")
    buckets = 1 << max(0, ((largest or 1) // per_bucket).bit_length())
    place = draw(targets.seed, F.col("_whole"), F.col("_id"), F.col("_who"))
    part = spread_join(narrow, plan.where("_rest > 0"), keys, by, "inner", total or 0, counts, leaves).withColumn("_draw", place).groupBy(*keys, "_draw", "_rest").agg(F.sum("_tokens").alias("_tokens"))
    part = part.withColumn("_bucket", F.shiftright(F.col("_draw"), 64 - buckets.bit_length() + 1) if buckets > 1 else F.lit(0).cast("long"))
    part = written(part, "places")
    sums = part.groupBy(*keys, "_bucket", "_rest").agg(F.sum("_tokens").alias("_sum"))
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0)))
    edge = sums.where((F.col("_before") <= F.col("_rest")) & (F.col("_before") + F.col("_sum") > F.col("_rest"))).select(*keys, "_bucket", "_before")
    within = Window.partitionBy(*keys, "_bucket").orderBy("_draw").rowsBetween(Window.unboundedPreceding, 0)
    edge = part.join(edge, [*keys, "_bucket"]).withColumn("_upto", F.col("_before") + F.sum("_tokens").over(within))
    # each leaf with an edge has a first document that does not fit; every earlier one is drawn
    cuts = edge.where(F.col("_upto") > F.col("_rest")).groupBy(*keys).agg(F.min("_draw").alias("_cut"))
    final = written(plan.join(cuts, keys, "left"), "cuts")
    more = (F.col("_rest") > 0) & (place < F.col("_cut"))
    times = F.col("_whole") + F.coalesce(more, F.lit(False)).cast("long")
    out = spread_join(rows, final, keys, by, "inner", total or 0, counts, leaves).withColumn("_times", times).where("_times > 0")
    out = out.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    names = dict(zip(["_domain", "_tokens", "_epoch"], free_names(docs.columns, ["_domain", "_tokens", "_epoch"])))
    return out.select("doc.*", *[F.col(c).alias(n) for c, n in names.items()])
