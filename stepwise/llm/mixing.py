"""Mixing sources to target weights through a domain-language-source tree."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import packed_rows, small, stage, text_or_empty, unpacked

LEVELS = ("domain", "lang", "source")
#: Default integer weights of the children of every node of a level; names that are not listed weigh 1.
WEIGHTS: dict[str, dict[str, int]] = {
    "domain": {"web": 6, "books": 3, "code": 2, "forums": 1},
    "lang": {"en": 6, "de": 2, "fr": 2, "es": 2},
    "source": {},
}
#: Rows of a leaf that one slot of its running sum holds, about; a leaf of more
#: than its square has slots of the square root of its rows.
SLOT_ROWS = 512
#: Leaves of a tree whose plan is broadcast, at most; a larger one is joined by a shuffle.
BROADCAST_LEAVES = 50_000


def domain_of(source: Column) -> Column:
    """The default domain of a source: its trailing number modulo 4 (none: web)."""
    number = F.try_to_number(F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1), F.lit("999999999"))
    return F.element_at(F.array(*map(F.lit, ("web", "books", "code", "forums"))), (F.coalesce(number, F.lit(0)).cast("int") % 4) + 1)


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    out = F.lit(1).cast("long")
    for name, value in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(value).cast("long")).otherwise(out)
    return out


def _fill(nodes: DataFrame, parents: list[str], name: str, weight: Column) -> DataFrame:
    """Divide ``budget`` of each parent over its children by weight, none above its ``capacity``.

    Water-filling: children in order of capacity over weight are filled while
    their capacity is under their share of what is left; the others share the
    rest.  So a child's shortage goes to its siblings, and capacity that is the
    sum of a subtree's leaves keeps it there before it reaches an ancestor.
    """
    order = Window.partitionBy(*parents).orderBy((F.col("capacity") / F.col("w")).asc(), F.col(name).asc())
    before, here = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parents)
    out = nodes.withColumn("w", weight)
    out = out.withColumns({"left_budget": F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)), "left_w": F.sum("w").over(here) - F.coalesce(F.sum("w").over(before), F.lit(0))})
    # Once a child isn't filled, no later one is.
    out = out.withColumn("filled", F.col("capacity") * F.col("left_w") <= F.col("left_budget") * F.col("w"))
    rest = F.first(F.when(~F.col("filled"), F.struct("left_budget", "left_w")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out = out.withColumn("rest", rest)
    share = F.expr("rest.left_budget * w div rest.left_w")
    return out.withColumn("budget", F.when(F.col("filled"), F.col("capacity")).otherwise(share).cast("long")).drop("w", "left_budget", "left_w", "filled", "rest")


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], per_mille: int, epochs: int) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens, docs) with budget, from the root down.

    The tables are as small as the tree: one row for each node.
    """
    leaves = leaves.withColumn("capacity", F.col("tokens") * epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    domains = leaves.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    total = leaves.agg(F.expr(f"sum(tokens) * {int(per_mille)} div 1000").cast("long").alias("budget"))
    domains = domains.join(F.broadcast(total)).withColumn("root", F.lit(0))
    domains = _fill(domains, ["root"], "domain", _weight("domain", weights)).select("domain", "budget")
    langs = _fill(langs.join(domains, "domain"), ["domain"], "lang", _weight("lang", weights)).select("domain", "lang", "budget")
    return _fill(leaves.join(langs, ["domain", "lang"]), ["domain", "lang"], "source", _weight("source", weights))


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """A row's place in its leaf's order of an epoch: 52 bits of an md5."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long")


def _measures() -> dict[str, Column]:
    """What a row is drawn by: its leaf, its tokens and a hash of its text."""
    text = text_or_empty()
    return {
        "doc_id": F.col("doc_id"),
        "check": F.xxhash64(text),
        "domain": domain_of(F.col("source")),
        "lang": F.coalesce("lang", F.lit("")),
        "source": F.coalesce("source", F.lit("")),
        "n_tokens": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"),
    }


def cuts(rows: DataFrame, weights: Mapping[str, Mapping[str, int]], seed: int, per_mille: int, epochs: int) -> DataFrame:
    """A row for each leaf of ``rows`` (staged): how many whole epochs are drawn, and where the last one ends.

    ``whole`` epochs come whole.  Of the next one come the rows whose (key,
    doc_id, check) is less than ``cut``, and ``equals`` of those that have it;
    all rows, where ``cut`` is null.

    Running sums are two-level: a leaf's key range is cut into slots, slots are
    summed before they are shuffled, and only the slot in which the budget ends
    is summed row by row, rows that are equal as one.
    """
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    plan = leaf_budgets(leaves, weights, per_mille, epochs)
    whole = F.when(F.col("tokens") > 0, F.least(F.expr("budget div tokens"), F.lit(epochs))).otherwise(0)
    plan = plan.withColumn("whole", whole.cast("int")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = stage(plan.select(*LEVELS, "docs", "whole", "rest"), "plan")

    rows = rows.join(plan, list(LEVELS))
    rows = rows.withColumn("key", order_key(seed, F.col("whole"), F.col("doc_id")))
    slots = F.ceil(F.col("docs") / F.greatest(F.lit(float(SLOT_ROWS)), F.sqrt("docs")))
    rows = rows.withColumn("slot", F.floor(F.col("key") / float(1 << 52) * slots).cast("long"))
    sums = rows.groupBy(*LEVELS, "slot", "rest").agg(F.sum("n_tokens").alias("slot_tokens"))
    end = F.sum("slot_tokens").over(Window.partitionBy(*LEVELS).orderBy("slot"))
    edges = sums.withColumn("before", end - F.col("slot_tokens")).where("before <= rest and before + slot_tokens > rest")
    edges = stage(edges.select(*LEVELS, "slot", "before"), "edges")
    order = ("key", "doc_id", "check")
    inside = rows.join(edges, [*LEVELS, "slot"]).groupBy(*LEVELS, *order, "n_tokens", "rest", "before").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum(F.col("n") * F.col("n_tokens")).over(Window.partitionBy(*LEVELS).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    inside = inside.withColumn("left", F.col("rest") - F.col("before") - upto + F.col("n") * F.col("n_tokens")).where("left >= 0 and left < n * n_tokens")
    cut = inside.select(*LEVELS, F.struct(*order).alias("cut"), F.expr("left div n_tokens").alias("equals"))
    return stage(plan.select(*LEVELS, "whole").join(cut, list(LEVELS), "left"), "cuts")


def drawn(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``rows`` (with ``_measures``) once for each time that ``plan`` (of ``cuts``) draws them, with ``epoch``.

    Each row is decided where it stands: nothing of it is shuffled but rows that
    equal a leaf's cut, where only some may come.  Those are counted by the
    task that reads them, and each count takes its turns.
    """
    rows = rows.join(small(plan, BROADCAST_LEAVES), list(LEVELS))
    at = F.struct(order_key(seed, F.col("whole"), F.col("doc_id")).alias("key"), "doc_id", "check")
    place = F.when(F.col("cut").isNull() | (at < F.col("cut")), 1).when((at == F.col("cut")) & (F.col("equals") > 0), 0).otherwise(-1)
    rows = rows.withColumn("place", place)
    if not plan.where("equals > 0").isEmpty():
        some = stage(rows.where("place = 0").withColumn("part", F.spark_partition_id()), "equals")
        counts = some.groupBy(*LEVELS, "part").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("part")) - F.col("n")
        some = some.join(counts.select(*LEVELS, "part", before.alias("before")), [*LEVELS, "part"])
        turn = F.row_number().over(Window.partitionBy(*LEVELS, "part").orderBy("check"))
        some = some.withColumn("place", F.when(F.col("before") + turn <= F.col("equals"), 1).otherwise(-1)).drop("part", "before")
        rows = rows.where("place <> 0").unionByName(some)
    times = F.filter(F.sequence(F.lit(0), F.col("whole")), lambda e: (e < F.col("whole")) | (F.col("place") == 1))
    return rows.withColumn("epoch", F.explode(times)).drop("place", "cut", "equals", "whole")


def mixture(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, seed: int = 42, per_mille: int = 800, epochs: int = 2) -> DataFrame:
    """One row for each row of ``docs`` that is drawn and each time it is: doc_id, check, domain, lang, source, epoch, n_tokens.

    The budget is ``per_mille`` of all tokens (words between white space); what
    a node's budget leaves after rounding its children's down is not dealt.  A
    leaf that is given more than it has goes through whole epochs, then takes
    the longest prefix that its budget allows of a last one, whose order the
    seed and the epoch fix.  A leaf that holds a third of all rows takes no
    longer than others.

    Null lang or source is a leaf of its own, named with the empty string; a
    null or empty text has no tokens and comes with any prefix that reaches it;
    a very long one comes whole or not at all.  Rows that repeat a doc_id stand
    beside one another in the order, by a hash of their text; of equal rows at
    a cut just as many come as the budget allows.  An empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    rows = stage(docs.select(*[c.alias(k) for k, c in _measures().items()]), "measured")
    out = drawn(rows, cuts(rows, weights, seed, per_mille, epochs), seed)
    return out.select("doc_id", "check", *LEVELS, "epoch", "n_tokens")


def mixed(docs: DataFrame, weights: Mapping[str, Mapping[str, int]] = WEIGHTS, seed: int = 42, per_mille: int = 800, epochs: int = 2) -> DataFrame:
    """``docs`` as often as ``mixture`` draws each row, all columns unchanged, whatever their names.

    Odd rows fare as in ``mixture``.  Whole rows are not shuffled, but for those
    that equal a leaf's cut.
    """
    rows = packed_rows(docs, **_measures())
    measured = stage(rows.drop("r"), "measured")
    return unpacked(drawn(rows, cuts(measured, weights, seed, per_mille, epochs), seed))
