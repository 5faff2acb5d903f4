"""Mixing sources to target weights by hierarchical budgeting.

Weights go down a tree of groups (domain, source, language or the like). A node that cannot use its share passes the
rest to its siblings in proportion to their weights; only what all of them cannot use goes to the siblings of their
parent. Each leaf then takes the prefix of its seeded epochs that fills its budget: whole epochs first, then the
documents of the next one in the order of a seeded hash.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.tokenize import BYTE_BPE_50K, count_tokens
from corpusloom.session import cut

#: Leaves the driver holds; a tree with more is refused, not cut.
MOST_LEAVES = 100_000
#: Slices of a leaf's hash order; the running sum over a leaf is over these, never over its documents.
SLICES = 4096


@dataclass
class Node:
    """A group. ``weight`` is relative to its siblings; ``capacity`` is that of its leaves."""

    name: str | None = None
    weight: float = 1.0
    capacity: float = 0.0
    budget: float = 0.0
    children: dict[str | None, Node] = field(default_factory=dict)


def share_out(amount: float, nodes: list[Node]) -> None:
    """Gives ``amount`` to siblings by weight; what one has no capacity for goes to the others, until none can take more."""
    for n in nodes:
        n.budget = 0.0
    open_ = [n for n in nodes if n.capacity > 0 and n.weight > 0]
    while open_ and amount > 1e-9:
        total = sum(n.weight for n in open_)
        full = [n for n in open_ if n.capacity <= amount * n.weight / total]
        if not full:
            for n in open_:
                n.budget = amount * n.weight / total
            break
        for n in full:
            n.budget = n.capacity
        amount -= sum(n.capacity for n in full)
        open_ = [n for n in open_ if n not in full]
    for n in nodes:
        if n.children:
            share_out(n.budget, list(n.children.values()))


def feasible_total(root: Node, at: int = 0) -> float:
    """The largest total at which every group of the level ``at``, that of the targets, that has anything gets its weight's
    share of the whole."""
    nodes = [root]
    for _ in range(at + 1):
        nodes = [c for n in nodes for c in n.children.values()]
    live = [n for n in nodes if n.capacity > 0 and n.weight > 0]
    weights = sum(n.weight for n in live)
    return min((n.capacity * weights / n.weight for n in live), default=0.0)


def build_tree(leaves: list[tuple], targets: dict, at: int = 0) -> Node:
    """``leaves``: (path, tokens, repeats). The part ``at`` of a path has its weight in ``targets``; above it, weights are
    the sums of those below, and under it the tokens at hand. Targets without leaves hang below the root and take nothing."""
    root = Node()
    for path, tokens, repeats in leaves:
        node = root
        node.capacity += tokens * repeats
        for depth, part in enumerate(path):
            if part not in node.children:
                node.children[part] = Node(part, targets.get(part, 0.0) if depth == at else 0.0)
                if depth == at:
                    above = root
                    for p in path[:at]:
                        above = above.children[p]
                        above.weight += targets.get(part, 0.0)
            node = node.children[part]
            node.capacity += tokens * repeats
            if depth > at:
                node.weight += tokens
    if at == 0:
        for name, weight in targets.items():
            root.children.setdefault(name, Node(name, weight))
    return root


def plan_mix(sizes: DataFrame, targets: DataFrame, levels: list[str], total: float | None = None, of: str | None = None) -> DataFrame:
    """One row per leaf: the levels, n_tokens, max_repeats and budget (in tokens).

    ``sizes``: the levels and n_tokens per document. ``targets``: target_share and max_repeats of each group of the level
    ``of``, the first one if unnamed; without a number of repeats a document is used once. Only sums per leaf reach the driver.
    """
    of = of or levels[0]
    rows = targets.select(of, "target_share", "max_repeats").limit(MOST_LEAVES + 1).collect()
    goals = {r[of]: (float(r["target_share"]), 1 if r["max_repeats"] is None else int(r["max_repeats"])) for r in rows if r[of] is not None and r["target_share"]}
    held = F.broadcast(targets.select(of).distinct()) if len(goals) <= MOST_LEAVES else targets.select(of).distinct()
    rows = sizes.join(held, of, "left_semi").groupBy(*levels).agg(F.sum("n_tokens").alias("n_tokens")).limit(MOST_LEAVES + 1).collect()
    if len(rows) > MOST_LEAVES or len(goals) > MOST_LEAVES:
        raise ValueError(f"more than {MOST_LEAVES} leaves; use coarser levels")
    leaves = [(tuple(r[c] for c in levels), float(r["n_tokens"] or 0), goals[r[of]][1]) for r in rows if r[of] in goals]
    root = build_tree(leaves, {k: w for k, (w, _) in goals.items()}, levels.index(of))
    share_out(min(root.capacity, feasible_total(root, levels.index(of)) if total is None else total), list(root.children.values()))
    out = []
    for path, tokens, repeats in leaves:
        node = root
        for part in path:
            node = node.children[part]
        out.append((*path, int(tokens), repeats, float(node.budget)))
    schema = ", ".join(f"`{c}` {sizes.schema[c].dataType.simpleString()}" for c in levels) + ", n_tokens bigint, max_repeats int, budget double"
    return sizes.sparkSession.createDataFrame(out, schema)


def take_prefix(sizes: DataFrame, plan: DataFrame, levels: list[str], id_col: str, seed: int) -> DataFrame:
    """(id, levels, n_tokens, times): how often each document is used. Documents without tokens are not used."""
    plan = plan.withColumn("__full", F.when(F.col("n_tokens") > 0, F.floor(F.col("budget") / F.col("n_tokens") + F.lit(1e-9))).otherwise(0).cast("int"))
    plan = plan.withColumn("__rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("__full") * F.col("n_tokens")))
    plan = plan.select(*[F.col(c).alias(f"__p_{c}") for c in levels], "__full", "__rest", F.col("max_repeats").alias("__most"))
    on = [F.col(c).eqNullSafe(F.col(f"__p_{c}")) for c in levels]
    docs = sizes.filter(F.col("n_tokens") > 0).join(F.broadcast(plan), on).drop(*[f"__p_{c}" for c in levels])
    order = F.xxhash64(F.col(id_col), F.lit(seed), F.col("__full"))
    docs = docs.withColumn("__h", order).withColumn("__slice", F.pmod(F.shiftright(F.col("__h"), 52), F.lit(SLICES)).cast("int"))
    per_leaf = Window.partitionBy(*levels).orderBy("__slice")
    slices = docs.groupBy(*levels, "__slice", "__rest").agg(F.sum("n_tokens").alias("__sum"))
    slices = slices.withColumn("__before", F.sum("__sum").over(per_leaf) - F.col("__sum"))
    slices = slices.select(*[F.col(c).alias(f"__s_{c}") for c in levels], F.col("__slice").alias("__s"), "__before")
    on = [F.col(c).eqNullSafe(F.col(f"__s_{c}")) for c in levels]
    docs = docs.join(slices, [*on, F.col("__slice") == F.col("__s")])
    in_slice = Window.partitionBy(*levels, "__slice").orderBy("__h", id_col)
    before = F.col("__before") + F.sum("n_tokens").over(in_slice) - F.col("n_tokens")
    extra = (before + F.col("n_tokens") / 2 <= F.col("__rest")) & (F.col("__full") < F.col("__most"))
    return docs.withColumn("times", F.col("__full") + extra.cast("int")).filter("times > 0").select(id_col, *levels, "n_tokens", "times")


def mix_sources(
    df: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    levels: tuple[str, ...] = ("source",),
    total: float | None = None,
    seed: int = 42,
    vocabulary: str = BYTE_BPE_50K,
    of: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(documents, report) of the mix.

    ``documents``: id, levels, n_tokens, times. ``report``: for each row of ``targets`` the first level, target_share,
    max_repeats, n_documents, available_tokens, budget_tokens, taken_tokens, actual_share. ``total`` is the size of the
    mix in tokens; without it, the largest at which no source that has documents falls short. With it, what a source
    cannot fill goes to the sources beside it in its domain first, and only then to other domains. ``of`` names the level
    that has the targets, the first one by default; levels above it are domains, those below it parts. A target without a
    number of repeats is used once. Sources that are not targets are not encoded; they, null sources and texts without tokens take no part; a target without documents gets 0 and its share goes
    to the others. A document delivered twice counts once. Empty tables give empty results.
    """
    levels, top = list(levels), of or levels[0]
    sizes = count_tokens(df.join(targets.select(top).distinct(), top, "left_semi"), [id_col, *levels], text_col, vocabulary).dropDuplicates([id_col])
    sizes = cut(sizes)
    plan = plan_mix(sizes, targets, levels, total, top)
    docs = take_prefix(sizes, plan, levels, id_col, seed)
    at_hand = sizes.groupBy(top).agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("available_tokens"))
    wanted = plan.groupBy(top).agg(F.sum("budget").alias("budget_tokens"))
    taken = docs.groupBy(top).agg(F.sum(F.col("n_tokens") * F.col("times")).alias("taken_tokens"))
    report = targets.select(top, "target_share", "max_repeats").dropDuplicates([top]).join(at_hand, top, "left").join(wanted, top, "left").join(taken, top, "left")
    for c in ("n_documents", "available_tokens", "budget_tokens", "taken_tokens"):
        report = report.withColumn(c, F.coalesce(F.col(c), F.lit(0)))
    whole = F.sum("taken_tokens").over(Window.partitionBy())
    report = report.withColumn("actual_share", F.when(whole > 0, F.col("taken_tokens") / whole).otherwise(0.0))
    return docs, report
