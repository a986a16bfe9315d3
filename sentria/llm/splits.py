"""Problem 7: splits that keep related records together.

Records are related if they share a document or a group. Only documents with several groups link
groups, so the graph that has to be searched is that of groups alone, as stars around each such
document's least group; its components come from alternating large and small stars, each round
an aggregate and a join, with reliable checkpoints between the rounds. Hot groups are one node.

``assign`` gives each component a split: it begins with hashed places and moves or exchanges whole
components by annealing, cooled down over as many steps as there are. Components that hold a
thousandth of all rows or more (so at most a thousand) are placed first, the others in parallel, in
buckets of bounded size, each aiming at the rows and labels that the large ones left. Every chain
is a task of its own, and the best one of each bucket is kept, which is never worse than the hashed
start. ``p7_found`` needs no assignment: its rows come from the components alone.

A null, blank or missing group links nothing; a document without any group is its own component;
rows without document and group are left out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentria.llm.common import table, tidy
from sentria.sources import shared_dir, written

CHAINS = 4
MOVES = 8000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(a, b); a component is named by its least node. Rounds go on
    until nothing changes; their number grows with the logarithm of the components' size."""
    shared_dir(edges.sparkSession)
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct().checkpoint()
    size = None
    while True:
        # large stars: the larger neighbours of each node go to the least of its neighbourhood
        near = both.unionByName(both.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = near.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = near.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("u <> v").distinct()
        # small stars: each node and its smaller neighbours go to the least of them
        lower = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lower, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v"), F.col("m").alias("u")))).alias("e")).select("e.*").where("u <> v").distinct()
        both = small.checkpoint()
        now = both.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == size:
            break
        size = now
    pairs = both.groupBy("v").agg(F.min("u").alias("component")).select(F.col("v").alias("node"), "component")
    roots = both.select("u").distinct().join(both.select(F.col("v").alias("u")), "u", "left_anti")
    return pairs.unionByName(roots.select(F.col("u").alias("node"), F.col("u").alias("component")))


def related(rows: DataFrame, doc: str = "doc_id", group: str = "group_id") -> tuple[DataFrame, DataFrame]:
    """(doc, component) and (group, component). Groups are compared trimmed and in lower case."""
    links = rows.select(F.col(doc).alias("d"), tidy(group).alias("g")).distinct()
    held = links.where("d is not null").groupBy("d").agg(F.min("g").alias("g0"), F.max("g").alias("g1"))
    several = held.where("g0 <> g1").select("d", "g0")
    edges = links.where("g is not null").join(several, "d").where("g <> g0").select(F.col("g0").alias("a"), F.col("g").alias("b"))
    parts = components(edges)
    groups = links.where("g is not null").select("g").distinct().join(parts.withColumnRenamed("node", "g"), "g", "left").select(F.col("g").alias("group_id"), F.concat(F.lit("g:"), F.coalesce("component", "g")).alias("component"))
    docs = held.join(groups.withColumnRenamed("group_id", "g0"), "g0", "left").select(F.col("d").alias("doc_id"), F.coalesce("component", F.concat(F.lit("d:"), F.col("d"))).alias("component"))
    return docs, groups


def deviation(have: np.ndarray, ones: np.ndarray, want: np.ndarray, want_ones: np.ndarray) -> float:
    """How far rows, and by half labels, of the splits are from what is wanted, as shares."""
    return float(np.abs(have - want).sum() / max(want.sum(), 1) + 0.5 * np.abs(ones - want_ones).sum() / max(want_ones.sum(), 1))


def anneal(sizes: np.ndarray, ones: np.ndarray, want: np.ndarray, want_ones: np.ndarray, start: np.ndarray, seed: int) -> tuple[np.ndarray, float]:
    """Splits of the components with the least deviation found: moves and exchanges of whole
    components, accepted if they help or, more and more rarely, if they don't."""
    rng = np.random.default_rng(seed)
    k, n = len(want), len(sizes)
    place = start.copy()
    have = np.bincount(place, weights=sizes, minlength=k)
    have_ones = np.bincount(place, weights=ones, minlength=k)
    now = best = deviation(have, have_ones, want, want_ones)
    best_place = place.copy()
    steps = min(MOVES, 40 * n)
    for step in range(steps):
        i, to = int(rng.integers(n)), int(rng.integers(k))
        swap = [(i, to)]
        if rng.random() < 0.5:
            j = int(rng.integers(n))
            to = int(place[j])
            swap = [(i, to), (j, int(place[i]))] if i != j else []
        swap = [(c, t) for c, t in swap if place[c] != t]
        if not swap:
            continue
        h, o = have.copy(), have_ones.copy()
        for c, t in swap:
            h[place[c]] -= sizes[c]
            o[place[c]] -= ones[c]
            h[t] += sizes[c]
            o[t] += ones[c]
        then = deviation(h, o, want, want_ones)
        heat = min(0.02, 1 / n) * (1 - step / steps) ** 2 + 1e-9
        if then <= now or rng.random() < np.exp((now - then) / heat):
            for c, t in swap:
                place[c] = t
            have, have_ones, now = h, o, then
            if now < best:
                best, best_place = now, place.copy()
    return best_place, best


def hashed(names: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Places by the components' digests, in the given shares."""
    u = (pd.util.hash_array(names.astype(object)) % np.uint64(1 << 32)).astype(float) / (1 << 32)
    return np.minimum(np.searchsorted(np.cumsum(shares), u, "right"), len(shares) - 1)


def _placed(parts: DataFrame, names: list[str], shares: np.ndarray, left: np.ndarray, left_ones: np.ndarray) -> DataFrame:
    """(component, split) of parts(bucket, component, n, ones): by bucket the best of several chains. left:
    the shares of rows and labels that the buckets aim at."""
    chains = parts.withColumn("chain", F.explode(F.array(*map(F.lit, range(CHAINS)))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("component")
        sizes, ones = pdf["n"].to_numpy(float), pdf["ones"].to_numpy(float)
        place, cost = anneal(sizes, ones, left * sizes.sum(), left_ones * ones.sum(), hashed(pdf["component"].to_numpy(), shares), int(pdf["chain"].iloc[0]))
        return pd.DataFrame({"bucket": pdf["bucket"], "chain": pdf["chain"], "component": pdf["component"], "place": place.astype("int32"), "cost": cost})

    runs = chains.groupBy("bucket", "chain").applyInPandas(run, "bucket long, chain int, component string, place int, cost double").checkpoint()
    best = runs.groupBy("bucket").agg(F.min(F.struct("cost", "chain")).alias("b")).select("bucket", F.col("b.chain").alias("chain"))
    split = F.element_at(F.array(*map(F.lit, names)), F.col("place") + 1)
    return runs.join(best, ["bucket", "chain"]).select("component", split.alias("split"))


def assign(parts: DataFrame, targets: list[tuple[str, float]]) -> DataFrame:
    """(component, split) of parts(component, n, ones)."""
    shared_dir(parts.sparkSession)
    names = [t for t, _ in targets]
    shares = np.array([max(s or 0.0, 0.0) for _, s in targets], dtype=float)
    shares = shares / shares.sum()
    total, total_ones, n_parts = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("ones"), F.lit(0)), F.count("*")).first()
    small, left, left_ones, out = parts, shares, shares, None
    if total > 1000:
        is_large = F.col("n") >= -(-total // 1000)
        large, small = parts.where(is_large), parts.where(~is_large)
        out = _placed(large.withColumn("bucket", F.lit(-1).cast("long")), names, shares, shares, shares)
        held = {r["split"]: r for r in out.join(large, "component").groupBy("split").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).collect()}
        rest = lambda c, of: np.maximum(shares * of - np.array([held[n][c] if n in held else 0 for n in names], dtype=float), 0)
        share = lambda x: x / x.sum() if x.sum() else shares
        left, left_ones = share(rest("n", total)), share(rest("ones", total_ones))
    buckets = int(n_parts) // 2000 + 1
    bucketed = small.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(buckets)))
    placed = _placed(bucketed, names, left, left, left_ones)
    return out.unionByName(placed) if out is not None else placed


def _rows(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "sentence_dataset", "doc_id", "group_id", "sentence_order", "sentence_uid", "label", "split")


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    rows = table(spark, base, "sentence_dataset", "doc_id", "group_id", "split").select("doc_id", tidy("group_id").alias("group_id"), tidy("split").alias("split")).distinct()
    docs, groups = related(rows)
    splits = rows.where("split is not null")
    by_doc = splits.where("doc_id is not null").join(docs, "doc_id").select("component", "split")
    by_group = splits.where("doc_id is null and group_id is not null").join(groups, "group_id").select("component", "split")
    mixed = by_doc.unionByName(by_group).groupBy("component").agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    return groups.join(mixed, "component", "left_semi").select("group_id").distinct()


def p7_splits(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, component, split) of each document, related ones together."""
    rows = _rows(spark, base)
    docs, _ = related(rows)
    docs = docs.checkpoint()
    counted = rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("ones"))
    parts = counted.join(docs, "doc_id").groupBy("component").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones")).checkpoint()
    targets = [(r[0], r[1]) for r in table(spark, base, "split_targets", "split", "share").where("split is not null and share > 0").orderBy(F.desc("share"), "split").collect()] or [("train", 1.0)]
    placed = assign(parts, targets).checkpoint()
    return docs.join(placed, "component").select("doc_id", "component", "split")


def p7_report(spark: SparkSession, base: str) -> DataFrame:
    """Rows, documents and label-1 rows that each split got, beside its target."""
    got = p7_splits(spark, base)
    rows = _rows(spark, base).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("ones"))
    sums = got.join(rows, "doc_id").groupBy("split").agg(F.count("*").alias("documents"), F.sum("n").alias("n_rows"), F.sum("ones").alias("n_ones"))
    targets = table(spark, base, "split_targets", "split", "share")
    return targets.join(sums, "split", "left").select("split", "share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_ones", F.lit(0)).alias("n_ones"))


def p7_checks(spark: SparkSession, base: str) -> DataFrame:
    """What holds for any good assignment: documents, rows and label-1 rows that got a split, related groups
    that were torn, and whether each split's share of rows is within a hundredth of its target or, if more, the largest set's share."""
    got = p7_splits(spark, base)
    rows = _rows(spark, base).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("ones"))
    each = written(got.join(rows, "doc_id"), "assigned")
    torn = each.groupBy("component").agg(F.countDistinct("split").alias("splits"), F.sum("n").alias("n"))
    sums = each.agg(F.count("*").alias("documents"), F.sum("n").alias("n_rows"), F.sum("ones").alias("n_ones"))
    parts = torn.agg(F.count_if(F.col("splits") > 1).alias("torn"), F.max("n").alias("largest"))
    targets = table(spark, base, "split_targets", "split", "share").where("split is not null and share > 0")
    by = targets.join(each.groupBy("split").agg(F.sum("n").alias("n")), "split", "left")
    one = sums.join(F.broadcast(parts), F.lit(True), "inner").where("documents > 0")  # aggregates of one row
    off = by.join(F.broadcast(one), F.lit(True), "inner").agg(F.max(F.abs(F.coalesce("n", F.lit(0)) / F.col("n_rows") - F.col("share")) - F.greatest(F.lit(0.01), F.col("largest") / F.col("n_rows"))).alias("off"))
    return one.join(F.broadcast(off), F.lit(True), "inner").select("documents", "n_rows", "n_ones", "torn", (F.coalesce("off", F.lit(0.0)) <= 0).alias("on_target"))
