"""Mixing sources to target weights (problem 7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimp.llm.tokenizer import DEFAULT_RANKS, token_counts
from palimp.plans.durable import durable
from palimp.plans.ranking import running_total

#: Multiples of an odd integer near 2**31 / golden ratio, modulo 2**31, fill the circle evenly.
TURN, CIRCLE = 1_327_217_885, 1 << 31
#: The schedule has at least SLOTS slots, and blocks of at most BLOCK_TOKENS tokens beyond that.
SLOTS, BLOCK_TOKENS = 1 << 16, 1 << 20
#: A shuffled slice of a source holds about this many documents.
SLICE_ROWS = 4096
#: Slices are summed by runs of this many before the runs are ordered, a source in one task.
SPAN = 1 << 12


def _golden(slot: Column) -> Column:
    return F.pmod(slot * F.lit(TURN), F.lit(CIRCLE)) / F.lit(float(CIRCLE))


def plan_mixture(available: dict[str, int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict:
    """Driver-side arithmetic over the sources (a handful): tokens, weight share, capacity, total.

    Without ``total``, the mixture is the largest in which every source with tokens has its exact
    weight within its repeats. Sources with no tokens or weight stay out and the weights of the rest
    are rescaled. With a larger ``total`` a source gives what its repeats allow, and what it cannot
    give is shared among the others by weight as far as theirs allow."""
    live = {s: (w, r) for s, (w, r) in targets.items() if available.get(s, 0) > 0 and w > 0 and r > 0}
    weight = sum(w for w, _ in live.values())
    room = {s: available[s] * r for s, (_, r) in live.items()}
    share = {s: w / weight for s, (w, _) in live.items()}
    exact = min((room[s] / share[s] for s in live), default=0.0)
    goal = {s: share[s] * exact for s in live}
    if total is not None:
        open_, left, goal = set(live), float(total), {s: 0.0 for s in live}
        while open_ and left > 0.5:
            w = sum(share[s] for s in open_)
            full = {s for s in open_ if room[s] <= goal[s] + left * share[s] / w}
            if not full:
                goal |= {s: goal[s] + left * share[s] / w for s in open_}
                break
            for s in full:
                left -= room[s] - goal[s]
                goal[s] = float(room[s])
            open_ -= full
    return {s: {"weight": share[s], "max_repeats": live[s][1], "available": available[s], "goal": int(goal[s] + 1e-6)} for s in sorted(live) if goal[s] >= 1}


def mix_sources(documents: DataFrame, targets: DataFrame, total: int | None = None, ranks: str = DEFAULT_RANKS, seed: int = 17) -> DataFrame:
    """``(slot, source, repeat_no, doc_id, n_tokens)``: the mixture in its order (``slot``, then
    ``repeat_no``, ``doc_id``); a document appears once per use.

    ``targets`` has ``source``, ``weight``, ``max_repeats``: one row per source (of repeated rows the
    largest weight and smallest cap hold; a null or non-positive weight leaves the source out, a null
    cap is 1, a cap below 1 leaves the source out). Documents with a null source, a source not listed, or no tokens stay out. ``doc_id``
    names a document; repeated rows are repeated uses of their own. Empty inputs give no rows.

    Each source's documents are shuffled by hash into blocks of equal tokens that follow each other
    through its repeats. Slot i of the schedule goes to the source under whose cumulative weight the
    i-th golden-ratio point falls, and takes that source's next block. Every source is spread over
    hashed slices, so one with most of the rows is not one task."""
    spark = documents.sparkSession
    wanted = targets.groupBy("source").agg(F.max("weight").alias("weight"), F.min("max_repeats").alias("max_repeats")).filter("source is not null and weight > 0")
    listed = {r["source"]: (float(r["weight"]), 1 if r["max_repeats"] is None else int(r["max_repeats"])) for r in wanted.collect()}  # one row per source
    sized = durable(token_counts(documents.filter(F.col("source").isin(list(listed))), ["doc_id", "source"], ranks=ranks).filter("n_tokens > 0"))
    totals = {r["source"]: (int(r["t"]), int(r["n"])) for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_mixture({s: t for s, (t, _) in totals.items()}, listed, total)
    goal = sum(p["goal"] for p in plan.values())
    if not goal:
        return spark.createDataFrame([], "slot bigint, source string, repeat_no int, doc_id bigint, n_tokens bigint")
    slots = min(CIRCLE - 1, max(min(SLOTS, goal), goal // BLOCK_TOKENS))
    block = goal / slots

    edges, at = [], 0.0
    for p in plan.values():
        at += p["goal"] / goal
        edges.append(at)
    per = spark.createDataFrame([(s, p["available"], p["goal"], p["max_repeats"], max(1, totals[s][1] // SLICE_ROWS)) for s, p in plan.items()], "source string, _all bigint, _goal bigint, max_repeats bigint, _slices bigint")
    point = _golden(F.col("slot"))
    pick = F.lit(list(plan)[-1])
    for s, edge in reversed(list(zip(plan, edges))[:-1]):
        pick = F.when(point < edge, s).otherwise(pick)
    schedule = running_total(spark.range(slots).select(F.col("id").alias("slot"), pick.alias("source"), F.lit(1).cast("bigint").alias("_one")), ["source"], F.expr(f"slot div {1 << 14}"), [F.col("slot")], F.col("_one"), "_rank", SPAN).select("slot", "source", "_rank")

    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    docs = sized.join(F.broadcast(per), "source").withColumn("_key", key)
    placed = running_total(docs, ["source"], F.pmod(F.col("_key"), F.col("_slices")), [F.col("_key"), F.col("doc_id"), F.col("n_tokens")], F.col("n_tokens"), "_at", SPAN)
    # the k-th use of a document lies k times the source's tokens further on; uses end within the goal
    placed = durable(placed)
    filled = placed.withColumn("_k", F.expr("least(max_repeats - 1, (_goal - _at - n_tokens) div _all)")).filter("_goal - _at - n_tokens >= 0")
    # and one more use, the one that comes nearest to what is then missing, if it comes nearer than none
    held = {r["source"]: r for r in filled.groupBy("source").agg(F.sum(F.col("n_tokens") * (F.col("_k") + 1)).alias("t")).collect()}
    short = spark.createDataFrame([(s, p["goal"] - (held[s]["t"] if s in held else 0)) for s, p in plan.items()], "source string, _gap bigint")
    free = placed.withColumn("_k", F.greatest(F.lit(0), F.expr("(_goal - _at - n_tokens) div _all + 1 - if(_goal - _at - n_tokens < 0, 1, 0)"))).filter("_k < max_repeats")
    nearest = free.join(F.broadcast(short), "source").filter("abs(_gap - n_tokens) < _gap").groupBy("source").agg(F.min_by(F.struct("doc_id", "n_tokens", "_at", "_all", F.col("_k").alias("repeat_no")), F.struct(F.abs(F.col("_gap") - F.col("n_tokens")), "doc_id", "_at")).alias("_u")).select("source", "_u.*")
    uses = filled.withColumn("repeat_no", F.explode(F.expr("sequence(0L, _k)"))).select("source", "doc_id", "n_tokens", "_at", "_all", "repeat_no")
    used = uses.unionByName(nearest).withColumn("_rank", F.floor((F.col("_at") + F.col("repeat_no") * F.col("_all")) / F.lit(block)))
    # the points of a source may be a few short of its blocks; its last blocks then follow the end
    return used.join(schedule, ["source", "_rank"], "left").select(F.coalesce("slot", F.lit(slots) + F.col("_rank")).cast("bigint").alias("slot"), "source", F.col("repeat_no").cast("int").alias("repeat_no"), "doc_id", "n_tokens")


def mixture_shares(mixture: DataFrame, documents_sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The report: for every listed source its weight and cap, and the tokens, documents, uses, most
    repeats and share it has in ``mixture``; zeros where it has none."""
    reached = mixture.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("uses"), F.max("repeat_no").alias("_last"))
    whole = mixture.agg(F.sum("n_tokens").alias("t")).scalar()
    asked = targets.filter("source is not null").groupBy("source").agg(F.max("weight").alias("weight"), F.min("max_repeats").alias("max_repeats"))
    held = documents_sources.filter("source is not null").groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    return asked.join(reached, "source", "left").join(held, "source", "left").select(
        "source", "weight", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("uses", F.lit(0)).alias("uses"),
        (F.coalesce("_last", F.lit(-1)) + 1).alias("most_repeats"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / whole, F.lit(0.0)).alias("share"),
    )


def p7_mixture(spark, root: str) -> DataFrame:
    documents = spark.read.parquet(f"{root}/documents.parquet").select("doc_id", "source", "text")
    return mix_sources(documents, spark.read.parquet(f"{root}/mix_targets.parquet"))


def p7_shares(spark, root: str) -> DataFrame:
    targets = spark.read.parquet(f"{root}/mix_targets.parquet")
    documents = spark.read.parquet(f"{root}/documents.parquet")
    mixture = durable(p7_mixture(spark, root).select("source", "n_tokens", "repeat_no"))
    return mixture_shares(mixture, documents.select("source"), targets)
