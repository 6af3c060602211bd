"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

A document is taken at a rate in [0, 2]. Among all rates that give every source its target of words, entropy balancing
takes those nearest to one; they are exponentially tilted by size, rate = 2 / (1 + exp(-lambda * size / mean size)), and
lambda solves the convex dual, one constraint a source. Newton steps run over the counts of each (source, size) as joins
and sums, kept inside a bracket that halves when a step would leave it; the state of a step is a small table.

Rates become copies by systematic rounding along the sizes of a source, from the offset that brings the words taken nearest
to the target, within less than a document's size; documents of one size share a group's copies in the order of a hash of their id. Groups are cut into
bins of that hash, so a hot source or size is never ordered in one task.

Defined cases: null text has size 0 and takes 0; the null source is a source of its own, last; repeated rows are rows of
their own; a source without words has target 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowloom.llm import store

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
BINS = 1024
STEPS = 60
#: Offsets of the systematic rounding that are tried for each source.
OFFSETS = 32
#: Sources whose state is broadcast; beyond it the join is by shuffle.
BROADCAST_SOURCES = 100_000


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, k, o, bin): k names the source (never null), o orders documents of one size."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    o = F.xxhash64(F.lit("mix"), "doc_id")
    return store.columns(docs, "doc_id", "text", "source").select(
        "doc_id",
        "source",
        size.alias("size"),
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("k"),
        o.alias("o"),
        F.pmod(o, F.lit(BINS)).cast("int").alias("bin"),
    )


def numbered(rows: DataFrame, order: Column) -> DataFrame:
    """``rows`` with at, their number from 0 in ``order``; sorted in ranges, never in one task."""
    low = (1 << 33) - 1
    rows = rows.repartitionByRange(store.width(rows.sparkSession), order).sortWithinPartitions(order).withColumn("id", F.monotonically_increasing_id())
    rows = store.keep(rows.select("*", F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit(low)).alias("at")).drop("id"), "mix-order")
    # one row a partition
    before = F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = rows.groupBy("part").agg(F.count("*").alias("m")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(F.broadcast(parts), "part").withColumn("at", F.col("at") + F.col("before")).drop("part", "before")


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(k, source, source_size, target) of ``per_source`` (k, source, source_size), one row a source.

    Sources get words by weight, up to ``most`` times their size. The level, words for each weight of a source below its limit, is
    found by steps: what the sources at their limit leave, dealt to the others, until no more are at theirs. Two numbers of
    a step reach the driver.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("at"), F.lit(len(weights))) + 1).cast("int"))
    rows = numbered(per_source, F.col("source").asc_nulls_last()).withColumn("w", w).withColumn("limit", F.col("source_size") * F.lit(most))
    rows = store.keep(rows, "mix-weights")
    total = rows.agg(F.sum("source_size")).first()[0]
    level, last = 0.0, -1
    while total:
        full = F.col("limit") <= F.lit(level) * F.col("w")
        n, held, open_ = rows.agg(F.sum(full.cast("int")), F.sum(F.when(full, F.col("limit")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("w")))).first()
        if n == last or not open_:
            break
        level, last = (share * float(total) - held) / open_, n
    return rows.select("k", "source", "source_size", F.least(F.col("limit"), F.lit(level) * F.col("w")).alias("target"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def tilt(lam: Column, size: Column, mean: Column) -> Column:
    z = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * size / mean))
    return F.lit(MOST) / (1 + F.exp(-z))


def balance(hist: DataFrame, goals: DataFrame, n_sources: int, steps: int = STEPS) -> DataFrame:
    """(k, lam, mean): the dual's solution; ``hist``: (k, size, n) of sizes over 0, ``goals``: (k, target, limit).

    A source whose target is its limit has no finite lambda: null, rate ``MOST``.
    """
    mean = hist.groupBy("k").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = goals.join(mean, "k").select(
        "k", "target", "mean", (F.col("target") >= F.col("limit")).alias("full"), F.lit(0.0).alias("lam"), F.lit(-1e7).alias("lo"), F.lit(1e7).alias("hi"), F.lit(False).alias("done")
    )
    state = store.keep(state, "mix-state")
    for _ in range(steps):
        rate = tilt(F.col("lam"), F.col("size"), F.col("mean"))
        words = F.col("size") * F.col("n")
        sums = (
            hist.join(_small(state.filter("not full and not done").select("k", "lam", "mean"), n_sources), "k")
            .groupBy("k")
            .agg(F.sum(rate * words).alias("f"), F.sum(rate * (1 - rate / MOST) * words * F.col("size") / F.col("mean")).alias("g"))
        )
        err = F.col("f") - F.col("target")
        lo, hi = F.when(err < 0, F.col("lam")).otherwise(F.col("lo")), F.when(err > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - err / F.when(F.col("g") > 0, F.col("g"))
        # tilts beyond 16 mean sizes move hardly a word: outside it the bracket is widened step by step
        newton = F.greatest(F.least(newton, F.col("lam") + 16 + F.abs("lam")), F.col("lam") - 16 - F.abs("lam"))
        nxt = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        done = F.abs(err) <= F.lit(1e-10) * F.col("target") + F.lit(1e-9)
        moved = state.join(_small(sums, n_sources), "k", "left")
        still = F.col("f").isNull()
        moved = moved.select(
            "k", "target", "mean", "full",
            F.when(still | done, F.col("lam")).otherwise(nxt).alias("lam"),
            F.when(still, F.col("lo")).otherwise(lo).alias("lo"),
            F.when(still, F.col("hi")).otherwise(hi).alias("hi"),
            (still | done).alias("done"),
        )
        new = store.keep(moved, "mix-state")
        store.drop(state)
        state = new
        if not state.filter("not full and not done").limit(1).count():
            break
    return state.select("k", F.when(~F.col("full"), F.round("lam", 9)).alias("lam"), "mean")


def mix(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row of ``docs`` (doc_id, text, source)."""
    d = store.keep(sizes(docs), "mix-sizes")
    groups = store.keep(d.groupBy("k", "size", "bin").agg(F.count("*").alias("n")), "mix-groups")
    hist = store.keep(groups.groupBy("k", "size").agg(F.sum("n").alias("n")), "mix-hist")
    per = d.groupBy("k", "source").agg(F.sum("size").alias("source_size"))
    goals = store.keep(targets(per), "mix-goals")
    n_sources = goals.count()
    limits = goals.filter("source_size > 0").select("k", "target", (F.col("source_size") * F.lit(MOST)).alias("limit"))
    dual = balance(hist.filter("size > 0"), limits, n_sources)

    rate = F.coalesce(tilt(F.col("lam"), F.col("size"), F.col("mean")), F.lit(MOST))
    along = hist.filter("size > 0").join(_small(dual, n_sources), "k").withColumn("rate", rate)
    up = Window.partitionBy("k").orderBy("size")
    along = along.withColumn("upto", F.sum(F.col("rate") * F.col("n")).over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    along = along.withColumn("start", F.coalesce(F.lag("upto").over(up), F.lit(0.0)))
    copies = lambda u: F.least(F.floor(F.col("upto") + u) - F.floor(F.col("start") + u), F.col("n") * int(MOST))
    # of some offsets of the rounding, the one whose words come nearest to the target
    tries = along.select("k", "size", "n", "upto", "start", F.explode(F.array(*[F.lit((i + 0.5) / OFFSETS) for i in range(OFFSETS)])).alias("u"))
    words = tries.groupBy("k", "u").agg(F.sum(F.col("size") * copies(F.col("u"))).alias("words"))
    miss = F.abs(F.col("words") - F.col("target"))
    best = words.join(_small(limits, n_sources), "k").groupBy("k").agg(F.min(F.struct(F.round(miss, 6), "u")).getField("u").alias("u"))
    along = along.join(_small(best, n_sources), "k").select("k", "size", F.col("n").alias("n_all"), copies(F.col("u")).alias("c"))

    ranks = Window.partitionBy("k", "size").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = groups.select("k", "size", "bin", F.coalesce(F.sum("n").over(ranks), F.lit(0)).alias("before")).join(along, ["k", "size"])
    row = F.row_number().over(Window.partitionBy("k", "size", "bin").orderBy("o", "doc_id"))
    out = d.withColumn("row", row).join(before, ["k", "size", "bin"], "left")
    extra = F.when(F.col("before") + F.col("row") <= F.col("c") % F.col("n_all"), 1).otherwise(0)
    copies = F.coalesce(F.floor(F.col("c") / F.col("n_all")) + extra, F.lit(0)).cast("long")
    out = out.withColumn("copies", copies).join(_small(goals.select("k", "source_size", "target"), n_sources), "k")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
