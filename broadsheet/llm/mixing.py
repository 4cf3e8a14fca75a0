"""Mixing sources to target weights by entropy balancing.

Each source gets a token target.  Among all rates r in [0, cap] per document
that meet it, the one of least (bounded) entropy distance from the flat rate
is an exponential tilt, r = cap * s(lambda * z), with s the logistic function,
z the document's tokens over its source's mean and one multiplier lambda per
source.  The convex dual is solved by Newton steps; each step is one
aggregation over (source, size) counts, so its input is far smaller than the
corpus and one source of a third of all rows is spread over its sizes.  From
lambda = 0 the steps approach the solution from one side and need no damping.

Rates are rounded to whole copies: the integer part is taken, and the
fractional parts are ordered by a hash of the row against the rate; each
source takes rows in that order until its target is met.  The cut is found by
two passes of 4096 bins per source, never by sorting a source.

Defined cases: null texts have size 0 and are taken 0 times; null is a source
of its own, last in the order; sources without tokens have target 0; rows
that repeat id and text share one fate; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from broadsheet.llm.common import lookup, n_words, ranked
from broadsheet.session import cut_lineage

BINS = 4096
STEPS = 60
TOLERANCE = 1e-9
FAR = 1e-4  # relative distance from a target that counts as not met


def _u() -> Column:
    """A number in [0, 1) of a row's id and text."""
    return F.xxhash64("doc_id", F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, u) per row; u in [0, 1) depends on id and text only."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), _u().alias("u"))


def source_targets(rows: DataFrame, weights: list[float], share: float, cap: float) -> DataFrame:
    """(skey, source_size, n_docs, target) per source of rows (skey, size).

    Sources in code point order, null last, take ``weights`` in turn and share
    ``share`` times all tokens by weight; no target exceeds ``cap`` times its
    source, and what is above goes to the others by weight until none is.
    """
    per = rows.groupBy("skey").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(F.col("rank"), F.lit(len(weights))).cast("int") + 1)
    per = cut_lineage(ranked(per, [F.col("skey").asc()], "rank").withColumn("w", w))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    goal, level = float(share * total), 0.0
    full = F.col("source_size") * F.lit(float(cap))
    while True:  # each round caps at least one more source or ends
        above = full < F.col("w") * F.lit(level)
        at_cap, free = per.agg(F.sum(F.when(above, full).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w")))).first()
        new = (goal - (at_cap or 0.0)) / free if free else level
        if new <= level or not free:
            break
        level = new
    return per.withColumn("target", F.least(full, F.col("w") * F.lit(level))).drop("w", "rank")


def _rate(lam: Column, z: Column, cap: float) -> Column:
    return F.lit(float(cap)) / (1 + F.exp(-lam * z))


def solve(counts: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """targets plus ``lam``: Newton steps on the dual over counts (skey, size, cnt).

    Sources at a bound (target 0 or cap times their size) need no multiplier.
    Targets that the steps do not come near are an error.
    """
    inner = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(float(cap)) * (1 - 1e-12))
    lengths = counts.groupBy("skey").agg(F.count(F.lit(1)).alias("n_sizes"))
    state = cut_lineage(targets.join(lengths, "skey").withColumn("lam", F.when(inner, F.lit(0.0))))
    counts, total = counts.filter("size > 0"), counts.count()
    worst = None
    # Flat rate is cap / 2, so lambda = 0 meets a target of cap / 2 times the source.
    for _ in range(STEPS):
        # a source of a third of all sizes is met by broadcast, and its sizes stay spread
        joined = lookup(counts, state, "skey", "n_sizes", F.xxhash64("size"), total).filter("lam is not null")
        z = F.col("size") / (F.col("source_size") / F.col("n_docs"))
        r = _rate(F.col("lam"), z, cap)
        tokens = F.col("cnt") * F.col("size")
        step = joined.groupBy("skey").agg(F.sum(tokens * r).alias("g"), F.sum(tokens * z * r * (1 - r / F.lit(float(cap)))).alias("h"))
        moved = state.join(step, "skey", "left").withColumn(
            "off", F.abs(F.col("target") - F.col("g")) / F.col("target")).withColumn(
            "lam", F.when(F.col("h") > 0, F.col("lam") + (F.col("target") - F.col("g")) / F.col("h")).otherwise(F.col("lam")))
        moved = cut_lineage(moved)
        worst = moved.agg(F.max("off")).first()[0]
        state = moved.drop("g", "h", "off")
        if worst is None or worst < TOLERANCE:
            break
    if worst is not None and worst > FAR:
        raise ArithmeticError(f"a source is still {worst:.2%} off its target after {STEPS} Newton steps")
    return state.withColumn("lam", F.round("lam", 9)).drop("n_sizes")


def _keyed(rows: DataFrame) -> DataFrame:
    # null last in code point order: '1' + source before '2'
    return rows.withColumn("skey", F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("2")))


def _rated(rows: DataFrame, cap: int) -> DataFrame:
    """``rows`` (size, u and their source's numbers) plus rate, whole, open and at."""
    z = F.col("size") / (F.col("source_size") / F.col("n_docs"))
    rate = F.when(F.col("lam").isNotNull(), _rate(F.col("lam"), z, cap)).otherwise(
        F.when(F.col("target") > 0, F.lit(float(cap))).otherwise(0.0))
    rows = rows.withColumn("rate", F.when(F.col("size") > 0, rate).otherwise(0.0)).withColumn("whole", F.floor("rate"))
    # order of taking one copy more: small u against a large fraction first; in [0, 1)
    rows = rows.withColumn("at", (F.col("u") - (F.col("rate") - F.col("whole")) + 1) / 2)
    return rows.withColumn("open", (F.col("rate") > F.col("whole")) & (F.col("size") > 0))


def _copies(cap: int) -> Column:
    return F.least(F.lit(cap), F.col("whole") + F.when(F.col("open") & (F.col("at") < F.col("cut")), 1).otherwise(0)).cast("long")


def _balanced(docs: DataFrame, weights: tuple[float, ...], share: float, cap: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rated rows of ``docs``, the numbers of each source, and (skey, n_rows, cut)."""
    rows = _keyed(sizes(docs))
    counts = cut_lineage(rows.groupBy("skey", "size").agg(F.count(F.lit(1)).alias("cnt")))
    per_source = source_targets(rows.select("skey", "size"), list(weights), share, cap)
    state = cut_lineage(solve(counts, per_source, cap))
    every = cut_lineage(_rated(lookup(rows, state, "skey", "n_docs", F.xxhash64("doc_id", "u")), cap))
    owed = every.groupBy("skey").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("owed"), F.count(F.lit(1)).alias("n_rows"))
    cut = _cut(every.filter("open").select("skey", "size", "at", F.xxhash64("doc_id", "u").alias("spread")), cut_lineage(owed))
    return every, state, cut_lineage(cut)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies, rate, source) per row of ``docs``."""
    every, _, cut = _balanced(docs, weights, share, cap)
    out = lookup(every, cut, "skey", "n_rows", F.xxhash64("doc_id", "u"))
    return out.withColumn("copies", _copies(cap)).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", "source", "u")


def _cut(rows: DataFrame, owed: DataFrame) -> DataFrame:
    """(skey, n_rows, cut): taking all rows with ``at`` below the cut meets the tokens owed, to the nearest bin of the second pass."""
    def crossing(binned: DataFrame, need: DataFrame) -> DataFrame:
        """The bin in which each source's cumulated tokens reach its need: (skey, bin, before, tokens, need, n_rows)."""
        # written out, so parts of a bin meet by source and bin, and a window reads whole bins only
        tokens = cut_lineage(binned.groupBy("skey", "bin").agg(F.sum("size").alias("tokens")))
        upto = W.partitionBy("skey").orderBy("bin")  # at most BINS rows a source
        cum = tokens.withColumn("before", F.sum("tokens").over(upto) - F.col("tokens")).join(need, "skey")
        hit = cum.filter((F.col("before") < F.col("need")) & (F.col("before") + F.col("tokens") >= F.col("need")))
        return hit

    need = owed.select("skey", F.col("owed").alias("need"), "n_rows")
    first = rows.withColumn("bin", F.floor(F.col("at") * BINS))
    hit = cut_lineage(crossing(first, need))
    inside = lookup(first, hit.select("skey", F.col("bin").alias("hit"), "before", "n_rows"), "skey", "n_rows", F.col("spread")).filter("bin = hit")
    second = inside.withColumn("bin", F.floor((F.col("at") * BINS - F.col("bin")) * BINS))
    fine = crossing(second, hit.select("skey", (F.col("need") - F.col("before")).alias("need")))
    # past the crossing bin if that comes nearer to the target
    past = F.when(F.col("before") + F.col("tokens") - F.col("need") < F.col("need") - F.col("before"), 1).otherwise(0)
    fine = fine.select("skey", (F.col("bin") + past).alias("sub"))
    placed = hit.select("skey", F.col("bin").alias("main")).join(fine, "skey", "left")
    cut = (F.col("main") + F.coalesce(F.col("sub"), F.lit(0)) / F.lit(float(BINS))) / F.lit(float(BINS))
    # no crossing: nothing owed (take none) or more owed than there is (take all)
    return owed.join(placed, "skey", "left").select(
        "skey", "n_rows", F.coalesce(cut, F.when(F.col("owed") > 0, F.lit(2.0)).otherwise(-1.0)).alias("cut"))


# The numbers of all sources may be broadcast up to this size.
BROADCAST_BYTES = 32 << 20


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """``docs`` with every row repeated as often as the mix takes it (0 to cap times).

    Copies follow from the row and its source's numbers alone, so these are met
    in the scan and no text is shuffled.  Only if the sources' own table is
    above ``BROADCAST_BYTES`` do rows of the smaller sources go through a join.
    """
    _, state, cut = _balanced(docs, weights, share, cap)
    numbers = cut_lineage(state.join(cut.select("skey", "cut"), "skey"))
    size = numbers.agg(F.sum(F.octet_length("skey") + 64)).first()[0] or 0
    packed = docs.select(F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), _u().alias("u"),
                         F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"))
    packed = _keyed(packed)
    if size <= BROADCAST_BYTES:
        met = packed.join(F.broadcast(numbers), "skey")
    else:
        met = lookup(packed, numbers, "skey", "n_docs", F.xxhash64("u"))
    taken = _rated(met, cap).withColumn("copies", _copies(cap)).filter("copies > 0")
    return taken.select("__doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("__i")).select("__doc.*")
