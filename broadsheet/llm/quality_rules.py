"""Quality rules as a bitmask ledger.

``ledger`` evaluates every rule once per document and stores one failure bit
per rule next to the measurements.  Policies are versioned masks over those
bits: ``apply_policy`` is one bitwise AND per row, and ``ablations`` answers
"what would this policy keep without rule r" for all rules in one aggregation
over the stored bits, without touching a text again.

Defined cases: a null text counts as empty (no words: fails ``few_words``);
rows are judged one by one, so repeated rows and null ids each get their own
verdict; an empty table gives an empty ledger.  Further columns of the input
are ignored by ``ledger`` and kept by ``passing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.common import let, words

WINDOW = 8

# Bit i of the ledger is rule i of this list.
RULES = ["few_words", "repeated_windows", "symbols", "dup_lines", "word_length", "shouting", "few_letters"]

# A policy rejects a document when any of its rules failed.  Versions are never edited, only added.
POLICIES = {
    "base": ["few_words", "repeated_windows"],
    "v1": ["few_words", "repeated_windows", "symbols", "dup_lines"],
    "v2": RULES,
}


def mask(version: str) -> int:
    return sum(1 << RULES.index(r) for r in POLICIES[version])


def _repeat_words(ws: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text.

    If all window hashes differ, no window repeats.  Otherwise only windows
    whose hash repeats are compared, by their words.
    """
    last = F.size(ws) - (WINDOW - 1)

    def runs(pos: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + WINDOW - F.greatest(a["end"], p)).alias("n"), (p + WINDOW).alias("end"))
        return F.aggregate(pos, zero, step, lambda a: a["n"])

    def twins(s: Column) -> Column:
        """Positions of the elements whose key equals a neighbour's in the sorted array."""
        same = lambda k, d: F.coalesce(F.get(s, k)["g"] == F.get(s, k + d)["g"], F.lit(False))
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: same(k, -1) | same(k, 1))
        return F.sort_array(F.transform(at, lambda k: F.get(s, k)["p"]))

    def exact(cand: Column) -> Column:
        spelled = F.transform(cand, lambda p: F.struct(F.concat_ws(" ", F.slice(ws, p, WINDOW)).alias("g"), p.alias("p")))
        return F.when(F.size(cand) == 0, F.lit(0)).otherwise(let(F.sort_array(spelled), lambda s: let(twins(s), runs)))

    def by_hash(wh: Column) -> Column:
        keyed = F.transform(wh, lambda h, i: F.struct(h.alias("g"), (i + 1).alias("p")))
        return F.when(F.size(F.array_distinct(wh)) == F.size(wh), F.lit(0)).otherwise(
            let(F.sort_array(keyed), lambda s: let(twins(s), exact)))

    hashes = let(F.transform(ws, lambda w: F.xxhash64(w)),
                 lambda h: F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
    return F.when(last < 2, F.lit(0)).otherwise(let(hashes, by_hash))


def _of_words(ws: Column) -> Column:
    return F.struct(
        F.size(ws).cast("long").alias("n_words"),
        F.aggregate(ws, F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        _repeat_words(ws).cast("long").alias("n_repeat_words"))


def _of_lines(lines: Column) -> Column:
    return F.struct(F.size(lines).cast("long").alias("n_lines"),
                    (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))


def _left(text: Column, but: str) -> Column:
    """Number of characters of a class: what is left when all others go."""
    return F.length(F.regexp_replace(text, f"[^{but}]+", "")).cast("long")


def ledger(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per document: the ``carry`` columns (default doc_id), measurements, ``fail_bits`` (bigint)."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    m = docs.select(*[F.col(c) for c in (["doc_id"] if carry is None else carry)],
                    let(words(t), _of_words).alias("__w"), let(lines, _of_lines).alias("__l"),
                    _left(t, "#*$%&|<>").alias("n_symbols"), _left(t, r"\p{Lu}").alias("n_upper"),
                    _left(t, r"\p{L}").alias("n_letters"))
    m = m.select("*", "__w.*", "__l.*").drop("__w", "__l")
    n, letters = F.col("n_words"), F.col("n_letters")
    failed = {
        "few_words": n < 20,
        "repeated_windows": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 10 * F.col("n_symbols") > n,
        "dup_lines": 2 * F.col("n_dup_lines") > F.col("n_lines"),
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
        "shouting": 2 * F.col("n_upper") > letters,
        "few_letters": 2 * letters < F.col("word_chars"),
    }
    bits = None
    for i, rule in enumerate(RULES):
        bit = F.when(failed[rule], F.lit(1 << i)).otherwise(0).cast("long")
        bits = bit if bits is None else bits.bitwiseOR(bit)
    return m.withColumn("fail_bits", bits)


def apply_policy(rows: DataFrame, version: str) -> DataFrame:
    """Add ``policy`` and ``kept``: no rule of the policy failed."""
    return (rows.withColumn("policy", F.lit(version))
            .withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(version)).cast("long")) == 0))


def ablations(rows: DataFrame, version: str) -> DataFrame:
    """Per rule of a policy: failures, documents only it rejects, documents kept without it.

    One aggregation over the stored bits; (rule, failed, only, kept_without).
    """
    m = mask(version)
    used = F.col("fail_bits").bitwiseAND(F.lit(m).cast("long"))
    aggs = [F.coalesce(F.sum((used == 0).cast("long")), F.lit(0)).alias("kept")]
    for r in POLICIES[version]:
        b = F.lit(1 << RULES.index(r)).cast("long")
        aggs += [F.coalesce(F.sum((used.bitwiseAND(b) != 0).cast("long")), F.lit(0)).alias(f"f_{r}"),
                 F.coalesce(F.sum((used == b).cast("long")), F.lit(0)).alias(f"o_{r}")]
    one = rows.agg(*aggs)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"f_{r}").alias("failed"), F.col(f"o_{r}").alias("only"),
                              (F.col("kept") + F.col(f"o_{r}")).alias("kept_without")) for r in POLICIES[version]])
    return one.select(F.inline(each))


def passing(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The documents a policy keeps, with all their columns."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__doc"), F.col("text").alias("__text"))
    kept = apply_policy(ledger(packed, "__text", ["__doc"]), version).filter("kept")
    return kept.select("__doc.*")
