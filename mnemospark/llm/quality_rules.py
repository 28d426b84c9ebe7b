"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each document gets counts (words, symbols, repeated lines and windows) and from these a few rule scores, each with a grid
of cutoffs. For each stratum (language), settings of all cutoffs together are tested on the labelled documents: a setting
may reject good documents (quality 1, not toxic, past the base rule) at a rate of at most `alpha`. The settings form fixed
paths, one that starts with each rule: all rules are off, then one after the other is tightened cutoff by cutoff. Along a
path, exact binomial tails are compared with `delta / (strata * paths)`, and the first that fails ends it: a path
certifies no bad setting but with that probability, so by Bonferroni's correction over strata and paths, with probability
1 - delta no certified setting of any stratum loses more than `alpha` of its good documents. Of a stratum's certified settings
the one is used that rejects most labelled bad documents beyond the good ones that it rejects, then the mildest. A stratum
in which no setting is certified has no cutoffs: with no good document rejected, that takes `least_labels()` labelled good documents, 308.

Defined results: null or empty text has no words, so the base rule rejects it; a null or unlisted language is the
stratum "other"; repeated doc_ids are judged row by row; labels that are null count for nothing and repeated labels
of a document count once (the lowest); an empty table gives no rows; columns that are not named here are not looked
at. Windows are told apart by 64-bit hashes; those that seem to repeat are then compared as words.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, columns

STRATA = ("en", "de", "fr", "es")
ALPHA, DELTA = 0.02, 0.05
#: Cutoffs tried by rule, the strictest first; a document is rejected if its score is over the cutoff.
GRID = {
    "symbol_ratio": (0.02, 0.05, 0.1, 0.2, 0.4, 0.8),
    "dup_line_ratio": (0.05, 0.1, 0.2, 0.3, 0.5, 0.8),
    "repeat_ratio": (0.02, 0.05, 0.1, 0.2, 0.3, 0.4),
    "long_words": (8.0, 9.0, 10.0, 12.0, 16.0, 24.0),
    "short_words": (-4.5, -4.0, -3.5, -3.0, -2.5, -2.0),
}
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeats() -> Column:
    """Words within 3-word windows that occur twice or more, from the array columns `w` and `k`.

    The longs of `k` are hash bits above index bits, sorted, so that equal windows lie side by side. Those whose hash
    bits repeat are sorted by their words, and only equal words count.
    """
    return F.expr("""
        aggregate(
          transform(
            array(array_sort(transform(
              array_distinct(flatten(transform(
                filter(sequence(1, greatest(size(k) - 1, 1)), j -> size(k) > 1 and shiftright(k[j], bits) = shiftright(k[j - 1], bits)),
                j -> transform(array(k[j - 1], k[j]), x -> cast(x & (shiftleft(1L, bits) - 1) as int))))),
              i -> named_struct('window', concat_ws(' ', w[i], w[i + 1], w[i + 2]), 'i', i)))),
            some -> array_sort(transform(
              filter(transform(some, (x, j) -> named_struct('i', x.i, 'same',
                  (j > 0 and some[greatest(j - 1, 0)].window = x.window) or (j < size(some) - 1 and some[least(j + 1, size(some) - 1)].window = x.window))),
                x -> x.same),
              x -> x.i)))[0],
          named_struct('n', 0L, 'at', -3),
          (s, i) -> named_struct('n', s.n + least(3, greatest(i - s.at, 0)), 'at', i),
          s -> s.n)
    """)


def features(docs: DataFrame, also: list[str] = ()) -> DataFrame:
    """doc_id, lang and the counts of each document, and the columns named in `also`; one pass, nothing is exchanged."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), text.alias("text"), *also)
    df = df.withColumn("w", F.filter(F.split("text", r"[\x20\x09-\x0D]+", -1), lambda x: x != ""))
    df = df.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n", F.size("w"))
    df = df.withColumn("bits", F.greatest(F.lit(1), F.ceil(F.log2(F.col("n") + F.lit(1.0)))).cast("int"))
    df = df.withColumn("h", F.expr("case when n < 3 then cast(array() as array<bigint>) else transform(sequence(0, n - 3), i -> xxhash64(w[i], w[i + 1], w[i + 2])) end"))
    df = df.withColumn("some", F.expr("size(array_distinct(h)) < size(h)"))
    # one long a window: its hash without the lowest bits, which hold the index
    df = df.withColumn("k", F.expr("case when some then sort_array(transform(h, (x, i) -> (shiftleft(x, bits) | i))) else cast(array() as array<bigint>) end"))
    return df.select(
        "doc_id", "lang", *also,
        F.col("n").cast("long").alias("n_words"),
        # every character that is no separator stands in a word
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("some"), _repeats()).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def scores() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbol_ratio": F.col("n_symbols") / chars,
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_ratio": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
        "short_words": -F.col("word_chars") / words,
    }


def stratum() -> Column:
    return F.when(F.col("lang").isin(*STRATA), F.col("lang")).otherwise(F.lit("other"))


def tail(k: str, n: str, p: float) -> Column:
    """P(X <= k) of a binomial, summed in logarithms: the exact test that a rate is below p."""
    return F.expr(f"""
        case when {k} >= {n} then 1d else aggregate(
          sequence(0L, {k}),
          named_struct('log', cast(0 as double), 'sum', cast(0 as double)),
          (s, i) -> named_struct(
            'log', case when i = 0 then {n} * ln(1 - {p}d) else s.log + ln(({n} - i + 1) / i) + ln({p}d / (1 - {p}d)) end,
            'sum', s.sum + exp(case when i = 0 then {n} * ln(1 - {p}d) else s.log + ln(({n} - i + 1) / i) + ln({p}d / (1 - {p}d)) end)),
          s -> s.sum) end""")


RULES = tuple(GRID)
#: Fixed paths: for each, the cutoffs in force by rule after each step, as a number of cutoffs tried (0: the rule is off).
PATHS = [
    [tuple(len(GRID[r]) if (j - first) % len(RULES) < k else step if (j - first) % len(RULES) == k else 0 for j, r in enumerate(RULES)) for k in range(len(RULES)) for step in range(1, len(GRID[RULES[(first + k) % len(RULES)]]) + 1)]
    for first in range(len(RULES))
]


def least_labels(alpha: float = ALPHA, delta: float = DELTA) -> int:
    """Labelled good documents that a stratum needs for a cutoff to be certified that rejects none of them."""
    return ceil(log(delta / ((len(STRATA) + 1) * len(PATHS))) / log(1 - alpha))


def thresholds(spark: SparkSession, measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, path, step, n_good, good_rejected, n_bad, bad_rejected, certified: at most 5 strata x 150 settings.

    Documents are first counted by the step at which each rule begins to reject them, so each setting is tried on counts.
    """
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality is not null")
    known = known.select("doc_id", ((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).alias("good"))
    held = measured.where("n_words >= 50 and 100 * n_repeat_words <= 50 * n_words").join(known, "doc_id")
    by = scores()
    first = [(len(GRID[r]) + 1 - sum((by[r] > F.lit(float(c))).cast("int") for c in GRID[r])).alias(f"first_{j}") for j, r in enumerate(RULES)]
    counted = held.select(stratum().alias("stratum"), "good", *first).groupBy("stratum", "good", *[f"first_{j}" for j in range(len(RULES))]).count()
    tests = [F.struct(F.lit(p).alias("path"), F.lit(k).alias("step"), F.array(*map(F.lit, cuts)).alias("cuts")) for p, path in enumerate(PATHS) for k, cuts in enumerate(path)]
    tried = counted.withColumn("t", F.explode(F.array(*tests)))
    rejected = F.expr(" or ".join(f"first_{j} <= t.cuts[{j}]" for j in range(len(RULES))))
    total = lambda which, name: F.sum(F.when(which, F.col("count")).otherwise(0)).alias(name)
    good = F.col("good")
    each = tried.groupBy("stratum", F.col("t.path").alias("path"), F.col("t.step").alias("step")).agg(
        total(good, "n_good"), total(good & rejected, "good_rejected"), total(~good, "n_bad"), total(~good & rejected, "bad_rejected")
    )
    passed = each.withColumn("passed", (F.col("n_good") > 0) & (tail("good_rejected", "n_good", alpha) <= F.lit(delta / ((len(STRATA) + 1) * len(PATHS)))))
    before = Window.partitionBy("stratum", "path").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return passed.withColumn("certified", F.min("passed").over(before)).drop("passed")


def limits_of(tests: DataFrame) -> dict[tuple[str, str], float]:
    """The cutoffs in force by stratum and rule: at most 5 x 5 numbers, which become literals of the plan."""
    best: dict[str, tuple] = {}
    for r in tests.where("certified").collect():
        rank = (r["good_rejected"] - r["bad_rejected"], r["good_rejected"], r["step"], r["path"])
        best[r["stratum"]] = min(best.get(r["stratum"], rank), rank)
    return {(s, rule): GRID[rule][len(GRID[rule]) - k] for s, (_, _, step, path) in best.items() for rule, k in zip(RULES, PATHS[path][step], strict=True) if k}


def verdict(measured: DataFrame, limits: dict[tuple[str, str], float]) -> DataFrame:
    """Adds base_failed, kept and failed_rules to the measured documents."""
    failed = []
    for rule, score in scores().items():
        rejects = F.lit(False)
        for s in (*STRATA, "other"):
            if (s, rule) in limits:
                rejects = rejects | ((stratum() == F.lit(s)) & (score > F.lit(float(limits[s, rule]))))
        failed.append(F.when(rejects, F.lit(rule)))
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    out = measured.withColumns({"base_failed": base, "failed_rules": F.concat_ws(",", *failed)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == ""))


def judge(spark: SparkSession, docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the five counts, base_failed, kept, failed_rules."""
    measured = Scratch(spark).keep(features(docs))
    limits = limits_of(thresholds(spark, measured, labels, alpha, delta))
    return verdict(measured, limits).select("doc_id", *FEATURES, "base_failed", "kept", "failed_rules")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of documents that are kept, as they were.

    The counts are written once, beside their rows: filters on them, pushed below, would take them again for every use.
    """
    carried = Scratch(spark).keep(features(docs.select("doc_id", "lang", "text", F.struct(*columns(docs)).alias("__row")), also=["__row"]))
    limits = limits_of(thresholds(spark, carried, labels, alpha, delta))
    return verdict(carried, limits).where("kept").select("__row.*")
