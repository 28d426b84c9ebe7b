"""An exact join of token sets by Jaccard similarity: filters on prefix, place, length and bits, and the overlap itself, before any pair is formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..steps import Steps

#: Slack for products that floating point puts just over a whole number.
SLACK = 1e-9
#: In the search for the first similar set, lists of postings longer than LONG are looked at by their first HEAD sets before the rest.
LONG, HEAD = 1024, 64


def _bits(word: int) -> Column:
    """A half of a set's 128 bits: each token sets one, chosen by its hash."""
    h = F.xxhash64("code")
    mine = F.expr("shiftleft(1L, cast(pmod(xxhash64(code), 64) as int))")
    return F.bit_or(F.when(F.pmod(F.shiftright(h, 6), F.lit(2)) == word, mine).otherwise(F.lit(0).cast("long")))


def codes(steps: Steps, *sets: DataFrame) -> DataFrame:
    """(scope, token, df, code) of the tokens that stand in two sets or more, or in one of each side, each with a number of its own; written once, so that it keeps it."""
    tokens = [s.select("scope", F.explode("t").alias("token"), F.lit(i).alias("side")) for i, s in enumerate(sets)]
    both = tokens[0] if len(tokens) == 1 else tokens[0].unionByName(tokens[1])
    # what stands on one side alone is common to no pair
    freq = both.groupBy("scope", "token").agg(F.count("*").cast("int").alias("df"), F.min("side").alias("a"), F.max("side").alias("b")).where("df > 1")
    freq = (freq.where("a < b") if len(tokens) > 1 else freq).drop("a", "b")
    freq = steps.keep(freq.withColumn("id", F.monotonically_increasing_id()))
    # partition and row, closer together, so that an int will do
    part, row = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    parts, wide = freq.agg(F.coalesce(F.max(part), F.lit(0)) + 1, F.coalesce(F.max(row), F.lit(0)) + 1).first()
    return freq.select("scope", "token", "df", (part * wide + row).cast("int" if parts * wide < 1 << 31 else "long").alias("code"))


def coded(steps: Steps, sets: DataFrame, code: DataFrame) -> DataFrame:
    """(scope, sid, n, b0, b1, o): sets by the codes of their tokens, rare ones first, those of no other set left out; n counts these too. sets: scope, sid, t."""
    each = sets.select("scope", "sid", F.size("t").alias("n"), F.explode("t").alias("token")).join(code, ["scope", "token"])
    order = F.transform(F.sort_array(F.collect_list(F.struct("df", "code"))), lambda x: x["code"])
    return steps.keep(each.groupBy("scope", "sid").agg(F.first("n").alias("n"), _bits(0).alias("b0"), _bits(1).alias("b1"), order.alias("o")))


def listed(sets: DataFrame, least: float) -> DataFrame:
    """(scope, sid, n, known, b0, b1, short, token, rest) of the first tokens of each set of coded(): rest are those behind the token.

    Two sets with a similarity of at least `least` share one of the first n - ceil(least * n) + 1 tokens of both, and of
    the smaller set even of its first n - ceil(2 * least / (1 + least) * n) + 1, which `short` marks.
    """
    length = lambda part: (F.col("n") - F.ceil(F.col("n") * part - SLACK) + 1 - F.col("n") + F.size("o")).cast("int")
    own = sets.withColumn("short_n", length(2 * least / (1 + least)))
    each = own.select("scope", "sid", "n", "b0", "b1", "o", "short_n", F.posexplode(F.slice("o", F.lit(1), F.greatest(length(least), F.lit(0)))).alias("i", "token"))
    return each.select("scope", "sid", "n", F.size("o").alias("known"), "b0", "b1", (F.col("i") < F.col("short_n")).alias("short"), "token", F.slice("o", F.col("i") + 2, F.size("o")).alias("rest"))


def met(a: DataFrame, b: DataFrame, least: float, more: Column | None = None) -> DataFrame:
    """(scope, x, y, sim), some more than once: pairs of sets of two frames of listed() that are similar; `more` is a condition on sides a and b.

    They meet on scope and token. At their first common token the overlap is one and that of what is behind it in both, at a later one
    less; so pairs that aren't similar are never formed, and the greatest sim of a pair is its own. Rows are many times the sets
    that they come from, so neither side is broadcast, however small its sets are.
    """
    c = lambda side, name: F.col(f"{side}.{name}")
    n, m = c("a", "n"), c("b", "n")
    need = F.ceil((n + m) * (least / (1 + least)) - SLACK)
    apart = lambda p, q: F.bit_count(c(p, "b0").bitwiseAND(F.bitwise_not(c(q, "b0")))) + F.bit_count(c(p, "b1").bitwiseAND(F.bitwise_not(c(q, "b1"))))
    fits = (n >= m * least - SLACK) & (m >= n * least - SLACK) & (((n <= m) & c("a", "short")) | ((m <= n) & c("b", "short")))
    fits = fits & (F.least(F.size("a.rest"), F.size("b.rest")) + 1 >= need) & (c("a", "known") - apart("a", "b") >= need) & (c("b", "known") - apart("b", "a") >= need)
    common = F.size(F.array_intersect("a.rest", "b.rest")) + 1
    sim = common / (n + m - common)
    meet = (c("a", "scope") == c("b", "scope")) & (c("a", "token") == c("b", "token"))
    meet = (meet & more if more is not None else meet) & fits & (sim >= least)
    return a.alias("a").join(b.alias("b").hint("merge"), meet).select(c("a", "scope"), c("a", "sid").alias("x"), c("b", "sid").alias("y"), sim.alias("sim"))


def heads(steps: Steps, lists: DataFrame, by: list[str], longer: int, n: int) -> tuple[DataFrame, DataFrame | None]:
    """(seen, hidden): rows, but of lists of more than `longer` only the first n by sid; and those left out, with their place k, or None where no list is so long."""
    long = steps.keep(lists.groupBy(*by).agg(F.count("*").alias("k")).where(F.col("k") > longer).drop("k"))
    if long.isEmpty():
        return lists, None
    placed = lists.join(long, by, "left_semi").withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("sid")))
    return lists.join(long, by, "left_anti").unionByName(placed.where(F.col("k") <= n).drop("k")), placed.where(F.col("k") > n)


def pairs(a: DataFrame, b: DataFrame, least: float, more: Column | None = None) -> DataFrame:
    """(scope, x, y, sim) of all similar pairs, each once; a and b as in met()."""
    return met(a, b, least, more).groupBy("scope", "x", "y").agg(F.max("sim").alias("sim"))


def within(sets: DataFrame, least: float) -> DataFrame:
    """(scope, x, y, sim) with x < y of all similar pairs of different sets; sets: scope, sid, t, each set once."""
    steps = Steps(sets.sparkSession)
    p = listed(coded(steps, sets, codes(steps, sets)), least)
    return pairs(p, p, least, F.col("a.sid") < F.col("b.sid"))


def between(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """(scope, x, y, sim) of all similar pairs of a set of a and one of b; equal sets are pairs too."""
    steps = Steps(a.sparkSession)
    code = codes(steps, a, b)
    return pairs(listed(coded(steps, a, code), least), listed(coded(steps, b, code), least), least)


def first(a: DataFrame, b: DataFrame | None, least: float) -> DataFrame:
    """(scope, x, y, sim): for each set of a that has any, the first similar set of b by sid; without b, the first one before it of a's own.

    Of long lists the heads come first. Behind them only those sets go on looking whose find, if any, lies behind the head of a list,
    and only for what comes before it; so a group of n near copies costs n times a head, and pairs are reduced to one a set where they are made.
    """
    steps = Steps(a.sparkSession)
    code = codes(steps, a) if b is None else codes(steps, a, b)
    mine = listed(coded(steps, a, code), least)
    theirs = mine if b is None else listed(coded(steps, b, code), least)
    before = F.col("b.sid") < F.col("a.sid") if b is None else F.lit(True)
    one = lambda df: df.groupBy("scope", "x").agg(F.min(F.struct("y", (-F.col("sim")).alias("less"))).alias("m")).select("scope", "x", F.col("m.y").alias("y"), (-F.col("m.less")).alias("sim"))
    seen, hidden = heads(steps, theirs, ["scope", "token"], LONG, HEAD)
    if hidden is None:
        return one(met(mine, theirs, least, before))
    found = steps.keep(one(met(mine, seen, least, before)))
    # a set goes on in a list unless all that its find leaves open is in the head; the find itself may be met there at an earlier token
    past = hidden.where(F.col("k") == HEAD + 1).select("scope", "token", F.col("sid").alias("past"))
    on = mine.join(past, ["scope", "token"]).join(found.select("scope", F.col("x").alias("sid"), F.col("y").alias("find")), ["scope", "sid"], "left")
    on = on.where(F.col("find").isNull() | (F.col("find") >= F.col("past")))
    if b is None:
        on = on.where(F.col("sid") > F.col("past"))
    sooner = F.col("a.find").isNull() | (F.col("b.sid") <= F.col("a.find"))
    return one(found.unionByName(met(on, hidden, least, before & sooner)))
