"""Personal data by weak supervision, in DataFrame functions only.

Fixed patterns give the base spans, which always stay. Looser patterns of every kind (spelt-out signs, other separators,
no country code) give further candidates, as far as their digits pass the checks of the kind. Four labelers vote on
every candidate with 1, -1 or 0 (abstains): the strict pattern with its checks; a gazetteer of top-level domains, card
issuers, area codes and reserved addresses; cue words in the text before it; and the characters around it. The votes of
all candidates are counted by kind and vote pattern, a table of at most 4 * 3^4 * 4 rows, from which
expectation-maximisation estimates each labeler's accuracy by kind and a probability for each pattern. A logistic
regression on votes, length and kind, trained on these probabilities, is the final span classifier; candidates that it
gives more than `ACCEPT` are reported too.

Defined results: null text is empty and has no spans; repeated rows are judged each on their own; an empty table gives
no rows; with no candidates at all the classifier accepts nothing; other columns are not looked at.
"""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .spans import joined, matches, starts

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.9
LABELERS = ("pattern", "gazetteer", "context", "edges")
#: What stands before a candidate and is read by the context labeler.
BEFORE = 40
#: Groups that repeat are possessive: the engine of regular expressions calls itself for each repeat of others.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
PATTERN = {
    "email": EMAIL,
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "loose_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?:\x20?[\[({](?:at|@)[\])}]\x20?|\x20at\x20)[a-z0-9-]++(?:(?:\x20?[\[({](?:dot|\.)[\])}]\x20?|\x20dot\x20|\.)[a-z0-9-]++)++",
    "loose_ip": r"(?i)(?<![0-9.])[0-9]{1,3}(?:(?:\x20?[\[({](?:dot|\.)[\])}]\x20?|\x20dot\x20)[0-9]{1,3}){3}(?![0-9])",
    "loose_card": r"(?<![0-9])(?:[0-9]{4}[\x20._/-]{1,3}[0-9]{6}[\x20._/-]{1,3}[0-9]{5}|[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{4}){2}[\x20._/-]{1,3}[0-9]{1,7})(?![0-9])",
    "loose_phone": r"(?<![0-9+(.-])(?:00[1-9][0-9]{0,2}[\x20.-](?:[0-9]{2,5}[\x20.-]){1,4}[0-9]{2,5}|(?:1[\x20.-])?(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4})(?![0-9])",
}
#: Cue words for and against a kind.
CUES = {
    "email": "e-?mail|mail|contact|write to|reach",
    "ip": r"\bip\b|address|host|server|from|login",
    "card": "card|visa|mastercard|amex|payment|credit",
    "phone": "phone|tel|call|fax|mobile|cell|whatsapp",
}
AGAINST = r"order|invoice|version|isbn|serial|\bref\b|\bid\b|build"
#: Common top-level domains.
DOMAINS = "com|org|net|edu|gov|mil|int|io|info|biz|co|me|eu|uk|de|fr|es|it|nl|be|at|ch|pl|se|no|dk|fi|pt|ie|us|ca|mx|br|ar|au|nz|jp|cn|in|kr|ru|za"
VOTE = "array<struct<start: bigint, end: bigint, kind: string, votes: string, size: int>>"


def _arrays() -> dict[str, Column]:
    t = F.col("__t")
    digits = t.rlike("[0-9](?:[ -]?[0-9]){12}")
    needs = {
        "email": F.contains(t, F.lit("@")),
        "ip": t.rlike(r"[0-9]\.[0-9]"),
        "card": digits,
        "phone": F.contains(t, F.lit("+")),
        "loose_email": t.rlike(r"(?i)[\[({](?:at|@)[\])}]| at "),
        "loose_ip": t.rlike(r"(?i)[0-9](?: ?[\[({](?:dot|\.)[\])}] ?| dot )[0-9]"),
        "loose_card": t.rlike("[0-9]{4}[ ._/-]{1,3}[0-9]{4}"),
        "loose_phone": t.rlike(r"[0-9]{3}[. -][0-9]{4}|(?<![0-9])00[1-9]"),
    }
    out = {}
    for k, p in PATTERN.items():
        gaps, found = matches("__t", p, needs[k])
        out |= {f"g_{k}": gaps, f"m_{k}": found}
    return out


def _luhn(d: str) -> str:
    """SQL for whether a string of digits passes the Luhn check."""
    return f"""(aggregate(sequence(1, length({d})), 0, (s, i) -> s + if((length({d}) - i) % 2 = 0,
        cast(substring({d}, i, 1) as int),
        cast(substring('0246813579', cast(substring({d}, i, 1) as int) + 1, 1) as int))) % 10 = 0)"""


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _valid(kind: str, m: str) -> str:
    """SQL for the checks of a kind on a match."""
    d = _digits(m)
    if kind == "email":
        return "true"
    if kind == "ip":
        return f"forall(split({m}, '[^0-9]+', -1), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)"
    if kind == "card":
        return f"(length({d}) between 13 and 19 and if(length({d}) between 13 and 19, {_luhn(d)}, false))"
    return f"length({d}) between 9 and 15"


def _gazetteer(kind: str, m: str) -> str:
    if kind == "email":
        return f"case when lower({m}) rlike '[^a-z0-9-](?:{DOMAINS})$' then 1 else -1 end"
    if kind == "ip":
        return f"case when {m} rlike '^(?:0|10|127|255|22[4-9]|2[345][0-9])[^0-9]' then -1 else 1 end"
    if kind == "card":
        return f"case when {m} rlike '^(?:4|5[1-5]|3[47]|6011|65)' then 1 else -1 end"
    return f"case when {m} rlike '^(?:[+]?1[ (.-]*)?[(]?[2-9][0-9]{{2}}' or {m} rlike '^(?:[+]|00)[2-9]' then 1 else 0 end"


def _votes(kind: str, strict: bool, x: str) -> str:
    """SQL for the votes of the four labelers on a struct x of match, text before, and the characters beside it."""
    cue, against = CUES[kind].replace("\\", "\\\\"), AGAINST.replace("\\", "\\\\")
    pattern = f"if({_valid(kind, x + '.m')}, 1, -1)" if strict else "0"
    context = f"case when {x}.before rlike '{cue}' then 1 when {x}.before rlike '{against}' then -1 else 0 end"
    edges = f"case when {x}.left rlike '[A-Za-z0-9]' or {x}.right rlike '[A-Za-z0-9]' then -1 else 1 end"
    return f"concat_ws(',', {pattern}, {_gazetteer(kind, x + '.m')}, {context}, {edges})"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, n_email.., base and cands (arrays of spans): one pass, nothing is exchanged."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"))
    df = df.withColumns(_arrays())
    df = df.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, starts(f"g_{k}", f"m_{k}")).otherwise(F.expr("cast(array() as array<bigint>)")) for k in PATTERN})
    cands = []
    for order, kind in enumerate(KINDS):
        span = f"transform(m_{kind}, (m, i) -> named_struct('order', {order}, 'start', p_{kind}[i], 'end', p_{kind}[i] + length(m), 'kind', '{kind}', 'ok', {_valid(kind, 'm')}))"
        df = df.withColumn(f"s_{kind}", F.expr(f"filter({span}, s -> s.ok)"))
        for source in (kind, f"loose_{kind}"):
            strict = source == kind
            # the text before a match lies in the gap before it, as far as that goes
            seen = f"transform(m_{source}, (m, i) -> named_struct('m', m, 'start', p_{source}[i], 'before', lower(right(g_{source}[i], {BEFORE})), 'left', right(g_{source}[i], 1), 'right', left(g_{source}[i + 1], 1)))"
            # what is too short or too long is no candidate; loose ones must pass the checks and lie beside the base spans
            fits = f"length({_digits('x.m')}) between {13 if kind == 'card' else 4} and {19 if kind == 'card' else 15}" if strict and kind != "email" else _valid(kind, "x.m")
            if not strict:
                fits += f" and not exists(s_{kind}, b -> b.start < x.start + length(x.m) and x.start < b.end)"
            cands.append(f"transform(filter({seen}, x -> {fits}), x -> named_struct('start', x.start, 'end', x.start + length(x.m), 'kind', '{kind}', 'votes', {_votes(kind, strict, 'x')}, 'size', cast(length(x.m) div 8 as int)))")
    df = df.withColumn("base", F.array_sort(F.concat(*[f"s_{k}" for k in KINDS])))
    df = df.withColumn("cands", F.expr(f"cast(concat({', '.join(cands)}) as {VOTE})"))
    return df.select("doc_id", *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in KINDS], "base", "cands")


def expectation(counts: dict[tuple[str, tuple[int, ...]], int], rounds: int = 60) -> dict[tuple[str, tuple[int, ...]], float]:
    """Probability that a candidate is real, by kind and votes, from counts of votes alone.

    Each labeler has, by kind, a rate of 1, 0 and -1 on real and on false candidates; these and the share of real
    ones are estimated in turn with the probabilities. It starts from labelers that are right four times in five.
    """
    out: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind in sorted({k for k, _ in counts}):
        rows = [(v, n) for (k, v), n in counts.items() if k == kind]
        share = 0.5
        rate = [({1: 0.6, 0: 0.3, -1: 0.1}, {1: 0.1, 0: 0.3, -1: 0.6}) for _ in LABELERS]
        prob: dict[tuple[int, ...], float] = {}
        for _ in range(rounds):
            for v, _n in rows:
                a = log(share) + sum(log(rate[j][0][x]) for j, x in enumerate(v))
                b = log(1 - share) + sum(log(rate[j][1][x]) for j, x in enumerate(v))
                prob[v] = 1 / (1 + exp(min(500.0, b - a)))
            total = sum(n for _, n in rows)
            real = sum(prob[v] * n for v, n in rows)
            share = min(0.99, max(0.01, (real + 1) / (total + 2)))
            for j in range(len(LABELERS)):
                yes = {x: 1.2 * w + sum(prob[v] * n for v, n in rows if v[j] == x) for x, w in ((1, 6), (0, 3), (-1, 1))}
                no = {x: 1.2 * w + sum((1 - prob[v]) * n for v, n in rows if v[j] == x) for x, w in ((1, 1), (0, 3), (-1, 6))}
                rate[j] = ({x: y / sum(yes.values()) for x, y in yes.items()}, {x: y / sum(no.values()) for x, y in no.items()})
        out |= {(kind, v): p for v, p in prob.items()}
    return out


def inputs(kind: str, votes: tuple[int, ...], size: int) -> list[float]:
    """What the classifier sees of a candidate: a constant, the votes, the pattern's silence, the length, the kind."""
    return [1.0, *map(float, votes), float(votes[0] == 0), min(size, 5) / 5, *[float(kind == k) for k in KINDS]]


def classifier(counts: dict[tuple[str, tuple[int, ...], int], int], rounds: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> list[float]:
    """Weights of a logistic regression on the probabilities that expectation() gives, every candidate counted."""
    votes: dict[tuple[str, tuple[int, ...]], int] = {}
    for (k, v, _), n in counts.items():
        votes[k, v] = votes.get((k, v), 0) + n
    target = expectation(votes)
    rows = [(inputs(k, v, s), target[k, v], n) for (k, v, s), n in counts.items()]
    total = sum(n for *_, n in rows) or 1
    w = [0.0] * len(inputs("email", (0, 0, 0, 0), 0))
    for _ in range(rounds):
        slope = [ridge * x for x in w]
        for x, y, n in rows:
            e = (1 / (1 + exp(-max(-500.0, min(500.0, sum(a * b for a, b in zip(w, x, strict=True)))))) - y) * n / total
            slope = [g + e * a for g, a in zip(slope, x, strict=True)]
        w = [a - rate * g for a, g in zip(w, slope, strict=True)]
    return w


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and n_spans, the number of all spans."""
    measured = Scratch(spark).keep(candidates(docs))
    one = measured.where("size(cands) > 0").select(F.explode("cands").alias("c")).groupBy("c.kind", "c.votes", F.least(F.col("c.size"), F.lit(5)).alias("size")).count()
    # at most 4 kinds x 81 patterns x 6 lengths
    counts = {(r["kind"], tuple(map(int, r["votes"].split(","))), r["size"]): r["count"] for r in one.collect()}
    w = classifier(counts) if counts else None
    weighed = {k: 1 / (1 + exp(-max(-500.0, min(500.0, sum(a * b for a, b in zip(w, inputs(*k), strict=True)))))) for k in counts} if w else {}
    # a strict pattern's candidate that fails its checks has been judged already; only loose ones can be added
    taken = sorted(f"{k}:{','.join(map(str, v))}:{s}" for (k, v, s), p in weighed.items() if p >= ACCEPT and v[0] == 0)
    fresh = F.expr("filter(cands, c -> array_contains(taken, concat_ws(':', c.kind, c.votes, cast(least(c.size, 5) as string))))")
    order = "case c.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    added = F.expr(f"transform(fresh, c -> named_struct('order', {order}, 'start', c.start, 'end', c.end, 'kind', c.kind, 'ok', true))")
    out = measured.withColumn("taken", F.array(*map(F.lit, taken)).cast("array<string>")).withColumn("fresh", fresh)
    out = out.withColumn("all", F.array_sort(F.concat("base", added)))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), F.size("all").cast("long").alias("n_spans"))
