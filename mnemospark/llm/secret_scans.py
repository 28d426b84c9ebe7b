"""Secret scans: fixed patterns, and sliding-window Shannon entropy of candidate strings, in DataFrame functions only.

Candidates are runs of 20 or more characters that keys are made of. A candidate belongs to the class "hex" (digits
and a-f in one case), "base64" (lower case, upper case and digits together), "base36" (lower case and digits) or "base32"
(upper case and digits); the latter two hold 20 letters and digits in a row, with digits in several places, as words with a
number behind them don't. Over every window of `WINDOW`
characters the entropy is kept by incremental counts: as the window moves on, the counts of the character that
leaves and of the one that comes change, and with them their two terms of the sum of c * log2(c). A candidate costs time in
proportion to its length. The largest entropy
decides, against a threshold by class. An allow list suppresses known harmless shapes. What overlaps a span of the
fixed patterns is not reported again.

Defined results: null text is empty and has no spans; repeated rows are judged each on their own; an empty table
gives no rows; columns other than doc_id and text are not looked at. Very long texts are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns
from .spans import joined, matches, starts

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_base36", "entropy_base32")
WINDOW = 20
THRESHOLD = {"hex": 3.0, "base64": 3.8, "base36": 3.4, "base32": 3.3}
#: By class: which candidates belong to it, in order. `m` is the candidate.
_RUNS = lambda letters, n: f"m rlike '(?:(?<![0-9])[0-9]++[{letters}]++){{{n}}}'"
_DIGITS = "5 * length(regexp_replace(m, '[^0-9]+', '')) >= length(m)"
SHAPE = {
    "hex": "m rlike '^(?:[0-9a-f]+|[0-9A-F]+)$' and m rlike '[0-9]' and m rlike '[a-fA-F]'",
    "base64": "m rlike '[a-z]' and m rlike '[A-Z]' and m rlike '[0-9]'",
    "base36": f"not m rlike '[A-Z]' and m rlike '[a-z0-9]{{20}}' and ({_RUNS('a-z', 3)} or {_RUNS('a-z', 2)} and {_DIGITS})",
    "base32": f"not m rlike '[a-z]' and m rlike '[A-Z0-9]{{20}}' and {_RUNS('A-Z', 2)}",
}
MARK = "[SECRET]"
PATTERN = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "(?<![0-9a-f])[0-9a-f]{32,}+",
    "candidate": "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
}
#: Harmless shapes, matched in a whole candidate: placeholders, runs of one character, identifiers, words joined by signs, paths.
ALLOWED = (
    r"(?i).*(?:example|sample|placeholder|dummy|changeme|xxxx|your[_-]?).*",
    r"(.)\1*",
    r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    r"(?i)(?:0123456789|abcdefghij|1234567890).*",
    r"(?:[A-Za-z]++[-_/=+])*+[A-Za-z]+",
    r"[0-9+/_=-]+",
)


#: The characters of a candidate by code; signs that stand for the same value share one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def _term(n: str) -> str:
    return f"if({n} > 1, ({n}) * log2(double({n})), 0d)"


def _entropy(token: str, size: int = WINDOW) -> str:
    """SQL for the largest entropy in bits of any window of a string, by counts that change by one character at a time.

    The string becomes an array of codes once, over which the window slides; so the work is in proportion to its length.
    """
    moved = f"z.sum - {_term('c.gone')} + {_term('c.gone - 1')} - {_term('c.had')} + {_term('c.had + 1')}"
    return f"""
      transform(
        array(transform(filter(split(translate({token}, '-_=', '+//'), ''), x -> x <> ''), x -> instr('{ALPHABET}', x) - 1)),
        codes -> aggregate(
          sequence(0, size(codes) - 1),
          named_struct('counts', array_repeat(0, {len(ALPHABET)}), 'sum', 0d, 'least', double('infinity')),
          (z, i) -> transform(array(struct(codes[i] as inn, if(i >= {size}, codes[greatest(i - {size}, 0)], -1) as out)),
            m -> transform(array(struct(
                if(m.out >= 0, z.counts[greatest(m.out, 0)], 0) as gone,
                z.counts[m.inn] - if(m.out = m.inn, 1, 0) as had)),
              c -> named_struct(
                'counts', if(m.out = m.inn, z.counts, transform(z.counts, (v, k) -> v + if(k = m.inn, 1, 0) - if(k = m.out, 1, 0))),
                'sum', {moved},
                'least', if(i >= {size} - 1, least(z.least, {moved}), z.least)))[0])[0],
          z -> log2({size}d) - z.least / {size}))[0]
    """


def _base(text: str) -> tuple[dict[str, Column], dict[str, Column]]:
    needs = {
        "assign": F.col(text).rlike(r"(?i)(?:passw|secret|token|api_?key)"),
        "access": F.contains(F.col(text), F.lit("AKIA")),
        "hex": F.col(text).rlike("[0-9a-f]{32}"),
        "candidate": F.col(text).rlike("[A-Za-z0-9+/_=-]{20}"),
    }
    needs["assign"] = F.col(text).rlike("[:=]") & needs["assign"]
    both = {k: matches(text, PATTERN[k], needs[k]) for k in PATTERN}
    return {f"g_{k}": v[0] for k, v in both.items()}, {f"m_{k}": v[1] for k, v in both.items()}


def scan(docs: DataFrame, also: list[str] = ()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (array of spans), all (array of spans), text, and the columns in `also`."""
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__t"), *also)
    gaps, found = _base("__t")
    df = df.withColumns(gaps | found)
    df = df.withColumns({f"p_{k}": F.when(F.size(f"m_{k}") > 0, starts(f"g_{k}", f"m_{k}")).otherwise(F.expr("cast(array() as array<bigint>)")) for k in PATTERN})
    good = {
        "assign": r"length(regexp_extract(m, '(?i)^(?:password|passwd|secret|token|api_?key)[\\x22\\x27]?\\x20*[:=]\\x20*[\\x22\\x27]?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8",
        "access": "length(m) >= 16",
        "hex": "length(m) >= 32",
    }
    span = lambda k, kind: f"transform(m_{k}, (m, i) -> named_struct('start', p_{k}[i], 'order', {KINDS.index(kind)}, 'end', p_{k}[i] + length(m), 'kind', '{kind}', 'ok', {good[k]}))"
    df = df.withColumns({f"s_{k}": F.expr(f"filter({span(k, k)}, s -> s.ok)") for k in good})
    df = df.withColumn("base", F.array_sort(F.concat("s_assign", "s_access", "s_hex")))
    # a candidate's class, and whether it is worth the windows
    shape = "case " + " ".join(f"when {test} then '{k}'" for k, test in SHAPE.items()) + " end"
    df = df.withColumn("cands", F.expr(f"filter(transform(m_candidate, (m, i) -> named_struct('start', p_candidate[i], 'end', p_candidate[i] + length(m), 'm', m, 'class', {shape})), s -> s.class is not null)"))
    allowed = " or ".join("s.m rlike '^(?:{})$'".format(p.replace("\\", "\\\\")) for p in ALLOWED)
    df = df.withColumn("cands", F.expr(f"filter(cands, s -> not ({allowed}) and not exists(base, b -> b.start < s.end and s.start < b.end))"))
    least = "case s.class " + " ".join(f"when '{k}' then {v}d" for k, v in THRESHOLD.items()) + " end"
    kind = "case s.class " + " ".join(f"when '{k}' then {KINDS.index('entropy_' + k)}" for k in THRESHOLD) + " end"
    df = df.withColumn("extra", F.expr(f"transform(filter(cands, s -> {_entropy('s.m')} >= {least}), s -> named_struct('start', s.start, 'order', {kind}, 'end', s.end, 'kind', concat('entropy_', s.class), 'ok', true))"))
    df = df.withColumn("all", F.array_sort(F.concat("base", "extra")))
    return df.select("doc_id", *[F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in good], "base", "all", F.col("__t").alias("whole_text"), *also)


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """Every row with each secret in its text replaced by MARK; overlapping spans count as one. Null texts stay null."""
    found = scan(docs.select("doc_id", "text", F.struct(*columns(docs)).alias("__row")), also=["__row"])
    # spans merged where they overlap, in the order of their starts
    merged = F.expr("""
      aggregate(all, cast(array() as array<struct<start: bigint, end: bigint>>), (acc, s) ->
        if(size(acc) > 0 and s.start < element_at(acc, -1).end,
           concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, s.end)))),
           concat(acc, array(named_struct('start', s.start, 'end', s.end)))))
    """)
    found = found.withColumn("cut", F.when(F.size("all") > 0, merged))
    kept = F.expr(f"""
      concat(
        array_join(transform(cut, (s, i) -> substring(whole_text, cast(if(i = 0, 0, cut[i - 1].end) as int) + 1, cast(s.start - if(i = 0, 0, cut[i - 1].end) as int))), '{MARK}'),
        '{MARK}', substring(whole_text, cast(element_at(cut, -1).end as int) + 1))
    """)
    new = F.when(F.col("cut").isNotNull(), kept).otherwise(F.col("__row.text"))
    field = lambda c: F.col("__row.`{}`".format(c.replace("`", "``")))
    cols = []
    for c, kind in docs.dtypes:
        if c == "text":
            cols.append(new.alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("cut").isNotNull(), F.length(new)).otherwise(field(c)).cast(kind).alias(c))
        else:
            cols.append(field(c).alias(c))
    return found.select(*cols)
