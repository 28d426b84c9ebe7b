"""Tokens as columns: splitting, stripping, stemming, related terms, and the costs and measures of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words

#: White space as the standard has it, and the four separators below the space.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

#: The stem of a word w, the first rule that holds; SQL that both Spark and the tests' engine read.
STEM = """case
  when length(w) < 4 then w
  when w like '%ies' and length(w) > 4 then left(w, length(w) - 3) || 'y'
  when w like '%ied' and length(w) > 4 then left(w, length(w) - 3) || 'y'
  when w like '%sses' then left(w, length(w) - 2)
  when w like '%ion' and length(w) > 5 and substr(w, length(w) - 4, 2) in ('ct', 'ss', 'pt') then left(w, length(w) - 3)
  when w like '%ing' and length(w) > 5 then left(w, length(w) - 3)
  when w like '%edly' and length(w) > 6 then left(w, length(w) - 4)
  when w like '%ingly' and length(w) > 7 then left(w, length(w) - 5)
  when w like '%ed' and length(w) > 4 and substr(w, length(w) - 2, 1) not in ('a', 'e', 'i', 'o', 'u') then
    case when substr(w, length(w) - 2, 1) = 'v' or substr(w, length(w) - 3, 2) in ('ch', 'sh', 'th') then left(w, length(w) - 1) else left(w, length(w) - 2) end
  when w like '%ly' and length(w) > 4 then left(w, length(w) - 2)
  when w like '%s' and length(w) > 3 and right(w, 2) not in ('ss', 'us', 'is', 'os') then left(w, length(w) - 1)
  else w end"""


def split_words(c: Column, space: str = SPACE) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), space), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(split_words(c))


def spread(df: DataFrame, key: str) -> DataFrame:
    """df, dealt by a key where it comes from fewer files than there are cores, as one small file does; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if len(df.inputFiles()) < cores else df


def terms(df: DataFrame, keys: list[str], fields: list[str], space: str = SPACE) -> DataFrame:
    """(keys, field, token), repeats included: words are exploded, each once a text, so that stemming stays in generated code."""
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("body")) for f in fields])).alias("f")
    raw = spread(df.select(*keys, *[f for f in fields if f not in keys]), keys[-1]).select(*keys, each).select(*keys, "f.field", F.explode(F.array_distinct(split_words(F.col("f.body"), space))).alias("w"))
    clean = raw.withColumn("w", F.lower(F.btrim("w", F.lit(words.PUNCTUATION)))).where((F.length("w") > 2) & ~F.col("w").isin(*words.STOP))
    stem = clean.select(*keys, "field", F.expr(STEM).alias("token"))
    table = F.create_map(*[x for k, v in words.RELATED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    # one pass for stems and related terms; the table is looked into only for words that stand in it
    more = F.when(F.col("token").isin(*words.RELATED), F.concat(F.array("token"), table[F.col("token")])).otherwise(F.array("token"))
    return stem.select(*keys, "field", F.explode(more).alias("token"))


def postings(df: DataFrame, keys: list[str], fields: list[str], space: str = SPACE) -> DataFrame:
    """(keys, field, token), each once."""
    return terms(df, keys, fields, space).distinct()


def row_tokens(df: DataFrame, fields: list[str], space: str = SPACE) -> DataFrame:
    """df with an array of each field's tokens, each once, in place of the field: what postings() gives, without leaving the row."""
    table = F.create_map(*[x for k, v in words.RELATED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = lambda t: F.when(t.isin(*words.RELATED), F.concat(F.array(t), table[t])).otherwise(F.array(t))
    for f in fields:
        df = df.withColumn(f, F.array_distinct(F.transform(F.array_distinct(split_words(F.col(f).cast("string"), space)), lambda x: F.lower(F.btrim(x, F.lit(words.PUNCTUATION))))))
        df = df.withColumn(f, F.filter(f, lambda x: (F.length(x) > 2) & ~x.isin(*words.STOP)))
        df = df.withColumn(f, F.expr(f"transform(`{f}`, w -> {STEM})"))
        df = df.withColumn(f, F.array_distinct(F.flatten(F.transform(f, more))))
    return df


def row_flags(df: DataFrame, space: str = SPACE) -> DataFrame:
    """(project, id, token, in_what), each token once a row of df: project, id, what, why. Nothing is exchanged, and a task holds one row's tokens at a time."""
    rows = row_tokens(spread(df.select("project", "id", "what", "why"), "id"), ["what", "why"], space)
    flag = lambda c, n: F.transform(c, lambda x: F.struct(x.alias("token"), F.lit(n).alias("in_what")))
    return rows.select("project", "id", F.explode(F.concat(flag(F.col("what"), 1), flag(F.array_except("why", "what"), 0))).alias("x")).select("project", "id", "x.token", "x.in_what")


def guard_tokens(c: Column) -> Column:
    """Words for duplicates: stop words and length are tested before stripping."""
    w = F.filter(split_words(F.lower(c)), lambda x: ~x.isin(*words.GUARD_STOP) & (F.length(x) > 2))
    return F.array_distinct(F.transform(w, lambda x: F.btrim(x, F.lit(".,!?"))))


def side_tokens(c: Column) -> Column:
    """Words for contradictions: length is tested after stripping."""
    w = F.filter(split_words(c), lambda x: ~x.isin(*words.GUARD_STOP))
    return F.array_distinct(F.filter(F.transform(w, lambda x: F.btrim(x, F.lit(".,!?"))), lambda x: F.length(x) > 2))


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(common / F.greatest(F.size(a) + F.size(b) - common, F.lit(1)))


def cost(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / words.CHARS)).cast("long")


def category(reason: Column) -> Column:
    """What a reason begins with, up to the first colon, dash or bracket."""
    return F.substring(F.trim(F.split(reason, "[:—(]", 2)[0]), 1, 80)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def vague_snapshot(c: Column) -> Column:
    parts = F.greatest(F.size(F.split(c, ",")), F.size(F.split(c, "/")))
    return (parts < 2) & (F.length(F.trim(c)) < 10)
