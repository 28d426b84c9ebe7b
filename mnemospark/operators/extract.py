"""Decisions out of commit messages: gates in a fixed order, and their calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import words
from ..functions.text import split_words, word_count

CUE = r"(?i)\b(?:" + "|".join(sorted(words.CUES, key=lambda c: (-len(c), c))) + r")\b"


def parse(raw: DataFrame, column: str = "message") -> DataFrame:
    """Adds subject, body and ctype."""
    text = F.regexp_replace(F.coalesce(F.col(column), F.lit("")), "\r\n", "\n")
    lines = F.split(text, "\n", 2)
    out = raw.withColumn("subject", F.trim(lines[0])).withColumn("body", F.trim(F.regexp_replace(F.coalesce(F.get(lines, F.lit(1)), F.lit("")), r"^\s+|\s+$", "")))
    return out.withColumn("ctype", F.nullif(F.regexp_extract("subject", words.CONVENTIONAL, 1), F.lit("")))


def gates(commits: DataFrame) -> DataFrame:
    """Adds what, why, and status: 'candidate', or the gate that a commit failed at: type_gate, no_cue, too_thin."""
    what = F.trim(F.when(F.col("ctype").isNotNull(), F.regexp_extract("subject", words.CONVENTIONAL, 2)).otherwise(F.col("subject")))
    blocks = F.filter(F.transform(F.split("body", r"\n\s*\n"), lambda b: F.array_join(split_words(b), " ")), lambda b: b != "")
    c = commits.withColumn("what", what).withColumn("para", F.coalesce(F.get(blocks, F.lit(0)), F.lit("")))
    cue = F.col("what").rlike(CUE)
    c = c.withColumn("why", F.when(F.col("para") != "", F.col("para")).when(cue, F.col("what")).otherwise(""))
    few = word_count(F.col("what")) < words.LEAST_WORDS
    status = (
        F.when(F.col("subject").rlike(words.MERGE) | F.col("what").rlike(words.VERSION), "type_gate")
        .when(F.col("ctype").isNotNull() & ~F.col("ctype").isin(*words.TYPES), "type_gate")
        .when(F.col("ctype").isNull() & few, "type_gate")
        .when(~(cue | F.col("body").rlike(CUE)), "no_cue")
        .when(few | (word_count(F.col("why")) < words.LEAST_WORDS), "too_thin")
        .otherwise("candidate")
    )
    return c.withColumn("status", status).drop("para")


def calibrate(gated: DataFrame) -> DataFrame:
    """One row: total, passed, pass_rate, verdict, and the number of skips by gate."""
    t = gated.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "candidate").alias("passed"), *[F.count_if(F.col("status") == s).alias(s) for s in ("type_gate", "no_cue", "too_thin")])
    rate = F.coalesce(F.col("passed") / F.nullif("total", F.lit(0)), F.lit(0.0))
    verdict = F.when(F.col("total") == 0, "EMPTY").when(rate > 0.40, "TOO_BROAD").when(rate >= 0.15, "OK").otherwise("TOO_NARROW")
    return t.withColumn("pass_rate", rate).withColumn("verdict", verdict)
