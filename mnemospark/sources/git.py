"""Commits and file trees, from a repository on the driver or from the text of a log."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The framing of a log, and the most names of a tree that are listed.
FORMAT, FIELD, RECORD, MOST = "%H%x1f%B%x1e", "\x1f", "\x1e", 40


def run(args: list[str], repo: str | None = None) -> str:
    done = subprocess.run(["git", *args], cwd=repo, capture_output=True, text=True, check=False)
    return done.stdout if done.returncode == 0 else ""


def framed(spark: SparkSession, path: str) -> DataFrame:
    """(sha, message) of a log that was written with FORMAT, at any size: records are split by Spark's reader."""
    t = spark.read.text(path, lineSep=RECORD).where(F.btrim("value", F.lit(" \n")) != "")
    return t.select(F.trim(F.split_part("value", F.lit(FIELD), F.lit(1)), F.lit("\n ")).alias("sha"), F.split_part("value", F.lit(FIELD), F.lit(2)).alias("message"))


def log(spark: SparkSession, n: int = 50, repo: str | None = None) -> DataFrame:
    rows = [r.strip().split(FIELD, 1) for r in run(["log", f"-{n}", f"--format={FORMAT}"], repo).split(RECORD) if FIELD in r]
    return spark.createDataFrame([tuple(r) for r in rows], "sha string, message string")


def message(sha: str, repo: str | None = None) -> str:
    return run(["show", "-s", "--format=%B", sha], repo)


def tree(repo: str | None = None) -> str:
    names = sorted(run(["ls-tree", "--name-only", "HEAD"], repo).split())[:MOST]
    return ", ".join(names) or "(empty tree)"


def project(repo: str | None = None) -> str:
    return os.path.basename(run(["rev-parse", "--show-toplevel"], repo).strip() or os.path.abspath(repo or "."))
