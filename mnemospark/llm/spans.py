"""Places of regular-expression matches in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sums over so many matches at a time, so that texts with very many matches stay cheap.
BLOCK = 64


def matches(text: str, pattern: str, needs: Column) -> tuple[Column, Column]:
    """(gaps, found) of a text column: found are the leftmost non-overlapping matches, gaps[i] stands before found[i].

    `needs` is a cheap condition without which there is no match; the pattern must not match an empty string.
    """
    none = F.expr("cast(array() as array<string>)")
    gaps = F.when(needs, F.split(F.col(text), pattern, -1)).otherwise(none)
    found = F.when(needs, F.expr(f"regexp_extract_all({text}, '{pattern.replace(chr(92), chr(92) * 2).replace(chr(39), chr(92) + chr(39))}', 0)")).otherwise(none)
    return gaps, found


def starts(gaps: str, found: str) -> Column:
    """The start of each match in code points: running sums over blocks, then within each block."""
    return F.expr(f"""
      transform(
        array(transform({found}, (m, i) -> length({gaps}[i]) + if(i > 0, length({found}[i - 1]), 0))),
        steps -> transform(
          array(transform(sequence(0, cast(ceil(size(steps) / {BLOCK}d) as int)),
                          b -> aggregate(slice(steps, b * {BLOCK} + 1, {BLOCK}), 0L, (s, x) -> s + x))),
          sums -> transform(
            array(transform(sums, (x, b) -> aggregate(slice(sums, 1, b), 0L, (s, y) -> s + y))),
            before -> transform(steps, (x, i) ->
              before[cast(floor(i / {BLOCK}) as int)] + aggregate(slice(steps, cast(floor(i / {BLOCK}) as int) * {BLOCK} + 1, i % {BLOCK} + 1), 0L, (s, y) -> s + y)))[0])[0])[0]
    """)


def joined(spans: Column) -> Column:
    """kind:start:end of each struct of an array, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
