"""Fill-in-the-middle transformation: DuckDB takes each Arrow batch as a table and cuts, orders and hashes texts in SQL.

A text is cut into units, a word with the white space before it each, what is left at the end being one more. Two hashes of the
seed and the row's id choose where the middle lies, a third whether the text is turned at all, a fourth in which order its
parts stand: prefix, suffix, middle (psm) or suffix, prefix, middle (spm), behind markers. restore() rebuilds a text from
output and form alone. No row is touched in Python: batches are sliced by bytes, registered, queried and handed back.

Defined results: a null text is an empty one, and that is plain, as are texts that hold a marker; a null id hashes as an empty
one; rows that share an id get the same hashes, equal rows equal results; texts of any length are taken whole, one to a
slice where they exceed SLICE; an empty table gives no rows; columns but the id and the text are not looked at, and may have
any names. Every row is done on its own, so lost executors cost nothing but their rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space separates; both are the contract's own.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MARKERS = ("<P>", "<S>", "<M>")
SEED, PLAIN_FROM, SPM_BELOW = 42, 50, 80
#: Bytes of text that DuckDB gets at a time, and the memory that it may take for them besides the strings that come back.
SLICE, MEMORY = 4 << 20, "1GB"


def cut_sql(seed: int, plain_from: int, spm_below: int) -> str:
    """doc_id, text, n, form, prefix, middle, suffix of a table `batch` (doc_id, text)."""
    p, s, m = MARKERS
    h = lambda i: f"('0x' || substr(h, {8 * i + 1}, 8))::ubigint"
    part = lambda a, b: f"array_to_string(list_slice(units, {a}, {b}), '')"
    return f"""
      with u as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{UNIT}') as units, sha256('{seed}:' || coalesce(doc_id::varchar, '')) as h from batch),
      d as (select doc_id, text, units, len(units)::bigint as n, {h(0)} as h1, {h(1)} as h2, {h(2)} as h3, {h(3)} as h4 from u),
      c as (select *, least(h1 % (n + 1)::ubigint, h2 % (n + 1)::ubigint)::bigint as a, greatest(h1 % (n + 1)::ubigint, h2 % (n + 1)::ubigint)::bigint as b,
        case when text = '' or contains(text, '{p}') or contains(text, '{s}') or contains(text, '{m}') or h3 % 100 >= {plain_from} then 'plain'
          when h4 % 100 < {spm_below} then 'spm' else 'psm' end as form from d)
      select doc_id, text, n, form, case when form <> 'plain' then {part('1', 'a')} end as prefix, case when form <> 'plain' then {part('a + 1', 'b')} end as middle,
        case when form <> 'plain' then {part('b + 1', 'n')} end as suffix from c"""


def output_sql() -> str:
    p, s, m = MARKERS
    return f"case form when 'psm' then '{p}' || prefix || '{s}' || suffix || '{m}' || middle when 'spm' then '{s}' || suffix || '{p}' || prefix || '{m}' || middle else text end"


def restore_sql() -> str:
    """The text, from output and form alone: no marker stands in the parts, so each is found where it was put."""
    p, s, m = MARKERS
    tail = f"substr(output, {len(s) + 1})"
    one, two, three = (f"split_part(split_part({tail}, '{m}', 1), '{{0}}', 1)", f"split_part(split_part({tail}, '{m}', 1), '{{0}}', 2)", f"split_part({tail}, '{m}', 2)")
    return f"case form when 'psm' then {one.format(s)} || {three} || {two.format(s)} when 'spm' then {two.format(p)} || {three} || {one.format(p)} else output end"


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have at most SLICE bytes together, or one row that alone has more."""
    i = b.schema.get_field_index("text")
    at = np.cumsum(pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < b.num_rows:
        before = int(at[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(at, before + SLICE, side="right")))
        yield b.slice(start, stop - start)
        start = stop


def _through(sql: str):
    """A function for mapInArrow that runs SQL over each slice of each batch, as table `batch`, in one connection a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # one thread, and no folder to spill to: a slice is small enough to be held
        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        try:
            for b in batches:
                for part in _slices(b):
                    con.register("batch", pa.Table.from_batches([part]))
                    yield from con.execute(sql).to_arrow_table().to_batches()
                    con.unregister("batch")
        finally:
            con.close()

    return run


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    quoted = lambda c: F.col("`{}`".format(c.replace("`", "``")))
    return docs.select(quoted(key).cast("long").alias("doc_id"), quoted(text).cast("string").alias("text"))


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output, the text as a model is to read it, of every row."""
    sql = f"select doc_id, n, form, length(prefix)::bigint as prefix_chars, length(middle)::bigint as middle_chars, {output_sql()} as output from ({cut_sql(seed, plain_from, spm_below)})"
    return _rows(docs, key, text).mapInArrow(_through(sql), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(outputs: DataFrame, key: str = "doc_id") -> DataFrame:
    """doc_id and text of every row of (doc_id, form, output)."""
    sql = f"select doc_id, {restore_sql().replace('output', 'text')} as text from batch"
    given = outputs.select(F.col(key).cast("long").alias("doc_id"), "form", F.col("output").alias("text"))
    return given.mapInArrow(_through(sql), "doc_id long, text string")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the sha256 of the output and of the text rebuilt from it; texts stay in the task."""
    made = f"select doc_id, n, form, length(prefix)::bigint as prefix_chars, length(middle)::bigint as middle_chars, {output_sql()} as output from ({cut_sql(seed, plain_from, spm_below)})"
    sql = f"select doc_id, n, form, prefix_chars, middle_chars, sha256(output) as output_sha256, sha256({restore_sql()}) as restored_sha256 from ({made})"
    return _rows(docs, key, text).mapInArrow(_through(sql), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string")


#: The digests over a table of documents, written down apart from the operator: places in code points, parts by substr.
ORACLE = r"""
with u as (select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') w, sha256('42:' || doc_id) h from documents),
n as (select doc_id, t, len(w)::bigint n, list_transform(w, lambda x: length(x)) l, list_transform([0, 1, 2, 3], lambda i: ('0x' || substr(h, 8 * i + 1, 8))::ubigint::bigint) h from u),
k as (select *, least(h[1] % (n + 1), h[2] % (n + 1)) a, greatest(h[1] % (n + 1), h[2] % (n + 1)) b,
  case when t = '' or regexp_matches(t, '<[PSM]>') or h[3] % 100 >= 50 then 'plain' when h[4] % 100 < 80 then 'spm' else 'psm' end form from n),
c as (select *, coalesce(list_sum(l[1:a]), 0)::bigint p, coalesce(list_sum(l[a + 1:b]), 0)::bigint m from k),
o as (select *, substr(t, 1, p) x, substr(t, p + 1, m) y, substr(t, p + m + 1) z from c)
select doc_id, n, form, case when form <> 'plain' then p end prefix_chars, case when form <> 'plain' then m end middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || x || '<S>' || z || '<M>' || y else '<S>' || z || '<P>' || x || '<M>' || y end) output_sha256, sha256(t) restored_sha256
from o
"""
