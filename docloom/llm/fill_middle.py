"""Fill-in-middle documents: DuckDB over each Arrow batch of a map.

A text is cut into tokens (a run of other characters with the white space before it, or white space
at the end); two hashed places cut it into prefix, middle and suffix, a third and fourth hash
choose the form. One SQL statement does that for a whole batch, which is registered as a view; it returns
Arrow, and no row passes through Python. A document depends on its id and text alone: one map,
no shuffle, the same result after a lost executor.

Forms: plain, the text as it is; psm, prefix, suffix, middle; spm, suffix, prefix, middle, with a
marker before each part.

Defined cases: a null text counts as empty; an empty text, and one that holds a marker, is plain; a
null id hashes as an empty one; repeated rows give repeated results; an empty table gives an empty
result; further columns are ignored. DuckDB works in memory alone, on one thread for each task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import map_batches

# The markers before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"

_SQL = """
with cut as (
  select id, s, w, len(w) as n, cast('0x' || h[1:8] as ubigint) as h1, cast('0x' || h[9:16] as ubigint) as h2,
         cast('0x' || h[17:24] as ubigint) as h3, cast('0x' || h[25:32] as ubigint) as h4
  from (select id, coalesce(text, '') as s, regexp_extract_all(coalesce(text, ''), '{token}') as w, sha256(concat('{seed}:', id)) as h from batch)),
form as (
  select id, s, w, n, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as z,
         case when s = '' or contains(s, '{p}') or contains(s, '{s}') or contains(s, '{m}') or h3 % 100 >= {share} then 'plain' when h4 % 100 < {spm} then 'spm' else 'psm' end as form
  from cut),
part as (
  select id, s, n, form, case when form <> 'plain' then array_to_string(list_slice(w, 1, a), '') end as prefix,
         case when form <> 'plain' then array_to_string(list_slice(w, a + 1, z), '') end as middle,
         case when form <> 'plain' then array_to_string(list_slice(w, z + 1, n), '') end as suffix
  from form)
select id, cast(n as bigint) as n, form, cast(length(prefix) as bigint) as prefix_chars, cast(length(middle) as bigint) as middle_chars, o as output, sha256(o) as output_sha256
from (select *, case form when 'plain' then s when 'psm' then '{p}' || prefix || '{s}' || suffix || '{m}' || middle else '{s}' || suffix || '{p}' || prefix || '{m}' || middle end as o from part)
"""


def _transformed(sql: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for batch in batches:
                con.register("batch", pa.Table.from_batches([batch]))
                yield from con.sql(sql).to_arrow_table().combine_chunks().to_batches()
                con.unregister("batch")

    return run


def fill_middle(docs: DataFrame, seed: int | str = 42, share: int = 50, spm: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (tokens), form, prefix_chars, middle_chars, output, output_sha256 for each row of docs.
    share: percent of the texts that are cut; spm: percent of these in form spm."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    sql = _SQL.format(token=TOKEN, seed=seed, p=PREFIX, s=SUFFIX, m=MIDDLE, share=share, spm=spm)
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, _transformed(sql), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")


def restored(output: Column, form: Column) -> Column:
    """The text of which an output was made."""
    parts = F.split(F.substr(output, F.lit(1 + len(PREFIX))), "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))), -1)
    return F.when(form == "psm", F.concat(parts[0], parts[2], parts[1])).when(form == "spm", F.concat(parts[1], parts[2], parts[0])).otherwise(output)
