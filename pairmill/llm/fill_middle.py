"""Fill-in-the-middle: a text is cut in prefix, middle and suffix, which change places around markers.

DuckDB works inside mapInArrow: each bounded slice of a batch is registered as a view, and two
SQL statements cut the texts and put them back, so Python handles no row. Code points are
matched left to right in pieces of PIECE (`regexp_extract_all`), whole pieces are taken with
`list_slice` and joined with `array_to_string`, and only the piece that holds a cut is matched
again code point by code point: a text needs a list of n / PIECE entries, not n. Cuts and forms
come from the sha256 of the seed and the id, so reruns and any partitioning agree, and a lost
executor costs its slices only. No shuffle.

Defined cases. A null text is an empty one; an empty text, and one that holds a marker, is given
back as it is (`plain`). A null id is hashed as the empty string. Repeated rows are cut alike. No
rows: no rows. Other columns, whatever their names, aren't looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairmill.llm import units

#: Code points that are matched at once.
PIECE = 50


@dataclass(frozen=True)
class Recipe:
    """Percentages of texts: `plain` of all stay as they are, `spm` of the others begin with the
    suffix. The markers must be such that none can begin inside another."""

    seed: int = 1
    plain: int = 10
    spm: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cut_sql(r: Recipe, source: str) -> str:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of `source` (doc_id, text)."""
    part = lambda i: f"('0x' || substr(h, {8 * i - 7}, 8))::UBIGINT"
    k = PIECE
    chars = lambda at: f"coalesce(regexp_extract_all(u[{at} // {k} + 1], '(?s).'), [])"
    some = lambda xs, i, j: f"array_to_string(list_slice({xs}, {i}, {j}), '')"
    p, s, m = _q(r.prefix), _q(r.suffix), _q(r.middle)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{r.seed}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM {source}),
f AS (SELECT doc_id, t, h, CASE WHEN t = '' OR contains(t, {p}) OR contains(t, {s}) OR contains(t, {m}) OR {part(3)} % 100 >= {100 - r.plain} THEN 'plain'
  WHEN {part(4)} % 100 < {r.spm} THEN 'spm' ELSE 'psm' END AS form, regexp_extract_all(t, '(?s).{{1,{k}}}') AS u FROM t),
n AS (SELECT *, CASE WHEN len(u) = 0 THEN 0 ELSE (len(u) - 1) * {k} + len(regexp_extract_all(u[len(u)], '(?s).')) END::BIGINT AS n FROM f),
c AS (SELECT *, least({part(1)} % (n + 1), {part(2)} % (n + 1))::BIGINT AS a, greatest({part(1)} % (n + 1), {part(2)} % (n + 1))::BIGINT AS b FROM n),
x AS (SELECT doc_id, n, form, t, a, b,
  CASE WHEN form <> 'plain' THEN {some("u", 1, f"a // {k}")} || {some(chars("a"), 1, f"a % {k}")} END AS prefix,
  CASE WHEN form = 'plain' THEN NULL WHEN a // {k} = b // {k} THEN {some(chars("a"), f"a % {k} + 1", f"b % {k}")}
    ELSE {some(chars("a"), f"a % {k} + 1", k)} || {some("u", f"a // {k} + 2", f"b // {k}")} || {some(chars("b"), 1, f"b % {k}")} END AS middle,
  CASE WHEN form <> 'plain' THEN {some(chars("b"), f"b % {k} + 1", k)} || {some("u", f"b // {k} + 2", "len(u)")} END AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {p} || prefix || {s} || suffix || {m} || middle ELSE {s} || suffix || {p} || prefix || {m} || middle END AS output FROM x"""


def restore_sql(r: Recipe, source: str) -> str:
    """The columns of `source` and `restored`, the text rebuilt from `output` and `form` alone."""
    p, s, m = _q(r.prefix), _q(r.suffix), _q(r.middle)
    lp, ls, lm = len(r.prefix), len(r.suffix), len(r.middle)
    between = lambda x, y, n: f"substr(output, {x} + {n}, {y} - {x} - {n})"
    return f"""
WITH w AS (SELECT *, strpos(output, {p}) AS ip, strpos(output, {s}) AS i_s, strpos(output, {m}) AS im FROM {source})
SELECT * EXCLUDE (ip, i_s, im), CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {between("ip", "i_s", lp)} || substr(output, im + {lm}) || {between("i_s", "im", ls)}
  ELSE {between("ip", "im", lp)} || substr(output, im + {lm}) || {between("i_s", "ip", ls)} END AS restored FROM w"""


_FACTS = "n long, form string, prefix_chars long, middle_chars long"


def _run(recipe: Recipe, texts: bool):
    wanted = "output, restored" if texts else "sha256(output) AS output_sha256, sha256(restored) AS restored_sha256"
    statement = f"WITH made AS MATERIALIZED ({cut_sql(recipe, 'docs')}) SELECT doc_id, n, form, prefix_chars, middle_chars, {wanted} FROM ({restore_sql(recipe, 'made')})"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = duckdb.connect(config={"threads": 1, "temp_directory": "", "preserve_insertion_order": True})
        try:
            for batch in batches:
                for part in units.slices(batch, 1):
                    con.register("docs", pa.Table.from_batches([part]))
                    made = con.sql(statement).to_arrow_table()
                    con.unregister("docs")
                    yield from made.combine_chunks().to_batches()
        finally:
            con.close()

    return run


def fill_middle(docs: DataFrame, recipe: Recipe = Recipe(), id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output, restored), one row per document;
    without `texts`, the hex sha256 of both instead of them, so no text leaves the worker."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tail = "output string, restored string" if texts else "output_sha256 string, restored_sha256 string"
    return units.bounded_batches(rows).mapInArrow(_run(recipe, texts), f"doc_id {kind}, {_FACTS}, {tail}")
