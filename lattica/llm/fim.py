"""Fill-in-middle transformation by DuckDB inside ``mapInArrow``.

Every Arrow batch is registered with an in-memory DuckDB of its task, which cuts the texts into tokens, draws the
two cuts and the form from a digest of the id, and hands Arrow back; Python sees no row. Nothing is exchanged.

A text is cut into tokens, each a word with the blanks before it (blanks at the end are a token of their own). The
first four groups of eight digits of the hex SHA-256 of ``seed:id`` are numbers: two of them cut the tokens into
prefix, middle and suffix, one says whether the text stays plain, one whether the suffix leads (``spm``) or the
prefix (``psm``). A text that holds one of the markers stays plain, so the exact text comes back from every output.

Defined cases: a null or empty text has no tokens and is plain, with an empty output; a null id counts as an empty
one, in the digest as well; equal rows give equal rows; blanks alone are one token; a text may be as long as a
batch's memory lets (DuckDB takes ``MEMORY`` a task at most: some 50 MB of one text); an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: What a task's DuckDB may hold; it never spills to a folder of its own.
MEMORY = "1GB"

TRANSFORMED_DDL = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
RESTORED_DDL = f"{TRANSFORMED_DDL}, restored string"


def _joined(first: str, last: str) -> str:
    return f"array_to_string(list_slice(tokens, {first}, {last}), '')"


def transform_sql(source: str, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> str:
    """DuckDB SQL over a table with ``doc_id`` and ``text``."""
    digits = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    marked = " OR ".join(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return f"""
WITH digested AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM {source}
), drawn AS (
  SELECT doc_id, text, regexp_extract_all(text, '{TOKEN}') AS tokens, {digits} FROM digested
), formed AS (
  SELECT doc_id, text, tokens, len(tokens) AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS low, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS high,
         CASE WHEN text = '' OR {marked} OR h3 % 100 >= {fim_percent} THEN 'plain' WHEN h4 % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM drawn
), cut AS (
  SELECT doc_id, text, n, form, CASE WHEN form <> 'plain' THEN {_joined("1", "low")} END AS prefix,
         CASE WHEN form <> 'plain' THEN {_joined("low + 1", "high")} END AS middle, CASE WHEN form <> 'plain' THEN {_joined("high + 1", "n")} END AS suffix FROM formed
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(n AS BIGINT) AS n, form, CAST(length(prefix) AS BIGINT) AS prefix_chars, CAST(length(middle) AS BIGINT) AS middle_chars,
       CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
                 ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END AS output FROM cut"""


def restore_sql(source: str) -> str:
    """DuckDB SQL that adds ``restored``, the text rebuilt from ``output`` and ``form`` alone."""
    after = f"split_part(substr(output, {len(PREFIX) + 1}), CASE form WHEN 'psm' THEN '{SUFFIX}' ELSE '{PREFIX}' END, "
    return f"""
WITH parted AS (SELECT *, {after}1) AS lead, {after}2) AS tail FROM {source}
), named AS (
  SELECT *, CASE form WHEN 'psm' THEN lead ELSE split_part(tail, '{MIDDLE}', 1) END AS prefix, split_part(tail, '{MIDDLE}', 2) AS middle,
         CASE form WHEN 'psm' THEN split_part(tail, '{MIDDLE}', 1) ELSE lead END AS suffix FROM parted
)
SELECT doc_id, n, form, prefix_chars, middle_chars, output, CASE form WHEN 'plain' THEN output ELSE prefix || middle || suffix END AS restored FROM named"""


def _by_duckdb(df: DataFrame, sql: str, ddl: str) -> DataFrame:
    """``sql`` over every batch as table ``batch``, one DuckDB a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""}) as own:
            for part in batches:
                if part.num_rows:
                    own.register("batch", pa.Table.from_batches([part]))
                    yield from own.sql(sql).to_arrow_table().to_batches()
                    own.unregister("batch")

    return df.mapInArrow(run, ddl)


def transform(documents: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: a row per document, lengths null for plain ones."""
    slim = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return _by_duckdb(slim, transform_sql("batch", seed, fim_percent, spm_percent), TRANSFORMED_DDL)


def restore(transformed: DataFrame) -> DataFrame:
    """Adds ``restored``, the exact text of every row of ``transform``, read back from its output and form."""
    return _by_duckdb(transformed, restore_sql("batch"), RESTORED_DDL)


def digest(restored: DataFrame) -> DataFrame:
    """Output and restored text as SHA-256 in lowercase hex."""
    hashed = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return restored.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)
