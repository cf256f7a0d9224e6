"""Table, CSV and JSON Lines sources. Every source can add `_ord`, the position in the input."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalogq.operators.head import not_after
from catalogq.operators.topk import first_n
from catalogq.plans.compare import Table
from catalogq.session import materialize


LARGE_CSV = 1 << 30
# Fixed value: bytes of the longest line of JSON Lines that is read; longer ones count as invalid rows.
LONGEST_LINE = 20 * 1024 * 1024


def input_position() -> Column:
    """Order of a file source: file, then split, then row inside the split."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_csv(spark: SparkSession, path: str, multi_line: bool = True, newlines: bool = False) -> DataFrame:
    """Header row, every cell text, empty cells '', and `_ord`.

    Of columns with the same name the last one counts, in the place of the first. Short rows are padded, extra fields dropped, blank lines skipped, a byte order mark
    is ignored. Cells may hold line breaks, which ties each file to one task: write
    large inputs as many files, or pass multi_line=False when no cell holds one.
    `newlines` turns every line break inside a cell into a plain one.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )

    def cell(name: str) -> Column:
        text = F.coalesce(F.col(f"`{name}`"), F.lit(""))
        return (F.regexp_replace(text, "\r\n?", "\n") if newlines else text).alias(name)

    header = _header(spark, path, raw.columns)
    last = {name: column for name, column in zip(header, raw.columns)}
    return raw.select(*[cell(column).alias(name) for name, column in last.items()], input_position().alias("_ord"))


def _header(spark: SparkSession, path: str, columns: Sequence[str]) -> list[str]:
    """The names as the header row spells them; Spark numbers repeated ones."""
    if not any(re.search(r"\d$", c) for c in columns):
        return list(columns)
    plain = spark.read.option("quote", '"').option("escape", '"').option("multiLine", True)
    first = plain.csv(path).limit(1).first()
    names = [(x or "").lstrip("\ufeff") for x in first] if first else []
    same = len(names) == len(columns) and all(c == n or c.startswith(n) for c, n in zip(columns, names))
    return [n or c for c, n in zip(columns, names)] if same else list(columns)


def _largest_file(spark: SparkSession, path: str) -> int:
    """Bytes of the largest file; only the listing is read."""
    files = spark.read.format("binaryFile").load(path).select("length")
    return files.agg(F.max("length").alias("n")).first()["n"] or 0


def _refuse_open_quotes(spark: SparkSession, path: str) -> None:
    """Raise if a line holds an odd number of quotes: its cell goes on in the next line, or its quote is broken."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    broken = spark.read.text(path).where(quotes % 2 == 1).select(F.col("_metadata.file_name").alias("file"), "value").limit(1).first()
    if broken is not None:
        raise ValueError(
            f"{broken['file']}: a quote is not closed on its line ({broken['value'][:60]!r}); "
            "read cells with line breaks with multi_line=True, and large inputs of that kind as many files"
        )


def csv_table(spark: SparkSession, path: str, multi_line: bool | None = None) -> Table:
    """A CSV input to compare(); parsed once, since the comparison reads it several times.

    Cells may hold line breaks, which ties each file to one task. Files beyond LARGE_CSV bytes are
    therefore split at lines instead; that is refused, with the place, where a quote is open at the
    end of a line. multi_line says which way to go whatever the size.
    """
    if multi_line is None:
        multi_line = _largest_file(spark, path) <= LARGE_CSV
    if not multi_line:
        _refuse_open_quotes(spark, path)
    return Table(materialize(read_csv(spark, path, multi_line), "csv"), ["_ord"], path=path)


def read_table(spark: SparkSession, path: str, identifier: str | None = None) -> DataFrame:
    """A Parquet table; the id column must exist."""
    df = spark.read.parquet(path)
    if identifier and identifier not in df.columns:
        raise ValueError(f"id column {identifier!r} not found in {path}")
    return df


def first_table(spark: SparkSession, database: str) -> str:
    """The first table of a database by name."""
    names = sorted(t.name for t in spark.catalog.listTables(database) if not t.isTemporary)
    if not names:
        raise ValueError(f"no tables in {database}")
    return f"{database}.{names[0]}"


def parquet_table(spark: SparkSession, path: str, order: Sequence[str] = (), columns: Sequence[str] = ()) -> Table:
    """A Parquet input to compare(), ordered by a key or by its position in the files."""
    df = spark.read.parquet(path)
    if order:
        return Table(df, list(order), columns, path)
    names = list(columns) or df.columns
    position = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return Table(df.select(*names, position.alias("_ord")), ["_ord"], names, path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _ord): the lines of text files."""
    return spark.read.text(path).select("value", input_position().alias("_ord"))


def parse_lines(lines: DataFrame) -> DataFrame:
    """(_ord, doc, valid): the non-blank lines as variants.

    A JSON object is valid, and so is a bare null, which reads as a row without values.
    Anything else, or text that is not JSON, is invalid, and so is a line of more than LONGEST_LINE
    bytes, which is not parsed.

    The document comes out of a one-element explode, which the optimizer does not move
    filters across: as a plain column it would be parsed again for every filter on it.
    """
    text = F.ltrim("value", F.lit(" \t\r\n"))
    parsed = F.when(F.octet_length("value") <= LONGEST_LINE, F.try_parse_json("value"))
    docs = lines.where(text != "").select(
        "_ord", F.substring(text, 1, 1).alias("_first"), F.explode(F.array(parsed)).alias("doc")
    )
    # Text that parses and opens with a brace is an object.
    valid = F.col("doc").isNotNull() & ((F.col("_first") == "{") | F.is_variant_null("doc"))
    return docs.select("_ord", "doc", F.coalesce(valid, F.lit(False)).alias("valid"))


def limit_valid(docs: DataFrame, limit: int) -> DataFrame:
    """The lines up to and including the limit-th valid one (0: all)."""
    if limit <= 0:
        return docs
    valid = docs.where("valid").select("_ord")
    last = first_n(valid, [F.col("_ord")], limit).agg(F.max("_ord").alias("_ord"), F.count("*").alias("rows")).first()
    return docs if last["rows"] < limit else docs.where(not_after(docs, ["_ord"], last))


def line_counts(docs: DataFrame) -> DataFrame:
    """One row: source rows (non-blank lines) and invalid rows."""
    return docs.agg(
        F.count("*").alias("source_rows"), F.count_if(~F.col("valid")).alias("invalid_rows")
    )
