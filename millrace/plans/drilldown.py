"""The evidence behind a metric's value: pages in one order, with a cursor that names the place and the snapshot."""

from __future__ import annotations

import base64
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dimensions import carries
from ..functions.text import csv_safe
from ..operators.sequences import running_total

VERSION, PAGE, LARGEST_PAGE, EXPORT_ROWS = 1, 100, 250, 50_000
#: Most bytes of an export, and of one of its values.
EXPORT_BYTES, CELL_BYTES = 25 << 20, 32 << 10
#: The order of evidence: a page ends at such a key and the next begins after it.
KEY = ["metric_date", "entity_id", "source_key", "measure_key", "record_id"]


class CursorError(ValueError):
    """A cursor of another request or of a snapshot that is gone."""


def fingerprint(selection: dict) -> str:
    return hashlib.sha256(json.dumps(selection, sort_keys=True, default=str).encode()).hexdigest()


def write_cursor(selection: dict, snapshot_id: str, key: list[str]) -> str:
    return base64.urlsafe_b64encode(json.dumps({"v": VERSION, "f": fingerprint(selection), "s": snapshot_id, "k": key}).encode()).decode()


def read_cursor(cursor: str, selection: dict, snapshot_id: str) -> list[str]:
    try:
        x = json.loads(base64.urlsafe_b64decode(cursor.encode()))
        version, own, snapshot, key = x["v"], x["f"], x["s"], x["k"]
    except (ValueError, KeyError, TypeError) as e:
        raise CursorError("the cursor can't be read") from e
    if version != VERSION or own != fingerprint(selection) or len(key) != len(KEY):
        raise CursorError("the cursor belongs to another request")
    if snapshot != snapshot_id:
        raise CursorError("the data have changed since the cursor was made")
    return key


def _text_key() -> list[Column]:
    return [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in KEY]


def page(evidence: DataFrame, pairs: list[tuple[str, str]], filters: dict[str, list[str]] | None = None, after: list[str] | None = None, size: int = PAGE) -> DataFrame:
    """Up to size + 1 rows of the (source, measure) pairs after a key, in order: one row over the size tells that there is more."""
    if not 0 < size <= LARGEST_PAGE:
        raise ValueError(f"a page has between 1 and {LARGEST_PAGE} rows")
    rows = evidence.where(F.struct("source_key", "measure_key").isin([F.struct(F.lit(s).alias("source_key"), F.lit(m).alias("measure_key")) for s, m in pairs]))
    for key, values in (filters or {}).items():
        rows = rows.where(carries(F.col("dimensions"), key, values))
    if after:
        if after[0]:
            rows = rows.where(F.col("metric_date") >= F.lit(after[0]).cast("date"))  # for the scan; the whole key is compared below
        rows = rows.where(F.struct(*_text_key()) > F.struct(*[F.lit(v).alias(k) for k, v in zip(KEY, after, strict=True)]))
    return rows.orderBy(*_text_key()).limit(size + 1)


def ratio_by_day(evidence: DataFrame, numerator: list[str], denominator: list[str]) -> DataFrame:
    """entity_id, metric_date, numerator, denominator; null where a day has nothing on a side."""
    side = lambda m: F.sum(F.when(F.col("measure_key").isin(m), F.col("contribution")))
    rows = evidence.where(F.col("measure_key").isin([*numerator, *denominator]))
    return rows.groupBy("entity_id", "metric_date").agg(side(numerator).alias("numerator"), side(denominator).alias("denominator"))


class ExportLimit(ValueError):
    """An export with too many rows, too many bytes, or a value that is too long."""


_CSV = {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _cells(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[(csv_safe(F.col(c)) if kinds[c] == "string" else F.col(c)).alias(label) for c, label in labels.items()])


def _longest(labels: dict[str, str]) -> Column:
    return F.greatest(F.lit(0), F.lit(0), *[F.coalesce(F.octet_length(F.col(f"`{x}`").cast("string")), F.lit(0)) for x in labels.values()])


def _line_bytes(labels: dict[str, str]) -> Column:
    """Bytes of a row as a line of CSV, with its line feed."""
    return F.octet_length(F.to_csv(F.struct(*[F.col(f"`{x}`") for x in labels.values()]), _CSV)) + 1


def _header_bytes(labels: dict[str, str]) -> int:
    return sum(len(x.encode()) + 2 * (("," in x) or ('"' in x)) + x.count('"') for x in labels.values()) + len(labels)


def export_csv(df: DataFrame, path: str, labels: dict[str, str], rows: int = EXPORT_ROWS, size: int = EXPORT_BYTES, cell: int = CELL_BYTES) -> None:
    """Write labelled columns as CSV with a header; text cells can't be taken for formulas. More rows or bytes than allowed, or a longer value, are an error before anything is written."""
    out = _cells(df, labels)
    found = out.limit(rows + 1).agg(F.count("*").alias("n"), F.sum(_line_bytes(labels)).alias("bytes"), F.max(_longest(labels)).alias("longest")).first()
    if found["n"] > rows:
        raise ExportLimit(f"more than {rows} rows to export")
    if (found["longest"] or 0) > cell:
        raise ExportLimit(f"a value has more than {cell} bytes")
    if (found["bytes"] or 0) + _header_bytes(labels) > size:
        raise ExportLimit(f"more than {size} bytes to export")
    out.write.options(header=True, **_CSV).csv(path)


def within_budget(df: DataFrame, order: list[str], labels: dict[str, str], size: int = EXPORT_BYTES, cell: int = CELL_BYTES) -> DataFrame:
    """The rows of an export that fit into a number of bytes with its header, in order, ties only between equal rows: place, bytes up to here, and the cells.

    The first row over the budget or with a value over the limit and all after it are left out. Sums go range by range.
    """
    cells = _cells(df, labels)
    keyed = df.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(order)], *[(csv_safe(F.col(c)) if t == "string" else F.col(c)).alias(labels[c]) for c, t in df.dtypes if c in labels])
    cost = F.when(_longest(labels) > cell, F.lit(size + 1)).otherwise(_line_bytes(labels)).cast("long")
    summed = running_total(keyed, [f"__{i}" for i in range(len(order))], cost, "bytes", "place")
    return summed.where(F.col("bytes") + _header_bytes(labels) <= size).select("place", "bytes", *cells.columns)
