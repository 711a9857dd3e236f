"""Delimited text: quoted cells, records over line breaks, headers, and the way back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Quoted text up to its closing quote. The possessive forms never go back, so long texts are read once.
_INSIDE = r'"[^"]*+(?:""[^"]*+)*+'


def _record(separator: str) -> str:
    """Cells with separators between them, up to a line end; a quote opens a cell only at its beginning, and one that is never closed holds the rest of the text."""
    s = re.escape(separator)
    cell = rf'(?:{_INSIDE}(?:"|\z)[^{s}\r\n]*+|[^{s}\r\n]*+)'
    return rf"({cell}(?:{s}{cell})*+)(\r\n|\n|\r|\z)"


def records(text: Column, separator: str = ",") -> Column:
    """The records of a text. A line end closes the last one; the empty text has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_record(separator)), F.lit(1))
    return F.slice(found, F.lit(1), F.size(found) - 1)


def cells(record: Column, separator: str = ",") -> Column:
    """The cells of a record, quotes taken off and doubled ones made single; a last quote that isn't closed ends with the record."""
    s = re.escape(separator)
    unclosed = record.rlike(rf'^(?:(?:{_INSIDE}"[^{s}]*+|[^"{s}][^{s}]*+|){s})*+{_INSIDE}\z')
    record = F.when(unclosed, F.concat(record, F.lit('"'))).otherwise(record)
    found = F.regexp_extract_all(F.concat(record, F.lit(separator)), F.lit(f'("[^"]*+(?:""[^"]*+)*+"|[^{s}]*+){s}'), F.lit(1))
    plain = lambda c: F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))
    return F.transform(found, lambda c: F.when((F.length(c) > 1) & c.startswith('"') & c.endswith('"'), plain(c)).otherwise(c))


def parse_rows(texts: DataFrame, key: str, text: str, separator: str = ",") -> DataFrame:
    """key, row (from 0), cells of every record of each text; null texts have none."""
    out = texts.select(key, F.posexplode(records(F.col(text), separator)).alias("row", "record"))
    return out.select(key, F.col("row").cast("long").alias("row"), cells(F.col("record"), separator).alias("cells"))


def parse(texts: DataFrame, key: str, text: str, separator: str = ",") -> DataFrame:
    """key, row (from 0), name, value: cells under the names of each text's first record. A cell that a record lacks is null, further ones are left out."""
    parts = texts.select(key, F.transform(records(F.col(text), separator), lambda r: cells(r, separator)).alias("rows"))
    body = parts.where(F.size("rows") > 1).select(key, F.get("rows", F.lit(0)).alias("names"), F.posexplode(F.slice("rows", F.lit(2), F.size("rows"))).alias("row", "cells"))
    out = body.select(key, F.col("row").cast("long").alias("row"), F.posexplode("names").alias("at", "name"), "cells")
    return out.select(key, "row", "name", F.get("cells", F.col("at")).alias("value"))


def format_value(value: Column, separator: str = ",") -> Column:
    """A cell: quoted only where it holds the separator, a quote or a line end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike(f'["\r\n{re.escape(separator)}]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def format_row(values: list[Column], separator: str = ",") -> Column:
    """A record without its line end."""
    return F.concat_ws(separator, *(format_value(v, separator) for v in values))


def header(names: list[str], separator: str = ",") -> str:
    """The record of column names."""
    quoted = ('"' + n.replace('"', '""') + '"' if re.search(f'["\r\n{re.escape(separator)}]', n) else n for n in names)
    return separator.join(quoted)
