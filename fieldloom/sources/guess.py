r"""Column types guessed from text: a small lattice, joined by one mergeable aggregate.

Every cell is of the narrowest kind whose pattern it matches: whole number, number, date, time, truth value or text. The kinds of
a column are the bits of one ``bit_or``, so a table of any size and width needs one pass with map-side merging and
one row at the driver. The join of the kinds is the type:

    int < bigint < number < text        date < time < text        truth < text        nothing < everything

Fixed rules: a number with a leading zero before another digit is text (codes); a whole number beyond 32 bits makes the column
``bigint``, one beyond 64 bits ``double``; dates are ``yyyy-MM-dd`` that exist, times ``yyyy-MM-dd HH:mm[:ss[.f]]`` (or with a ``T``); truth values are ``TRUE``, ``FALSE``, ``T`` and
``F``, any case for the words; a column without any value stays text, all missing. Surrounding blanks count as part of a text cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

INT, WHOLE, NUMBER, DATE, TIME, TRUTH, TEXT = (1 << i for i in range(7))

_WHOLE = r"^[+-]?(0|[1-9][0-9]*)$"
_NUMBER = r"^[+-]?((0|[1-9][0-9]*)(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$|^(NaN|[+-]?Inf)$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?$"
_TRUTH = r"^((?i:true|false)|[TF])$"


def cell_kind(cell: Column) -> Column:
    """Bit of the narrowest kind that a cell fits; missing for a missing cell."""
    return (F.when(cell.isNull(), F.lit(None))
            .when(cell.rlike(_WHOLE), F.when(cell.try_cast("int").isNotNull(), INT).when(cell.try_cast("bigint").isNotNull(), WHOLE).otherwise(NUMBER))
            .when(cell.rlike(_NUMBER), NUMBER)
            .when(cell.rlike(_DATE) & cell.try_cast("date").isNotNull(), DATE)
            .when(cell.rlike(_TIME) & cell.try_cast("timestamp").isNotNull(), TIME)
            .when(cell.rlike(_TRUTH), TRUTH)
            .otherwise(TEXT))


def type_of(kinds: int | None) -> str:
    """The join of the kinds of a column."""
    for bits, name in ((0, "string"), (INT, "int"), (INT | WHOLE, "bigint"), (INT | WHOLE | NUMBER, "double"), (DATE, "date"), (DATE | TIME, "timestamp"), (TRUTH, "boolean")):
        if (kinds or 0) | bits == bits:
            return name
    return "string"


def kinds_seen(df: DataFrame) -> DataFrame:
    """One row: for every column of a table of texts the bits of the kinds it holds."""
    return df.agg(*[F.bit_or(cell_kind(F.col(f"`{c}`"))).alias(c) for c in df.columns])


def guess_types(df: DataFrame) -> dict[str, str]:
    """Type of every column of a table of texts."""
    if not df.columns:
        return {}
    row = kinds_seen(df).first()
    return {c: type_of(row[i]) for i, c in enumerate(df.columns)}


def cast_guessed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """The table with its columns cast to the given types."""
    def cast(c: str) -> Column:
        cell = F.col(f"`{c}`")
        if types[c] == "double":
            cell = F.regexp_replace(cell, "Inf$", "Infinity")
        return cell if types[c] == "string" else cell.cast(types[c]).alias(c)

    return df.select(*[cast(c) for c in df.columns])
