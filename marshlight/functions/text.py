"""String helpers: tolerant numbers, names with codes, dates inside file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .calendar import _col


# How names with codes, days and months are written in headers and file names.
NAME_AND_CODE = r"^(.*?)\s*\((.*?)\)\s*$"
DASHED_DAY, PLAIN_DAY = r"(\d{4})[-_](\d{2})[-_](\d{2})", r"(\d{4})(\d{2})(\d{2})"
DASHED_MONTH = r"(\d{4})[-_](\d{2})"


def canonical_name(c) -> Column:
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]", "")


def tolerant_number(c) -> Column:
    """Number with blanks around it and either decimal mark; anything else is null."""
    return F.regexp_replace(F.trim(_col(c)), ",", ".").try_cast("double")


def name_part(c) -> Column:
    """``NAME`` of ``NAME (code)``, or the whole trimmed text."""
    c = _col(c)
    return F.trim(F.when(c.rlike(NAME_AND_CODE), F.regexp_extract(c, NAME_AND_CODE, 1)).otherwise(c))


def code_part(c) -> Column:
    """``code`` of ``NAME (code)``; null when there is none."""
    return F.nullif(F.trim(F.regexp_extract(_col(c), NAME_AND_CODE, 2)), F.lit(""))


def class_code_from_name(c) -> Column:
    """Trailing class number of a column name such as ``class_3``."""
    return F.regexp_extract(_col(c), r"(\d+)$", 1).try_cast("int")


def split_label(ident, part, was_split) -> Column:
    """``id_part`` for areas that were split, plain ``id`` otherwise."""
    ident = _col(ident).cast("string")
    return F.when(_col(was_split), F.concat_ws("_", ident, _col(part))).otherwise(ident)


def day_in_name(c) -> Column:
    """Date written in a name: the first YYYY-MM-DD or YYYY_MM_DD, else YYYYMMDD; impossible ones are null."""
    c = _col(c)
    got = F.when(c.rlike(DASHED_DAY), F.regexp_extract(c, DASHED_DAY, 0)).otherwise(F.regexp_extract(c, PLAIN_DAY, 0))
    return F.try_to_date(F.regexp_replace(got, "[-_]", ""), "yyyyMMdd")


def month_in_name(c) -> Column:
    """First day of the month written in a name as YYYY-MM or YYYY_MM."""
    got = F.regexp_extract(_col(c), DASHED_MONTH, 0)
    return F.try_to_date(F.concat(F.regexp_replace(got, "[-_]", ""), F.lit("01")), "yyyyMMdd")


def unique_names(df: DataFrame, name: str, suffix: str) -> DataFrame:
    """Append ``suffix`` to names used more than once.

    Names are counted with a partial aggregate and joined back, so a name carried by a third of
    the rows is not gathered in one window partition.
    """
    counts = df.groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    label = F.when(F.col("_n") > 1, F.concat_ws("_", F.col(name), F.col(suffix).cast("string")))
    return (
        df.join(counts, name, "left")
        .withColumn("unique_name", F.coalesce(label, F.col(name)))
        .drop("_n")
    )
