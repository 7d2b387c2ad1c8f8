"""Column -> Column helpers shared by the operators. No Python UDFs."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: str | Column, den: str | Column) -> Column:
    """num / den as a double, 0.0 when the denominator is 0."""
    return F.coalesce(col(num) / F.nullif(col(den), F.lit(0)), F.lit(0.0))


def percent(num: str | Column, den: str | Column) -> Column:
    return ratio(num, den) * F.lit(100.0)


def harmonic(p: Column, r: Column) -> Column:
    """F1 of two rates, 0.0 when both are 0."""
    return ratio(F.lit(2.0) * (p * r), p + r)


# every character that counts as white space, not just the blank that trim() removes
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: str | Column) -> Column:
    """Remove any white space at both ends."""
    return F.trim(col(c), F.lit(WHITE_SPACE))


def strip_start(c: str | Column) -> Column:
    """Remove white space at the start only, which does not look at the rest of the text."""
    return F.ltrim(col(c), F.lit(WHITE_SPACE))


def text_or(c: str | Column, default: str) -> Column:
    """The column, or a default where it is null or empty."""
    return F.when(F.length(col(c)) > 0, col(c)).otherwise(F.lit(default))


def joined(columns: Iterable[str | Column], sep: str = "|") -> Column:
    """concat_ws over null-safe strings: null counts as '', no part is dropped."""
    return F.concat_ws(sep, *[F.coalesce(col(c).cast("string"), F.lit("")) for c in columns])


def unambiguous(columns: Iterable[str | Column]) -> Column:
    """The parts in a row, each after its length, so that no two different lists agree.

    Null counts as ''. Meant to be hashed; ``joined`` is for ids that are shown.
    """
    parts = [F.coalesce(col(c).cast("string"), F.lit("")) for c in columns]
    return F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)])


def literal_array(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def value_of(mapping: Mapping[str, object], key: str | Column) -> Column:
    """Look a key up in a small fixed mapping; null when absent."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(key))


def sample_order(seed: int, ident: str | Column) -> Column:
    """Repeatable pseudo-random sort key: md5 of 'seed:id'."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col(ident).cast("string")))


def literal_table(spark: SparkSession, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A fixed dimension written out in the code.

    Planned as a one-row generator over a constant, so the optimizer knows it is tiny
    and broadcasts it by itself; never build one from data.
    """
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def only_value(df: DataFrame) -> Column:
    """A one-row, one-column frame as an uncorrelated scalar subquery."""
    return df.scalar()
