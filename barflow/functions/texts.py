"""Numbers in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column | str, places: int, grouped: bool = False, signed: bool = False) -> Column:
    """A double with so many decimals, rounded by its exact binary value, exact halves to even, as in C; format_string rounds the shortest decimal instead (1.005 to 1.01).

    grouped: thousands parted by commas; signed: a plus before what is not negative.
    What is not finite is written as format_string does.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    flags = ("+" if signed else "") + ("," if grouped else "")
    text = F.format_number(v, places)
    text = text if grouped else F.translate(text, ",", "")
    text = F.when(F.startswith(text, F.lit("-")), text).otherwise(F.concat(F.lit("+"), text)) if signed else text
    # a missing or endless number keeps the words of format_string
    return F.when(F.isnan(v) | v.isNull() | (F.abs(v) == float("inf")), F.format_string(f"%{flags}.{places}f", v)).otherwise(text)
