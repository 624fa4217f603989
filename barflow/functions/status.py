"""Order states of three kinds of venues as one vocabulary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Each venue's words for an order's state.
STATUS = {
    "crypto": {"open": "open", "closed": "filled", "canceled": "cancelled", "expired": "cancelled", "rejected": "rejected"},
    "equity": {"new": "open", "accepted": "open", "partially_filled": "partial", "filled": "filled", "canceled": "cancelled", "expired": "cancelled", "rejected": "rejected"},
    "forex": {"PENDING": "open", "FILLED": "filled", "TRIGGERED": "filled", "CANCELLED": "cancelled"},
}


def normalised_status(venue: Column, status: Column) -> Column:
    """The common word; an unknown state counts as open."""
    known = F.create_map(*[x for v, words in STATUS.items() for a, b in words.items() for x in (F.lit(f"{v}:{a}"), F.lit(b))])
    return F.coalesce(F.try_element_at(known, F.concat_ws(":", venue, status)), F.lit("open"))
