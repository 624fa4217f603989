"""News blackouts and the score gate on streams: the batch operators, a micro-batch at a time.

The calendar is read anew for every batch, so an event added while the stream
runs counts from the next batch on; the saved model likewise, so a model
trained again is taken over without a restart.  Both meet the batch's rows by
the batch engine's own joins (minutes around each event as bins, the model as a
transformation), so the verdicts are those of the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..operators import ml
from ..operators.signals import blackout
from ..sources.ledger import Ledger

Calendar = Callable[[], DataFrame]


def verdicts(rows: DataFrame, events: DataFrame | None = None, currencies: DataFrame | None = None, model=None, cfg: dict = DEFAULTS) -> DataFrame:  # noqa: ANN001
    """Bars with signals (see signals.with_signals), with what refuses the signal in `refused`: blackout, then score; NULL if nothing does.

    A signal without all its features has no score and is not refused for it.
    """
    signals = rows.filter("signal IS NOT NULL")
    if events is None:
        out = rows.withColumn("_event", F.lit(None).cast("string"))
    else:
        found = blackout(signals.select("symbol", "ts").distinct(), events, currencies, cfg["risk"]["blackout_minutes"])
        out = rows.join(found.filter("blackout IS NOT NULL").withColumnRenamed("blackout", "_event"), ["symbol", "ts"], "left")
    if model is None:
        out = out.withColumn("_score", F.lit(None).cast("double"))
    else:
        scored = ml.score(model, ml.feature_matrix(rows, cfg)).select("symbol", "ts", F.col("score").alias("_score"))
        out = out.join(scored, ["symbol", "ts"], "left")
    refused = F.when(F.col("_event").isNotNull(), "blackout").when(F.col("_score") < cfg["ml"]["min_score"], "score")
    return out.withColumn("refused", F.when(F.col("signal").isNotNull(), refused)).select(*rows.columns, "refused")


def gated(rows: DataFrame, calendar: Calendar | None, currencies: DataFrame | None, model_path: str | None, cfg: dict = DEFAULTS) -> DataFrame:
    """The bars with signal NULL where a gate refuses it; calendar and model as they are now."""
    if calendar is None and model_path is None:
        return rows
    out = verdicts(rows, calendar() if calendar else None, currencies, ml.load_model(model_path) if model_path else None, cfg)
    return out.withColumn("signal", F.when(F.col("refused").isNull(), F.col("signal"))).drop("refused")


def gate_batches(ledger: Ledger, calendar: Calendar, currencies: DataFrame, model_path: str | None, minutes: int = 15, least: float = 0.55) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for signals (symbol, ts and the model's features): those that pass both gates, with their score, once a batch under the ledger's folder."""

    def handle(batch: DataFrame, number: int) -> None:
        free = blackout(batch, calendar(), currencies, minutes).filter("blackout IS NULL").drop("blackout")
        passed = ml.score_gate(ml.score(ml.load_model(model_path) if model_path else None, free), least)
        ledger.write(number, lambda path: passed.write.parquet(path))

    return handle
