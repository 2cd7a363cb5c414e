"""Conversion funnels: by stage seen, and by deepest stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.numbers import maybe_round, open_ratio, ratio
from platewise.operators.sessions import first_per_user, has_bit, session_rollup, session_stages
from platewise.schemas import FUNNEL_STAGES


def _unfold(counts: DataFrame, stages: Sequence[str], prefix: str = "at") -> Column:
    """The one-row counts as an array of (stage, order, sessions, previous, top)."""
    at = [F.col(f"{prefix}_{k}") for k in range(len(stages))]
    return F.array(
        *[
            F.struct(
                F.lit(stage).alias("stage"),
                F.lit(k).alias("stage_order"),
                at[k].alias("sessions"),
                (at[k - 1] if k else F.lit(None).cast("bigint")).alias("previous"),
                at[0].alias("top"),
            )
            for k, stage in enumerate(stages)
        ]
    )


def funnel(
    events: DataFrame, stages: Sequence[str] = FUNNEL_STAGES, view: str = "first_session"
) -> DataFrame:
    """Distinct sessions seen at each stage.

    `view`: 'first_session' counts each user's earliest session only, 'blended' all.
    -> stage, sessions, conversion_from_prev_stage, dropoff_from_prev_stage,
    conversion_from_top; one row per stage, unseen stages with 0 sessions. The first
    stage converts at 1.0, as does an empty stage after an empty one.
    """
    if view not in ("first_session", "blended"):
        raise ValueError(f"unknown funnel view {view!r}")
    sessions = session_stages(events, stages)
    if view == "first_session":
        sessions = first_per_user(sessions, "stage_bits")
    counts = sessions.agg(
        *[F.count_if(has_bit("stage_bits", k)).alias(f"at_{k}") for k in range(len(stages))]
    )
    rows = counts.select(F.explode(_unfold(counts, stages)).alias("row")).select("row.*")
    step = F.when(F.col("previous").isNull(), 1.0).otherwise(
        F.coalesce(open_ratio(F.col("sessions"), F.col("previous")), F.lit(1.0))
    )
    return rows.select(
        "stage",
        "sessions",
        step.alias("conversion_from_prev_stage"),
        (1.0 - step).alias("dropoff_from_prev_stage"),
        open_ratio(F.col("sessions"), F.col("top")).alias("conversion_from_top"),
    )


def funnel_by_depth(
    events: DataFrame, stages: Sequence[str] = FUNNEL_STAGES, digits: int | None = 4
) -> DataFrame:
    """Both views, a session counting for every stage up to its deepest one.

    -> funnel_view, stage, stage_order, sessions, conversion_from_prev_stage,
    conversion_from_top. The first stage has no previous stage (NULL).

    One chain of shuffles serves both views: each user's row carries the first
    session and the sums over all of the user's sessions.
    """
    depth = range(len(stages))

    def reached(k: int, column: str = "max_stage_order") -> Column:
        return F.col(column) >= k

    users = (
        session_rollup(events)
        .groupBy("user_id")
        .agg(
            F.min(F.struct("start_ts", "session_id", "max_stage_order")).alias("first"),
            *[F.count_if(reached(k)).alias(f"all_{k}") for k in depth],
        )
    )
    counts = users.agg(
        *[F.count_if(reached(k, "first.max_stage_order")).alias(f"first_{k}") for k in depth],
        *[F.coalesce(F.sum(f"all_{k}"), F.lit(0)).alias(f"blended_{k}") for k in depth],
    )
    views = F.array(
        F.struct(F.lit("blended").alias("funnel_view"), _unfold(counts, stages, "blended").alias("rows")),
        F.struct(
            F.lit("first_session").alias("funnel_view"), _unfold(counts, stages, "first").alias("rows")
        ),
    )
    # Exploding one row in order yields view by view, stage by stage.
    return (
        counts.select(F.explode(views).alias("view"))
        .select("view.funnel_view", F.explode("view.rows").alias("row"))
        .select(
            "funnel_view",
            "row.stage",
            "row.stage_order",
            "row.sessions",
            maybe_round(ratio(F.col("row.sessions"), F.col("row.previous")), digits).alias(
                "conversion_from_prev_stage"
            ),
            maybe_round(ratio(F.col("row.sessions"), F.col("row.top")), digits).alias(
                "conversion_from_top"
            ),
        )
    )
