"""Events rolled up to sessions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.functions.numbers import ordinal


WORD = 62  # stages per word of bits


def stage_words(position: Column, stages: int) -> Column:
    """Aggregate: the stage positions seen, one bit each, in as many words as they need."""
    words = []
    for first in range(0, max(stages, 1), WORD):
        place = F.when(position.between(first, first + WORD - 1), position - first)
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
        words.append(F.coalesce(F.bit_or(bit), F.lit(0).cast("bigint")))
    return F.array(*words)


def session_rollup(events: DataFrame) -> DataFrame:
    """One row per session -> session_id, user_id, start_ts, max_stage_order."""
    return (
        events.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            F.min("user_id").alias("user_id"),
            F.min("event_ts").alias("start_ts"),
            F.max("stage_order").alias("max_stage_order"),
        )
    )


def session_stages(events: DataFrame, stages: Sequence[str]) -> DataFrame:
    """One row per session -> session_id, user_id, start_ts, stage_bits.

    `stage_bits` has the bit of a stage set when the session shows an event of it, so
    "distinct sessions seen at a stage" becomes a plain sum with no second shuffle.
    """
    return (
        events.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(
            F.min("user_id").alias("user_id"),
            F.min("event_ts").alias("start_ts"),
            stage_words(ordinal(F.col("stage"), stages), len(stages)).alias("stage_bits"),
        )
    )


def first_per_user(sessions: DataFrame, payload: str) -> DataFrame:
    """Each user's earliest session -> user_id, session_id, `payload`.

    A minimum over (start, session) combines before the shuffle, so a user with
    very many sessions stays cheap. Equal starts go to the lower session_id.
    """
    first = F.min(F.struct(F.col("start_ts").isNull().alias("undated"), "start_ts", "session_id", payload))
    return (
        sessions.filter(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(first.alias("first"))
        .select("user_id", "first.session_id", f"first.{payload}")
    )


def has_bit(bits: str, position: int) -> Column:
    return F.getbit(F.get(bits, F.lit(position // WORD)), F.lit(position % WORD)) == 1


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
