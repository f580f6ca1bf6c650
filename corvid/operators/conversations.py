"""Turn-wise samples: history, question and ordinal of every assistant turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def assistant_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """For each assistant turn: its ordinal from 0, the last user text before it, and the number of turns before."""
    order = Window.partitionBy(conv).orderBy(turn)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    question = F.last(F.when(F.col(role) == "user", F.col(text)), ignorenulls=True).over(before)
    d = turns.withColumns({"question": question, "n_history": F.count(F.lit(1)).over(before), "ordinal": F.sum((F.col(role) == "assistant").cast("long")).over(order) - 1})
    return d.where(F.col(role) == "assistant")


def with_history(turns: DataFrame, value: str, conv: str = "conv_id", turn: str = "turn", sep: str = ">") -> DataFrame:
    """The values of all turns up to each one, in order."""
    upto = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("history", F.array_join(F.collect_list(value).over(upto), sep))


def turn_types(turns: DataFrame, types: str, ordinal: str = "ordinal") -> DataFrame:
    """The type of an assistant turn by its ordinal, '' where the list is too short."""
    return turns.withColumn("turn_type", F.coalesce(F.expr(f"get({types}, cast({ordinal} as int))"), F.lit("")))
