"""Chat history windows and question intents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.functions import text as X

HISTORY_MESSAGES = 10
NO_HISTORY = "No previous conversation"


def recent_turns(df: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    """Last ``n`` user and assistant messages of each conversation.

    The rank limit is applied per task before the shuffle, so a conversation of
    any length sends ``n`` messages per task.
    """
    spoken = df.filter(F.col("role").isin("user", "assistant"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return spoken.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def chat_history(df: DataFrame, n: int = HISTORY_MESSAGES) -> DataFrame:
    """One text per conversation: its last ``n`` messages in order."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "),
                    F.coalesce("text", F.lit("")))
    turns = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return recent_turns(df, n).groupBy("conv_id").agg(
        F.array_join(F.transform(turns, lambda t: t["line"]), "\n").alias("history"),
        F.count(F.lit(1)).alias("message_count"))


def classify_intents(df: DataFrame, question_column: str) -> DataFrame:
    question = F.col(question_column)
    return df.select("*", X.is_report_request(question).alias("is_weekly_report"),
                     X.company(question).alias("company_name"))
