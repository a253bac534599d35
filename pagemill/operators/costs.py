"""Cost ledger: token prices, per-stage report, run totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Fixed value: price of a million input and output tokens of a model that is not listed.
DEFAULT_PRICE = (3.0, 15.0)
USD = "decimal(18,4)"


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """US dollars of a call, from prices of a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def ledger(calls: DataFrame, prices: DataFrame, *, model: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """calls with usd, rounded to four places before anything is summed. prices: (name, price_in, price_out)."""
    priced = calls.join(prices.withColumnRenamed("name", "_name"), F.col(model) == F.col("_name"), "left")
    micro = 1e6 * token_cost(F.col(tokens_in), F.col(tokens_out), F.coalesce("price_in", F.lit(DEFAULT_PRICE[0])), F.coalesce("price_out", F.lit(DEFAULT_PRICE[1])))
    return priced.withColumn("usd", (F.round(F.round(micro) / 100) / 10_000).cast(USD)).drop("_name", "price_in", "price_out")


def cost_report(rows: DataFrame, *, stage: str, model: str, order: list[str], pages: DataFrame | None = None) -> DataFrame:
    """Per stage: first model, tokens and cost; beside each the total and the cost a page (null without pages)."""
    stages = rows.groupBy(stage).agg(F.min_by(model, F.struct(*order)).alias("model"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("usd").alias("usd"))
    total = stages.agg(F.sum("usd").alias("total_usd"))
    n = pages.agg(F.count("*").alias("n")) if pages is not None else total.select(F.lit(0).alias("n"))
    per_page = F.round(F.col("total_usd").cast("double") / F.nullif(F.col("n"), F.lit(0)), 5)
    return stages.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(n)).select(stage, "model", "tokens_in", "tokens_out", F.col("usd").cast("double").alias("usd"), F.col("total_usd").cast("double").alias("total_usd"), per_page.alias("per_page_usd"))


def analysis_history(runs: DataFrame, *, by: str, order: list[str], usd: str) -> DataFrame:
    """runs with the cost rounded to four places and the cost of all runs of the key up to each."""
    upto = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return runs.withColumn(usd, F.col(usd).cast(USD)).withColumn(f"{usd}_total", F.sum(usd).over(upto).cast("double")).withColumn(usd, F.col(usd).cast("double"))


def run_totals(rows: DataFrame, *, status: str) -> DataFrame:
    """Done, failed and skipped items of a run, with its tokens and cost."""
    of = lambda s: F.count_if(F.col(status) == s)
    return rows.agg(of("done").alias("done"), of("error").alias("errors"), of("skipped").alias("skipped"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), F.sum("usd").cast("double").alias("usd"))
