"""Scoring of customers as they arrive, with the pipeline used in batch."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from holdfast.functions.fixed import ID
from holdfast.operators.business import with_recommendations, with_risk_tier
from holdfast.operators.contributions import waterfalls
from holdfast.operators.models import dealt_evenly, score, score_array
from holdfast.operators.treeshap import LOG_ODDS, collected_paths, explain, tree_paths


def with_open_to_buy(customers: DataFrame) -> DataFrame:
    """Add what is left of the credit limit, at least 0, if the rows come without it."""
    if "Avg_Open_To_Buy" in customers.columns:
        return customers
    left = F.col("Credit_Limit") - F.col("Total_Revolving_Bal")
    return customers.withColumn("Avg_Open_To_Buy", F.greatest(F.lit(0.0), left.cast("double")))


def risk_records(customers: DataFrame, pipeline: PipelineModel, base_rate: Column | float, reject: bool = True) -> DataFrame:
    """Customers with probability, class, tier and recommended actions, batch or stream.

    Rows that cannot be scored come once, without these, and `missing` names the features
    they have no value for; with reject=False they are an error.
    """
    customers = with_open_to_buy(customers)
    if not reject:
        return with_recommendations(with_risk_tier(score(pipeline, customers), base_rate))
    marked = pipeline.stages[0].with_missing(customers)
    scored = score(pipeline, marked.filter(F.size("missing") == 0))
    records = with_recommendations(with_risk_tier(scored, base_rate))
    return records.unionByName(marked.filter(F.size("missing") > 0), allowMissingColumns=True)


def explained_records(customers: DataFrame, pipeline: PipelineModel, nodes: DataFrame, top: int = 12) -> DataFrame:
    """Customers' log-odds under the tree model (the last stage), base, contributions and waterfall, batch or stream.

    Rows that cannot be scored are left out.
    """
    features, model = pipeline.stages[0], pipeline.stages[-1]
    known = features.with_missing(with_open_to_buy(customers)).filter(F.size("missing") == 0)
    if not customers.isStreaming:
        known = dealt_evenly(known, waves=4)
    margin = vector_to_array(model.getRawPredictionCol())[1]
    rows = model.transform(features.transform(known)).select(ID, (margin * LOG_ODDS).alias("log_odds"), "features")
    shap = explain(rows, nodes)
    steps = waterfalls(shap.withColumn("key", F.struct(ID, "log_odds")), features.feature_names, top, "key")
    return steps.select("key.*", "base", "shap", "steps")


def explained_scores(
    customers: DataFrame, pipeline: PipelineModel, nodes: DataFrame | tuple, base_rate: Column | float, top: int = 12
) -> DataFrame:
    """risk_records with the tree model's log-odds, base, contributions and waterfall in each, from one pass over the rows."""
    marked = pipeline.stages[0].with_missing(with_open_to_buy(customers))
    margin = vector_to_array(pipeline.stages[-1].getRawPredictionCol())[1]
    made = pipeline.transform(marked.filter(F.size("missing") == 0))
    row = F.struct(*marked.columns, score_array(pipeline.stages[1:]).alias("scores"), (margin * LOG_ODDS).alias("log_odds"))
    shap = explain(made.select(row.alias("row"), "features"), nodes)
    steps = waterfalls(shap, pipeline.stages[0].feature_names, top, "row").select("row.*", "base", "shap", "steps")
    scored = steps.select("*", F.inline("scores")).drop("scores")
    records = with_recommendations(with_risk_tier(scored, base_rate))
    return records.unionByName(marked.filter(F.size("missing") > 0), allowMissingColumns=True)


def _write_batch(rows: DataFrame, folder: str, batch: int) -> None:
    """One batch's rows in a folder of its own, whatever an earlier attempt has left there."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def stream_to_sinks(
    spark: SparkSession,
    source: str,
    schema: StructType,
    pipeline: PipelineModel,
    nodes: DataFrame,
    base_rate: float,
    scores: str,
    rejects: str,
    checkpoint: str,
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Explain all parquet files in source not seen before, then stop: records to `scores`, rows that cannot be scored to `rejects`.

    A batch is computed once and written to both sinks, each time into the folder of its number. A batch that was
    killed between the sinks is run again under its number and replaces what it left, so that a
    restart neither repeats nor loses rows. `rejects` holds the customers as they came, and `missing`.
    """
    paths = collected_paths(tree_paths(nodes))

    def write(rows: DataFrame, number: int) -> None:
        records = explained_scores(rows, pipeline, paths, base_rate).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            _write_batch(records.filter("model is not null"), scores, number)
            _write_batch(records.filter("model is null").select(*with_open_to_buy(rows).columns, "missing"), rejects, number)
        finally:
            records.unpersist()

    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_scores(
    spark: SparkSession,
    source: str,
    schema: StructType,
    pipeline: PipelineModel,
    base_rate: float,
    sink: str,
    checkpoint: str,
    files_per_trigger: int = 1000,
) -> StreamingQuery:
    """Score all parquet files in source not seen before, then stop.

    Rows are scored independently, so there is no state and no watermark. Offsets
    are kept in the checkpoint folder and the file sink commits each batch once,
    so a restarted job neither repeats nor loses rows.
    """
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    return (
        risk_records(arriving, pipeline, base_rate)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(sink)
    )
