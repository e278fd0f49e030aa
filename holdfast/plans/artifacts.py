"""What a study leaves behind, as one set whose parts belong together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from holdfast.functions.fixed import ID, LABEL
from holdfast.operators import treeshap
from holdfast.operators.contributions import additivity
from holdfast.operators.models import load_pipeline
from holdfast.sources.tables import read_report, read_table
from holdfast.sources.versions import current

GAP = 1e-6  # between the log-odds and what contributions add up to


class ArtifactError(ValueError):
    """Parts of a set that do not belong together."""


@dataclass
class Artifacts:
    """A loaded set: the pipeline, tables and reports by name."""

    pipeline: PipelineModel
    tables: dict[str, DataFrame]
    reports: dict[str, DataFrame]

    @property
    def feature_names(self) -> list[str]:
        return self.pipeline.stages[0].feature_names


def described(pipeline: PipelineModel, counts: dict[str, int], schemas: dict[str, dict]) -> dict:
    """What is kept about a set: which models, on which features in which order, rows by table, columns by report."""
    return {"features": pipeline.stages[0].feature_names, "models": [m.uid for m in pipeline.stages[1:]], "rows": counts, "reports": schemas}


def load_artifacts(spark: SparkSession, path: str) -> Artifacts:
    """The current set at path. An incomplete one, or one whose parts do not fit each other, is an error."""
    about = current(spark, path)
    if about is None:
        raise ArtifactError(f"no set at {path}")
    return load(spark, about["folder"], about)


def load(spark: SparkSession, folder: str, about: dict) -> Artifacts:
    """The set in a folder, checked against its description.

    The pipeline must be the described one, all feature tables must have its features in its order, each
    table its rows, and the contributions must be one number per feature that add up, with the
    baseline of the stored trees, to that pipeline's log-odds.
    """
    pipeline = load_pipeline(f"{folder}/pipeline")
    names = pipeline.stages[0].feature_names
    if names != about["features"] or [m.uid for m in pipeline.stages[1:]] != about["models"]:
        raise ArtifactError("the pipeline is another than the one described")
    tables = {name: read_table(spark, f"{folder}/{name}") for name in about["rows"]}
    reports = {name: read_report(spark, f"{folder}/{name}", StructType.fromJson(kind)) for name, kind in about["reports"].items()}
    for name in ("features", "train", "test"):
        if tables[name].columns != [ID, *names, LABEL]:
            raise ArtifactError(f"{name}: its columns are not the pipeline's features")
    counts = [t.select(F.lit(name).alias("name")) for name, t in tables.items()]
    both = counts[0]
    for more in counts[1:]:
        both = both.unionAll(more)
    found = {r["name"]: r["count"] for r in both.groupBy("name").count().collect()}
    wrong = [name for name, n in about["rows"].items() if found.get(name, 0) != n]
    if wrong:
        raise ArtifactError(f"{wrong}: not the described number of rows")
    _check_contributions(pipeline, tables["contributions"], tables["nodes"], names)
    return Artifacts(pipeline, tables, reports)


def _check_contributions(pipeline: PipelineModel, table: DataFrame, nodes: DataFrame, names: list[str]) -> None:
    base, _ = treeshap.collected_paths(treeshap.tree_paths(nodes))
    trees = nodes.select(F.count_distinct("treeID").alias("n")).first()["n"]
    row = table.agg(
        F.count_if((F.size("shap") != len(names)) | (F.size("value") != len(names))).alias("size"),
        F.count_if(F.abs(F.col("base") - base) > GAP).alias("base"),
    ).first()
    gap = additivity(table).first()["max_gap"]
    if row["size"]:
        raise ArtifactError("contributions are not one number per feature")
    if row["base"] or trees != pipeline.stages[-1].getNumTrees:
        raise ArtifactError("contributions are those of another model")
    if gap is not None and gap > GAP:
        raise ArtifactError("contributions do not add up to the model's log-odds")
