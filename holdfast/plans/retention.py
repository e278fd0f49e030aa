"""The phases of a retention study; each hands its tables to the next."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property
from threading import Lock
from time import monotonic

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession

from holdfast.functions.fixed import ID, LABEL
from holdfast.operators.contributions import TARGET
from holdfast.operators import metrics, models, quality, split, treeshap
from holdfast.operators.features import CustomerFeatures, CustomerFeaturesModel
from holdfast.operators.models import Learner
from holdfast.plans import artifacts
from holdfast.sources.tables import drop_table, files_state, fresh_path, settle, write_report, write_table
from holdfast.sources.versions import new_folder, publish

TRUSTED = 60.0  # seconds


@dataclass
class _Held:
    study: Study
    state: tuple
    compared: float


_STUDIES: dict[tuple, _Held] = {}
_LOCK = Lock()


@dataclass(eq=False)
class Study:
    """One raw table and all that follows from it.

    Phases run on first use. A phase several others read is written once to the
    shared folder: ingested customers, features, test scores, contributions.
    """

    raw: DataFrame
    learners: list[Learner]
    folds: int = 5
    _stored: dict[str, DataFrame] = field(default_factory=dict)

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A further table of this study, built and written on first use."""
        if name not in self._stored:
            self._stored[name] = settle(build(), name)
        return self._stored[name]

    @property
    def spark(self) -> SparkSession:
        return self.raw.sparkSession

    @cached_property
    def customers(self) -> DataFrame:
        return settle(quality.ingest(self.raw), "customers")

    @cached_property
    def divided(self) -> DataFrame:
        return split.with_split(self.customers)

    @property
    def train(self) -> DataFrame:
        return self.divided.filter("split = 'train'").drop("split")

    @property
    def test(self) -> DataFrame:
        return self.divided.filter("split = 'test'").drop("split")

    @cached_property
    def features(self) -> CustomerFeaturesModel:
        """Scaling learned on training rows only."""
        return CustomerFeatures(fitOn="split = 'train'").fit(self.divided)

    @cached_property
    def scaled(self) -> DataFrame:
        """Feature table of all customers with their side of the split, scaling learned on all of them."""
        return settle(CustomerFeatures().fit(self.customers).table(self.divided, "split"), "features")

    @cached_property
    def pipeline(self) -> PipelineModel:
        vectors = models.one_wave(models.vector_table(self.features, self.train)).persist()
        try:
            fitted = models.fit_all(self.learners, vectors)
        finally:
            vectors.unpersist()
        return models.scoring_pipeline(self.features, fitted)

    @cached_property
    def scored(self) -> DataFrame:
        """Test customers with raw attributes, one row per model."""
        return settle(models.score(self.pipeline, self.test).withColumnRenamed(LABEL, "label"), "scored")

    @property
    def tree_model(self):
        return self.pipeline.stages[-1]

    @cached_property
    def nodes(self) -> DataFrame:
        return models.node_table(self.spark, self.tree_model, fresh_path(self.spark, "trees"))

    @cached_property
    def explained(self) -> DataFrame:
        """Test customers with contributions to the tree model's log-odds."""
        vectors = self.pipeline.transform(self.test)
        margin = vector_to_array(self.tree_model.getRawPredictionCol())[1]
        rows = vectors.select(ID, LABEL, TARGET, (margin * treeshap.LOG_ODDS).alias("log_odds"), "features")
        return settle(treeshap.explain(rows, self.nodes), "shap")

    @cached_property
    def fold_metrics(self) -> DataFrame:
        folded = split.with_folds(self.train, self.folds)
        return models.cross_validate(self.learners, models.vector_table(self.features, folded, "fold"), self.folds)

    def export(self, path: str, cross_validation: bool = True) -> None:
        """Write everything the study made, as one set: tables, pipeline, nodes, reports, contributions.

        The set replaces the one at path when it is complete; see load_artifacts.
        """
        folder = new_folder(path)
        tables = {"customers": self.customers, "features": self.features.table(self.customers)}
        tables |= {side: self.features.table(getattr(self, side)) for side in ("train", "test")}
        tables |= {"scored": self.scored, "nodes": self.nodes, "contributions": self.explained}
        counts = {name: write_table(table, f"{folder}/{name}").count() for name, table in tables.items()}
        models.save_pipeline(self.pipeline, f"{folder}/pipeline")
        reports = {"test_metrics": metrics.metric_rows(self.scored)}
        if cross_validation:
            reports["model_comparison"] = models.cv_comparison(self.fold_metrics, [learner.name for learner in self.learners])
        for name, report in reports.items():
            write_report(report, f"{folder}/{name}")
        schemas = {name: report.schema.jsonValue() for name, report in reports.items()}
        about = artifacts.described(self.pipeline, counts, schemas)
        artifacts.load(self.spark, folder, about)  # raises if the parts do not fit each other
        publish(self.spark, path, folder, about)

    def close(self) -> None:
        """Delete what this study has stored. Its tables cannot be read any more."""
        made = [self.__dict__.get(name) for name in ("customers", "scaled", "scored", "explained")]
        for table in [*self._stored.values(), *made]:
            if table is not None:
                drop_table(table)


def study(spark: SparkSession, key: str, raw: Callable[[], DataFrame], learners: list[Learner], paths: Callable[[], list[str]], now: Callable[[], float] = monotonic) -> Study:
    """The study of this session for a source, opened once; its stored phases are shared by all callers.

    paths names the source's files. They are compared with what they were when more than TRUSTED seconds have
    passed since the last comparison, or after refresh(). A source whose files have changed is opened anew, and
    the earlier study is forgotten.
    """
    slot = (spark.sparkContext.applicationId, key)
    with _LOCK:
        held = _STUDIES.get(slot)
        if held is not None and now() - held.compared < TRUSTED:
            return held.study
        state = files_state(spark, paths())
        if held is None or held.state != state:
            held = _STUDIES[slot] = _Held(Study(raw(), learners), state, 0.0)
        held.compared = now()
        return held.study


def refresh(spark: SparkSession) -> None:
    """Compare every source's files again before its study is next used in this session."""
    with _LOCK:
        for slot, held in _STUDIES.items():
            if slot[0] == spark.sparkContext.applicationId:
                held.compared = -float("inf")
