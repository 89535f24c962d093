"""Stage tables of one data folder: each is written once to the shared folder and read back.

Stages cut lineage the way the workload's own stages do (they talk through Parquet files), so a lost
executor costs one stage at most. Nothing is cached in memory and nothing is kept on a local disk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession

from basketlake.operators import cleaning, features, products, rolling, sequences, snapshots
from basketlake.session import shared_folder
from basketlake.settings import DEFAULTS, Settings
from basketlake.sources import adapter
from basketlake.sources.sinks import write_table

CATEGORIES = len(adapter.CATALOGUE_TYPES)
# The test tables discount by 0-10 percent and sell large orders; these make every branch occur.
MARKDOWN_RATIO = 0.96
HIGH_VALUE = 60_000.0
IQR_MULTIPLIER = 0.25


class Workspace:
    """Lazily built stage tables for one session and one folder of input tables."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings = DEFAULTS):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings
        tag = hashlib.md5(self.folder.encode()).hexdigest()[:8]
        self.root = f"{shared_folder(spark)}/basketlake/{spark.sparkContext.applicationId}-{tag}"

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """Write ``build()`` once per workspace, then read it."""
        path = f"{self.root}/{name}"
        done = self.__dict__.setdefault("_stages", set())
        if name not in done:
            write_table(build(), path)
            done.add(name)
        return self.spark.read.parquet(path)

    # --- lines ------------------------------------------------------------------------------
    @property
    def lines(self) -> DataFrame:
        return adapter.canonical_lines(self.spark, self.folder)

    @property
    def lines_with_copies(self) -> DataFrame:
        """The lines, with every return repeated: exact copies for the duplicate operators."""
        return self.lines.unionByName(self.lines.where("quantity < 0"))

    @property
    def cleaning_cfg(self) -> cleaning.CleaningSettings:
        from dataclasses import replace
        return replace(self.settings.cleaning, iqr_multiplier=IQR_MULTIPLIER, quantity_limit=45)

    @property
    def rolling_cfg(self):
        from dataclasses import replace
        return replace(self.settings.rolling, high_value=HIGH_VALUE)

    @property
    def clean(self) -> DataFrame:
        """Clean lines with default limits and no fitted thresholds."""
        return self.stage("clean", lambda: cleaning.clean(
            adapter.canonical_lines(self.spark, self.folder, distinct=True), self.settings.cleaning,
            distinct=True))

    # --- cutoffs and customers --------------------------------------------------------------
    def _cutoff(self, name: str) -> Column:
        found = self.stage("cutoffs", lambda: snapshots.canonical_cutoffs(
            self.clean, self.settings.snapshots))
        return found.select(name).scalar()

    @property
    def observation_end(self) -> Column:
        return self._cutoff("observation_end")

    @property
    def churn_cutoff(self) -> Column:
        return self._cutoff("churn_cutoff")

    @property
    def clv_cutoff(self) -> Column:
        return self._cutoff("clv_cutoff")

    @property
    def customers(self) -> DataFrame:
        """The modelling population: eligible at the value cutoff."""
        return self.split.select("customer_id")

    @property
    def split(self) -> DataFrame:
        # ranking reads the customers twice: they are found once
        return self.stage("split", lambda: snapshots.split_customers(
            self.stage("eligible", lambda: snapshots.eligible_customers(self.clean, self.clv_cutoff)),
            self.settings.split))

    @property
    def training_ids(self) -> DataFrame:
        return snapshots.customers_in(self.split, "train")

    # --- products ---------------------------------------------------------------------------
    @property
    def taxonomy(self) -> DataFrame:
        return adapter.catalogue(self.spark, self.folder)

    @property
    def training_lines(self) -> DataFrame:
        return products.training_history(self.clean, self.training_ids, self.clv_cutoff)

    @property
    def prices(self) -> DataFrame:
        return self.stage("prices", lambda: products.reference_prices(
            self.training_lines, self.settings.products))

    @property
    def popular(self) -> DataFrame:
        return self.stage("popularity", lambda: products.popularity(
            self.training_lines, self.settings.products))

    # --- features ---------------------------------------------------------------------------
    def build_features(self, cutoff: Column) -> DataFrame:
        return features.customer_features(
            self.clean, self.customers, cutoff, self.taxonomy, CATEGORIES, self.prices,
            self.popular, self.training_ids, self.settings.snapshots.trend_days, MARKDOWN_RATIO)

    @property
    def churn_features(self) -> DataFrame:
        return self.stage("churn_features", lambda: self.build_features(self.churn_cutoff))

    @property
    def clv_features(self) -> DataFrame:
        return self.stage("clv_features", lambda: self.build_features(self.clv_cutoff))

    @property
    def churn_table(self) -> DataFrame:
        return self.stage("churn_table", lambda: snapshots.labelled_table(
            self.churn_features,
            snapshots.churn_labels(self.clean, self.customers, self.churn_cutoff),
            self.split))

    @property
    def clv_table(self) -> DataFrame:
        return self.stage("clv_table", lambda: snapshots.labelled_table(
            self.clv_features,
            snapshots.clv_targets(self.clean, self.customers, self.clv_cutoff), self.split))

    @property
    def rolling_table(self) -> DataFrame:
        return self.stage("rolling", lambda: rolling.rolling_dataset(
            self.clean, self.split, self.rolling_cfg))

    # --- sequences --------------------------------------------------------------------------
    @property
    def events(self) -> DataFrame:
        return self.stage("events", lambda: sequences.invoice_events(self.clean, self.taxonomy))

    @property
    def sequence_table(self) -> DataFrame:
        return self.stage("sequences", lambda: sequences.rolling_sequences(
            self.events, self.split, self.observation_end, self.settings.sequences))

    @cached_property
    def feature_names(self) -> list[str]:
        keep = set(features.FEATURE_NOTES)
        return [c for c in self.churn_features.columns
                if c in keep or c.startswith("category_affinity_")]


_OPEN: dict[tuple[str, str], Workspace] = {}


def workspace(spark: SparkSession, folder: str) -> Workspace:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, folder)
    return _OPEN[key]


