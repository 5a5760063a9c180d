"""Cost models: the registry, the sweeps, scores and importances.

Boosters are grown here on histograms (``boosting``), the forest of unbounded depth by handing small
nodes over to tasks (``forest``), and support vectors by dual descent over landmarks (``svr``); the
linear learner is the one of ``pyspark.ml``. Fits of a sweep run side by side, and each
finished one is recorded in a ledger (``ledger``), so that a sweep that is started again repeats
only what is missing.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from threading import Lock

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.columns import GAIN_SELECTION_DROP, SPLIT_SELECTION_DROP
from trialloom.functions.ordering import rank_within
from trialloom.operators import boosting, forest, histograms, svr
from trialloom.operators.boosting import Booster, Boosting
from trialloom.operators.clean import BUNDLE, INSTANCE
from trialloom.operators.features import LABEL, removed_features
from trialloom.operators.forest import Forest, ForestSpec
from trialloom.operators.histograms import spread
from trialloom.operators.ledger import Ledger, at_once, fingerprint, source_digest
from trialloom.operators.splits import SEED, TEST_SIZE, with_split
from trialloom.operators.svr import Svr, SvrSpec
from trialloom.operators.tasks import PRED, TRUE, sweep_summary, task_cases, task_summary
from trialloom.session import shared_dir, staged

# Tree count and, per learner, the rate, depth, penalties and seeds of the registry.
# The first booster draws no rows, as its row share only counts together with a drawing interval.
ROUNDS = 200
BOOSTED_A = Boosting(
    ROUNDS, rate=0.2, depth=3, l2=0.01, columns=0.7, leaf_wise=True, most_leaves=31, least_rows=20, least_hessian=1e-3, seed=0
)
BOOSTED_B = Boosting(ROUNDS, rate=0.01, depth=5, l2=0.01, columns=0.7, least_hessian=2.0, seed=0)
BOOSTED_C = Boosting(ROUNDS, rate=0.1, depth=5, l2=0.0, seed=7)
FOREST_SEED = 7

_COLUMNS = {"featuresCol": "features", "labelCol": LABEL, "predictionCol": PRED}


@dataclass(frozen=True)
class Learner:
    """Name and options of a learner; called with the feature count it gives the stages after assembly."""

    name: str
    options: object
    make: Callable[[int, object], list[Estimator]] = field(compare=False, repr=False)

    def __call__(self, width: int) -> list[Estimator]:
        return self.make(width, self.options)


def _boosted(name: str, spec: Boosting, rounds: int) -> Learner:
    return Learner(name, replace(spec, rounds=rounds), lambda width, own: [Booster(own, width, LABEL, PRED)])


def _linear(width: int, _: object) -> list[Estimator]:
    return [LinearRegression(regParam=0.0, **_COLUMNS)]


def _kernel(width: int, spec: SvrSpec) -> list[Estimator]:
    return [
        StandardScaler(withMean=True, inputCol="features", outputCol="scaled"),
        Svr(spec, width, "scaled", LABEL, PRED),
    ]


def model_registry(rounds: int = ROUNDS) -> dict[str, Learner]:
    """Learners by name."""
    learners = [
        _boosted("boosted_a", BOOSTED_A, rounds),
        _boosted("boosted_b", BOOSTED_B, rounds),
        Learner("random_forest", ForestSpec(rounds, FOREST_SEED), lambda width, own: [Forest(own, width, LABEL, PRED)]),
        _boosted("gradient_boosting", BOOSTED_C, rounds),
        Learner("kernel", SvrSpec(), _kernel),
        Learner("linear_regression", None, _linear),
    ]
    return {learner.name: learner for learner in learners}


def usable_features(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Features with any value at all; an all-null one has no median to fill in."""
    counts = df.agg(*[F.count(F.when(~F.isnan(c), F.col(c))).alias(c) for c in features]).first()
    return [c for c in features if counts[c]]


SCHEMES = {"random": (f"meta_{INSTANCE}", f"meta_{BUNDLE}"), "group": (f"meta_{INSTANCE}",)}


@dataclass
class Prepared:
    """Rows of one holdout with their assembled features, written once for all learners.

    ``hollow`` are features without any value on the training side: they are not assembled.
    """

    rows: DataFrame
    features: list[str]
    hollow: list[str] = field(default_factory=list)


def prepare(
    inputs: DataFrame,
    features: Sequence[str],
    scheme: str,
    *,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
) -> Prepared:
    """Split by a scheme, then fill gaps with the training side's medians and assemble."""
    split = with_split(inputs, SCHEMES[scheme], test_size=test_size, seed=seed)
    train = split.where(F.col("split") == "train")
    usable = usable_features(train, features)
    filled = [f"_filled_{c}" for c in usable]
    assembly = Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=usable, outputCols=filled),
            VectorAssembler(inputCols=filled, outputCol="features"),
        ]
    ).fit(train)
    meta = [c for c in split.columns if c.startswith("meta_")]
    rows = assembly.transform(split).select(*meta, LABEL, "split", "features")
    return Prepared(staged(rows, "prepared"), usable, [c for c in features if c not in usable])


def fit(prepared: Prepared, stages: Callable[[int], list[Estimator]]) -> PipelineModel:
    """Fit a learner on the training side only."""
    shared_dir(prepared.rows.sparkSession)
    train = spread(prepared.rows.where(F.col("split") == "train"))
    return Pipeline(stages=stages(len(prepared.features))).fit(train)


def score(model: PipelineModel, prepared: Prepared) -> DataFrame:
    """Keys, split, true and predicted measure of both sides; keys ride along with the rows."""
    meta = [c for c in prepared.rows.columns if c.startswith("meta_")]
    return model.transform(prepared.rows).select(
        *[F.col(c).alias(c.removeprefix("meta_")) for c in meta], "split", F.col(LABEL).alias(TRUE), PRED
    )


def holdout(
    inputs: DataFrame,
    features: Sequence[str],
    stages: Callable[[int], list[Estimator]],
    scheme: str,
    *,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
) -> tuple[PipelineModel, Prepared, DataFrame]:
    """One learner under one holdout: the model, its data and its scores."""
    prepared = prepare(inputs, features, scheme, test_size=test_size, seed=seed)
    model = fit(prepared, stages)
    return model, prepared, score(model, prepared)


@dataclass
class Sweep:
    """Results of a sweep, each a long table with a ``model`` column."""

    summary: DataFrame
    task_summary: DataFrame
    cases: DataFrame
    importances: DataFrame
    errors: DataFrame
    failures: dict[str, str] = field(default_factory=dict)

    def whole(self) -> Sweep:
        """This sweep, if no model failed; its tables but ``errors`` don't tell that one is missing."""
        if self.failures:
            raise RuntimeError(f"models that failed: {self.failures}")
        return self


#: Digest of the learners' code, so that what other code fitted is not taken for a fit of this one.
_CODE = source_digest(boosting, forest, histograms, svr, sys.modules[__name__])


@dataclass
class Fits:
    """Fits of the same inputs; each is made once and recorded in the ledger of the inputs.

    A later ``Fits`` on equal inputs, also of another driver on the same shared folder, reads what
    is recorded. Up to ``side_by_side`` fits run at the same time.
    """

    inputs: DataFrame
    test_size: float = TEST_SIZE
    seed: int = SEED
    side_by_side: int = 4
    ready: dict[tuple, Prepared] = field(default_factory=dict)
    ledger: Ledger | None = None
    _lock: Lock = field(default_factory=Lock)

    def _ledger(self) -> Ledger:
        with self._lock:
            if self.ledger is None:
                self.ledger = Ledger(self.inputs.sparkSession, fingerprint(self.inputs, self.test_size, self.seed))
        return self.ledger

    def prepared(self, features: Sequence[str], scheme: str) -> Prepared:
        key = (scheme, *features)
        with self._lock:
            if key not in self.ready:
                self.ready[key] = prepare(self.inputs, features, scheme, test_size=self.test_size, seed=self.seed)
            return self.ready[key]

    def _fitted(self, name: str, features: Sequence[str], stages: Callable, scheme: str) -> str:
        """Entry of one learner under one holdout: its ``scores`` and, for trees, its ``importances``."""
        own = stages if isinstance(stages, Learner) else name

        def make() -> dict[str, DataFrame]:
            ready = self.prepared(features, scheme)
            model = fit(ready, stages)
            tables = {"scores": score(model, ready)}
            if hasattr(model.stages[-1], "splits"):
                tables["importances"] = feature_importance(model, ready.features, ready.hollow)
            return tables

        return self._ledger().entry((_CODE, name, repr(own), scheme, *features), make)

    def scores(self, name: str, features: Sequence[str], stages: Callable, scheme: str) -> DataFrame:
        """Scores of one learner under one holdout, with ``model`` and ``scheme``, fitted and written once."""
        rows = self._ledger().read(self._fitted(name, features, stages, scheme), "scores")
        return rows.withColumns({"model": F.lit(name), "scheme": F.lit(scheme)})

    def importances(self, name: str, features: Sequence[str], stages: Callable, scheme: str = "group") -> DataFrame:
        return self._ledger().read(self._fitted(name, features, stages, scheme), "importances")

    def make_all(self, wanted: Sequence[tuple[str, Sequence[str], Callable, str]]) -> dict[tuple[str, str], Exception]:
        """Make missing fits side by side; the errors of those that failed, by (model, scheme)."""
        self._ledger()
        for _, features, _, scheme in wanted:
            self.prepared(features, scheme)
        jobs = {(name, scheme): (self._fitted, name, features, stages, scheme) for name, features, stages, scheme in wanted}
        return at_once(self.inputs.sparkSession, jobs, self.side_by_side)


def _tables(spark, scored, importances, failures, complete) -> Sweep:
    errors = spark.createDataFrame(list(failures.items()), "model string, error string")
    if not scored:
        raise RuntimeError(f"every model failed: {failures}")
    rows = scored[0]
    for other in scored[1:]:
        rows = rows.unionByName(other)
    grouped = rows.where((F.col("scheme") == "group") & (F.col("split") == "test"))
    cases = task_cases(grouped, by=["model"], small_groups=complete)
    listed = None
    for table in importances:
        listed = table if listed is None else listed.unionByName(table)
    if listed is None:
        listed = spark.createDataFrame([], IMPORTANCE_SCHEMA)
    return Sweep(
        summary=sweep_summary(rows),
        task_summary=task_summary(cases, by=["model"]),
        cases=cases,
        importances=listed,
        errors=errors,
        failures=failures,
    )


def model_sweep(
    inputs: DataFrame,
    features: Sequence[str],
    *,
    registry: Mapping[str, Callable[[int], list[Estimator]]] | None = None,
    importance_of: Sequence[str] = ("boosted_a",),
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    complete: bool = False,
    fits: Fits | None = None,
) -> Sweep:
    """Every learner under both holdouts; one that fails is noted and the sweep goes on.

    ``complete`` says that an instance has 64 rows; ``fits`` may hold earlier fits of the inputs.

    Only names are looped over; each fit and each score is a distributed job. Learners
    share the prepared rows of a holdout, and scores are written to the shared folder, so
    that later tables do not score again.
    """
    variants = {
        name: (features, stages, name in importance_of) for name, stages in (registry or model_registry()).items()
    }
    return _sweep(inputs, variants, fits or Fits(inputs, test_size, seed), complete)


def _sweep(inputs, variants, fits: Fits, complete: bool) -> Sweep:
    spark = inputs.sparkSession
    wanted = [(name, own, stages, scheme) for name, (own, stages, _) in variants.items() for scheme in SCHEMES]
    errors = fits.make_all(wanted)
    failures: dict[str, str] = {}
    for (name, _), error in errors.items():
        failures.setdefault(name, str(error))
    scored, importances = [], []
    for name, (features, stages, wants_importance) in variants.items():
        if name in failures:
            continue
        scored += [fits.scores(name, features, stages, scheme) for scheme in SCHEMES]
        if wants_importance:
            importances.append(fits.importances(name, features, stages).withColumn("model", F.lit(name)))
    return _tables(spark, scored, importances, failures, complete)


def ablation_sweep(
    inputs: DataFrame,
    features: Sequence[str],
    *,
    schemes: Mapping[str, Sequence[str]] | None = None,
    rounds: int = ROUNDS,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    complete: bool = False,
    fits: Fits | None = None,
) -> Sweep:
    """The first booster without each list of features; ``removed_feature_count`` counts those present."""
    schemes = schemes or {"split_manual": SPLIT_SELECTION_DROP, "gain_manual": GAIN_SELECTION_DROP}
    stages = _boosted("boosted_a", BOOSTED_A, rounds)
    variants = {
        name: ([c for c in features if c not in unwanted], stages, True) for name, unwanted in schemes.items()
    }
    result = _sweep(inputs, variants, fits or Fits(inputs, test_size, seed), complete)
    counts = F.create_map(
        *[F.lit(x) for n, unwanted in schemes.items() for x in (n, len(removed_features(features, unwanted)))]
    )
    result.summary = result.summary.withColumn("removed_feature_count", counts[F.col("model")])
    return result


IMPORTANCE_SCHEMA = (
    "feature string, split_importance long, gain_importance double, split_rank long, gain_rank long, model string"
)


def feature_importance(model: PipelineModel, names: Sequence[str], hollow: Sequence[str] = ()) -> DataFrame:
    """Splits and total gain of each feature over all trees of a booster, with dense ranks.

    ``names`` are the assembled features; ``hollow`` ones, which have no value, are listed with 0.
    The splits of a booster are bounded by its rounds and leaves.
    """
    spark = SparkSession.active()
    used = spark.createDataFrame(model.stages[-1].splits(), "index int, gain double").groupBy("index").agg(
        F.count(F.lit(1)).alias("split_importance"), F.sum("gain").alias("gain_importance")
    )
    listed = F.posexplode(F.array(*[F.lit(c) for c in [*names, *hollow]])).alias("index", "feature")
    every = spark.range(1).select(listed)
    table = every.join(used, "index", "left").select(
        "feature",
        F.coalesce("split_importance", F.lit(0)).alias("split_importance"),
        F.coalesce("gain_importance", F.lit(0.0)).alias("gain_importance"),
    )
    for kind in ("split", "gain"):
        table = rank_within(
            table,
            [],
            f"{kind}_importance",
            name=f"{kind}_rank",
            method="dense",
            ascending=False,
            small_groups=True,  # one row for each feature
        )
    return table.orderBy(F.col("gain_importance").desc(), "feature")
