"""Composed preparation (clean -> split -> encode -> scale).

Applying the fitted state is purely narrow (projections and literal map
lookups): the prepared table keeps the source partitioning, and its only
shuffles are the small fit steps (distinct categories, one aggregation for
the scaler, the summaries of cleaning).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabtune.functions.columns import categorical_columns, date_columns, q, require_flat, resolve_label
from tabtune.operators.clean import clean
from tabtune.operators.encode import apply_label_encoder, fit_label_encoder
from tabtune.operators.scale import apply_scaler, counted_scaler, fit_scaler, scaler_params
from tabtune.operators.split import stratified_split, train_test_split

SUPERVISED = ("regression", "classification")


@dataclass
class PreparedState:
    task: str
    label: str | None
    features: list
    categorical: list
    feature_mapping: DataFrame | None = None
    target_mapping: DataFrame | None = None
    scaler: dict = field(default_factory=dict)
    dropped_columns: list = field(default_factory=list)
    persisted: DataFrame | None = None  # cached deduplicated input; unpersist when done
    n_train: int | None = None  # rows of the train side


def transform(df: DataFrame, task: str, label: str | None = None, key=None,
              test_fraction: float = 0.2, seed: int = 42, stratify: bool = False,
              exact_split: bool = False, unseen: str = "error"):
    """Returns (prepared DataFrame, PreparedState).

    Supervised: features + label + ``split`` column; categorical features
    encoded with codes fitted on train rows, label encoded for
    classification, all features scaled with train mean / population std.
    Clustering: every categorical column encoded and every column scaled
    over the whole table.  Any other task: returned unchanged.

    ``key`` names the row identifier column(s): they drive the hash split,
    are carried through unchanged (first) and are never features.

    Numbers are features as they are; strings, booleans, dates and times are
    categories.  A date or time that only test rows have gets the code after
    the last one, whatever ``unseen`` says about the other categories.  Nested
    columns raise an error that names them.
    """
    keys = [key] if isinstance(key, str) else list(key or [])
    if task in (*SUPERVISED, "clustering"):
        require_flat(df, exclude=keys)
    if task in SUPERVISED:
        label = resolve_label(df, label)
        features = [c for c in df.columns if c != label and c not in keys]
        cats = categorical_columns(df.select(*[F.col(q(c)) for c in features]))
        ordered = df.select(*[F.col(q(c)) for c in keys], *[F.col(q(c)) for c in features],
                            F.col(q(label)))
        if stratify:
            split = stratified_split(ordered, label, key, test_fraction, seed)
        else:
            split = train_test_split(ordered, key, test_fraction, seed, exact=exact_split)
        train = split.where(F.col("split") == "train")
        # one fit (one scan of the train rows) for feature and target codes
        enc_cols = cats + ([label] if task == "classification" else [])
        mapping = fit_label_encoder(train, enc_cols) if enc_cols else None
        fmap = mapping.where(F.col("column") != label) if cats else None
        out = split
        dates = date_columns(df.select(*[F.col(q(c)) for c in features]))
        for some, rule in (([c for c in cats if c not in dates], unseen), (dates, "keep")):
            out = apply_label_encoder(out, fmap, some, rule) if some else out
        tmap = None
        if task == "classification":
            tmap = mapping.where(F.col("column") == label)
            out = apply_label_encoder(out, tmap, [label], unseen)
        scaler, n_train = counted_scaler(out.where(F.col("split") == "train"), features)
        out = apply_scaler(out, scaler)
        state = PreparedState(task, label, features, cats, fmap, tmap, scaler, n_train=n_train)
        return out, state
    if task == "clustering":
        cols = [c for c in df.columns if c not in keys]
        cats = categorical_columns(df, exclude=keys)
        fmap = fit_label_encoder(df, cats) if cats else None
        out = apply_label_encoder(df, fmap, cats, unseen) if cats else df
        scaler = scaler_params(fit_scaler(out, cols))
        out = apply_scaler(out, scaler)
        out = out.select(*[F.col(q(c)) for c in keys], *[F.col(q(c)) for c in cols])
        return out, PreparedState(task, None, cols, cats, fmap, None, scaler)
    return df, PreparedState(task, label, list(df.columns), [])


def preprocess(df: DataFrame, task: str, label: str | None = None, key=None, **kw):
    """C11: clean then transform; returns (prepared DataFrame, PreparedState)."""
    clean_kw = {k: kw.pop(k) for k in list(kw) if k in (
        "drop_nulls", "drop_dups", "alpha", "k", "gate", "exclude", "threshold")}
    if task in SUPERVISED or label is not None:
        label = resolve_label(df, label)
    keys = [key] if isinstance(key, str) else list(key or [])
    cleaned, report = clean(df, task, label, return_report=True, keep=keys, **clean_kw)
    out, state = transform(cleaned, task, label, key=key, **kw)
    state.dropped_columns = report.dropped_columns
    state.persisted = report.persisted
    return out, state


def recombine(train: DataFrame, test: DataFrame) -> DataFrame:
    """Stack train and test rows (label kept in the same row)."""
    return (train.withColumn("split", F.lit("train"))
            .unionByName(test.withColumn("split", F.lit("test"))))


MODEL_OF_TASK = {"regression": "RandomForestRegressor",
                 "classification": "RandomForestClassifier",
                 "clustering": "KMeans"}
REFERENCE_METRIC = {"regression": "Mean Squared Error (MSE)",
                    "classification": "F1-Score",
                    "clustering": "Silhouette Score"}


def task_profile(prepared: DataFrame, task: str, label: str | None = None,
                 features=None) -> DataFrame:
    """n_obs (test rows), n_predictors, n_classes (train), model,
    reference metric and its direction, as one row."""
    from tabtune.operators.metrics import metric_direction_of

    features = features if features is not None else [
        c for c in prepared.columns if c not in (label, "split")]
    metric = REFERENCE_METRIC[task]
    if task in SUPERVISED:
        is_test = F.col("split") == "test"
        agg = prepared.agg(
            F.sum(F.when(is_test, 1).otherwise(0)).cast("long").alias("n_obs"),
            F.count_distinct(F.when(~is_test, F.col(q(label)))).cast("long").alias("n_classes"))
    else:
        agg = prepared.agg(F.count(F.lit(1)).cast("long").alias("n_obs"),
                           F.lit(None).cast("long").alias("n_classes"))
    return agg.select(
        F.lit(task).alias("task"), "n_obs",
        F.lit(len(features)).cast("long").alias("n_predictors"),
        (F.col("n_classes") if task == "classification" else F.lit(None).cast("long")
         ).alias("n_classes"),
        F.lit(MODEL_OF_TASK[task]).alias("model"),
        F.lit(metric).alias("reference_metric"),
        F.lit(metric_direction_of(metric)).alias("direction"))
