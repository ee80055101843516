"""A whole scorer in one folder (S10, S11, L23): cleaning, fitted encodings and model, applied to raw rows.

A scorer is a list of steps and an ML pipeline. A step is a plain description (a dict that JSON can hold) and, where it
learns something, one small fitted table. ``save`` writes a manifest with the steps, every table and the pipeline to one
folder; ``load`` needs nothing else, and scores raw rows (numbers as text, nulls in categories) as the fitting session did.

Steps, in the order given to ``fit_scorer``:

    {"op": "numbers", "columns": {"tenure": "tenure_txt"}, "fill": 0.0}      P4 / P5: text -> number (fill None: nulls stay)
    {"op": "categories", "columns": ["segment"], "filler": "Missing"}        P6
    {"op": "residuals", "total": "total", "monthly": "monthly", "tenure": "tenure"}    E1, E2, E4-E6, null -> 0
    {"op": "medians", "columns": ["tenure"]}                                  L4: exact medians, <c>_is_null
    {"op": "bins", "columns": {"tenure": 15}}                                 D6: <c>_bin
    {"op": "crosses", "pairs": [["segment", "tenure_bin"]]}                   E9, filled first: <a>_X_<b>
    {"op": "scale", "columns": ["tenure"]}                                    D2, in place
    {"op": "ordinal", "columns": ["segment"]}                                 D3: <c>_ord
    {"op": "counts", "columns": ["segment"]}                                  D10: <c>_freq
    {"op": "target", "columns": ["segment"], "smoothing": 20.0}               D7: <c>_te
    {"op": "ordered", "columns": ["segment"], "a": 1.0}                       D9: <c>_cbe (training rows see those before them)
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnforge.functions import clean
from churnforge.functions import features as fe
from churnforge.operators import encode
from churnforge.session import cut_lineage
from churnforge.sources import tables

FORMAT = 1


def _numbers(df, step, _fitted):
    return df.withColumns({out: clean.to_number(source, step.get("fill")) for out, source in step["columns"].items()})


def _categories(df, step, _fitted):
    return df.withColumns({c: clean.fill_category(c, step.get("filler", clean.MISSING)) for c in step["columns"]})


def _residuals(df, step, _fitted):
    made = fe.residual_features(step["total"], step["monthly"], step["tenure"])
    return df.withColumns({c: F.coalesce(x, F.lit(0.0)) for c, x in made.items()})


def _crosses(df, step, _fitted):
    return df.withColumns({f"{a}_X_{b}": fe.cross(a, b, sep="_X_", null_rule="fill") for a, b in step["pairs"]})


def _bins(df, step, fitted):
    return encode.apply_quantile_bins_multi(df, fitted, list(step["columns"]))


# op -> (fit on training rows or None, apply to any rows)
STEPS = {
    "numbers": (None, _numbers),
    "categories": (None, _categories),
    "residuals": (None, _residuals),
    "crosses": (None, _crosses),
    "medians": (lambda df, s, _y: encode.fit_median_imputer(df, s["columns"]),
                lambda df, s, t: encode.apply_median_imputer(df, t, s["columns"])),
    "bins": (lambda df, s, _y: encode.fit_quantile_bins_multi(df, s["columns"]), _bins),
    "scale": (lambda df, s, _y: encode.fit_scaler(df, s["columns"]), lambda df, s, t: encode.apply_scaler(df, t, s["columns"])),
    "ordinal": (lambda df, s, _y: encode.fit_ordinal(df, s["columns"]), lambda df, s, t: encode.apply_ordinal(df, t, s["columns"])),
    "counts": (lambda df, s, _y: encode.fit_count_encoder(df, s["columns"]),
               lambda df, s, t: encode.apply_count_encoding(df, t, s["columns"])),
    "target": (lambda df, s, y: encode.fit_target_encoder(df, s["columns"], y, smoothing=s.get("smoothing", 20.0)),
               lambda df, s, t: encode.apply_target_encoding(df, t, s["columns"])),
    "ordered": (lambda df, s, y: encode.fit_ordered_encoder(df, s["columns"], y, a=s.get("a", 1.0)),
                lambda df, s, t: encode.apply_target_encoding(df, t, s["columns"], suffix="_cbe")),
}


@dataclass
class Scorer:
    steps: list[dict]
    tables: list[DataFrame | None]
    model: object | None                #: PipelineModel, or None: a preprocessor only
    inputs: dict[str, str]              #: raw columns and their types
    id_col: str
    labels: list[str] | None = None     #: names of the model's classes, for the positive one (S12)

    def features(self, raw: DataFrame) -> DataFrame:
        """Raw rows with the columns of all steps."""
        missing = [c for c in (self.id_col, *self.inputs) if c not in raw.columns]
        if missing:
            raise ValueError(f"the rows lack the columns {missing}")
        df = raw.select(self.id_col, *[F.col(c).cast(kind).alias(c) for c, kind in self.inputs.items() if c != self.id_col])
        for step, table in zip(self.steps, self.tables, strict=True):
            df = STEPS[step["op"]][1](df, step, table)
        return df

    def score(self, raw: DataFrame) -> DataFrame:
        """(id, score) of raw rows: one row for each, whatever it holds."""
        if self.model is None:
            raise ValueError("this scorer has no model")
        scored = tables.positive_probability(self.model.transform(self.features(raw)), labels=self.labels)
        return scored.select(self.id_col, "score")


def fit_scorer(raw: DataFrame, steps: list[dict], label: str, id_col: str = "id", family: str | None = "gbt", features=(),
               categorical=(), onehot=(), labels=None, seed: int = 42, **params) -> Scorer:
    """Fit the steps one after another on raw training rows (``label`` is 0 / 1), then the model on ``features``.
    ``family`` None fits a preprocessor without a model. Raw columns are those that the steps, the features and
    the categories name and ``raw`` has."""
    from churnforge.operators.models import fit_family
    from churnforge.session import balance
    unknown = [s["op"] for s in steps if s["op"] not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps {unknown}")
    named = {c for s in steps for c in _named(s)} | set(features) | set(categorical) | set(onehot)
    inputs = {f.name: f.dataType.simpleString() for f in raw.schema.fields if f.name in named and f.name not in (label, id_col)}
    df = cut_lineage(balance(raw.select(id_col, label, *inputs)))
    state: list[DataFrame | None] = []
    for step in steps:
        fit, apply = STEPS[step["op"]]
        table = cut_lineage(fit(df, step, label)) if fit else None
        if step["op"] == "ordered":
            df = encode.ordered_encoding_wide(df, step["columns"], label, id_col, a=step.get("a", 1.0), seed=seed)
        else:
            df = apply(df, step, table)
        state.append(table)
    model = None
    if family is not None:
        df = cut_lineage(df)
        model = fit_family(df, family, label, features, categorical, onehot, n_rows=df.count(), **params)
    return Scorer(list(steps), state, model, inputs, id_col, list(labels) if labels is not None else None)


def _named(step: dict) -> list[str]:
    columns = step.get("columns", ())
    out = [*columns, *(columns.values() if step["op"] == "numbers" else ())]
    return [*out, *(c for pair in step.get("pairs", ()) for c in pair), *(step[c] for c in ("total", "monthly", "tenure") if c in step)]


def save_scorer(scorer: Scorer, path: str) -> None:
    """Write the scorer to a folder. The manifest comes last: a folder without one is not a scorer, so that a
    save that was cut off is never loaded."""
    spark = SparkSession.active()
    tables.delete_path(spark, f"{path}/manifest")
    for i, table in enumerate(scorer.tables):
        if table is not None:
            tables.save_fitted(table, f"{path}/steps/{i:02d}")
    if scorer.model is not None:
        tables.save_model(scorer.model, f"{path}/model")
    manifest = {"format": FORMAT, "steps": scorer.steps, "fitted": [t is not None for t in scorer.tables], "model": scorer.model is not None,
                "inputs": scorer.inputs, "id": scorer.id_col, "labels": scorer.labels}
    spark.createDataFrame([(json.dumps(manifest),)], "manifest string").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    """Read a scorer back; nothing of the training data is needed."""
    tables.require_sources(spark, [f"{path}/manifest"])
    manifest = json.loads(spark.read.parquet(f"{path}/manifest").first()["manifest"])
    if manifest["format"] != FORMAT:
        raise ValueError(f"scorer format {manifest['format']}, this library reads {FORMAT}")
    state = [tables.load_fitted(spark, f"{path}/steps/{i:02d}") if fitted else None for i, fitted in enumerate(manifest["fitted"])]
    model = tables.load_model(f"{path}/model") if manifest["model"] else None
    return Scorer(manifest["steps"], state, model, manifest["inputs"], manifest["id"], manifest["labels"])
