"""Fit / apply encoders (D1-D13). A fitted encoder is a small table; applying it is a join
(broadcast when its checked size allows, a shuffle join otherwise) or a projection."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnforge.operators.quantiles import exact_quantiles
from churnforge.operators.running import prefix_sums, row_numbers
from churnforge.session import cut_lineage

# Physical choices for a fitted map; values and types are the same whichever is taken. Maps up to
# MAX_LITERAL_ENTRIES rows are inlined as literal maps (a lookup scans its keys, so this stays small);
# up to MAX_BROADCAST_ROWS rows and MAX_BROADCAST_BYTES of keys they are broadcast; larger ones are
# shuffled (AQE splits a hot key's partition). More than MAX_LOOKUP_JOINS columns are looked up batch by
# batch inside the partitions their rows already have; with a map beyond the bounds they go to long form:
# one join for all of them. COUNTED_CELLS: (column, key) counts that a task holds before it hands them on.
MAX_LITERAL_ENTRIES = 64
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_BYTES = 32 << 20
MAX_LOOKUP_JOINS = 8
COUNTED_CELLS = 400_000


def broadcast_if_small(table: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast only a table whose row count was checked to be within the bound. The table is
    written to a reliable checkpoint first, so the count and the join read one evaluation."""
    table = cut_lineage(table)
    return F.broadcast(table) if table.count() <= max_rows else table


def long_form(df: DataFrame, cols, keep=()) -> DataFrame:
    """(keep..., feature, key): one row per (row, categorical column), keys as text."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("key")) for c in cols])
    return df.select(*keep, F.explode(pairs).alias("_kv")).select(*keep, "_kv.feature", "_kv.key")


# ---------------------------------------------------------------- D2 standard scaler
def fit_scaler(df: DataFrame, cols) -> DataFrame:
    """D2 fit: one row with mean and population std per column."""
    return df.agg(*[e for c in cols for e in (F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std"))])


def apply_scaler(df: DataFrame, stats: DataFrame, cols, suffix: str = "") -> DataFrame:
    """D2 apply: (x - mean) / std; a zero-variance column gives 0. The fitted state is two numbers
    per column, read once and inlined as literals (a flat plan Catalyst can constant-fold)."""
    return scale_by(df, stats.first(), cols, suffix)


def scale_by(df: DataFrame, row, cols, suffix: str = "") -> DataFrame:
    """D2 apply with the fitted row at hand, for several frames."""
    out = {}
    for c in cols:
        mean = F.lit(row[f"{c}__mean"]).cast("double")
        std = F.lit(row[f"{c}__std"]).cast("double")
        z = F.try_divide(F.col(c) - mean, F.nullif(std, F.lit(0.0)))
        out[c + suffix] = F.when(F.col(c).isNull(), F.lit(None)).otherwise(F.coalesce(z, F.lit(0.0)))
    return df.withColumns(out)


def standard_scale(df: DataFrame, cols, fit_df: DataFrame | None = None, suffix: str = "") -> DataFrame:
    return apply_scaler(df, fit_scaler(fit_df if fit_df is not None else df, cols), cols, suffix)


# ---------------------------------------------------------------- D3 ordinal encoder
def fit_ordinal(df: DataFrame, cols) -> DataFrame:
    """D3 fit: (feature, key, code), code = 0-based position of the key in sorted order."""
    keys = long_form(df, cols).filter(F.col("key").isNotNull()).distinct()
    return row_numbers(keys, ["key"], ["feature"], out="code").withColumn("code", F.col("code").cast("int"))


@dataclass(frozen=True)
class Lookup:
    """A fitted (feature, key) -> value map, sized and read once and applied to any number of frames."""
    kind: T.DataType
    literals: dict | None = None        # feature -> [(key, value)]
    table: DataFrame | None = None      # feature, key, value
    small: bool = True                  # within the broadcast bounds
    prior: float | None = None          # of a target encoding


def resolve_lookup(fitted: DataFrame, value: str, prior: str | None = None, max_literals: int = MAX_LITERAL_ENTRIES,
                   max_broadcast_rows: int = MAX_BROADCAST_ROWS) -> Lookup:
    """Choose how a fitted map is held. One job for a map that can be inlined, two more for others."""
    kind = fitted.schema[value].dataType
    cols = ["feature", "key", F.col(value).alias("value"), *([F.col(prior).alias("prior")] if prior else [])]
    table = fitted.select(*cols)
    head = table.limit(max_literals + 1).collect() if max_literals >= 0 else []
    if len(head) <= max_literals:
        by_col: dict = {}
        for r in head:
            by_col.setdefault(r["feature"], []).append((r["key"], r["value"]))
        return Lookup(kind, literals=by_col, prior=head[0]["prior"] if prior and head else None)
    table = cut_lineage(table)
    size = table.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("key")).alias("bytes"),
                     *([F.max("prior").alias("prior")] if prior else [])).first()
    small = size["n"] <= max_broadcast_rows and (size["bytes"] or 0) <= MAX_BROADCAST_BYTES
    return Lookup(kind, table=table.drop("prior"), small=small, prior=size["prior"] if prior else None)


def _plain(kind: T.DataType) -> bool:
    """Types that travel to Python batches and back unchanged."""
    return isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType, T.FractionalType, T.DateType, T.BinaryType)) or (
        isinstance(kind, T.ArrayType) and _plain(kind.elementType)) or (
        isinstance(kind, T.StructType) and all(_plain(f.dataType) for f in kind.fields))


def _batch_lookup(df: DataFrame, look: Lookup, cols, suffix: str, keep) -> DataFrame:
    """The values of all listed columns by one pass over the rows, without a shuffle: a map within the broadcast
    bounds goes to the tasks once, and each batch's keys are found in it by hashing, column by column."""
    spark = df.sparkSession
    fitted = look.table.toArrow()                # at most MAX_BROADCAST_ROWS rows and MAX_BROADCAST_BYTES of keys
    kind = fitted.schema.field("value").type
    by_col = {}
    for c in cols:
        part = fitted.filter(pc.equal(fitted["feature"], c))
        by_col[c] = (part["key"].combine_chunks().cast(pa.string()), part["value"].combine_chunks())
    shared = spark.sparkContext.broadcast([by_col[c] for c in cols])
    keys = [f"_lk_{i}" for i in range(len(cols))]
    rows = df.select(*keep, *[F.col(c).cast("string").alias(k) for c, k in zip(cols, keys, strict=True)])
    schema = T.StructType([*df.select(*keep).schema.fields, *[T.StructField(c + suffix, look.kind) for c in cols]])
    n_kept = len(keep)

    def looked(batches):
        for batch in batches:
            found = []
            for (known, values), own in zip(shared.value, batch.columns[n_kept:], strict=True):
                at = pc.index_in(own.cast(pa.string()), value_set=known)
                found.append(values.take(at) if len(values) else pa.nulls(batch.num_rows, kind))
            yield pa.RecordBatch.from_arrays(batch.columns[:n_kept] + found, names=schema.names)

    return rows.mapInArrow(looked, schema)


def apply_lookup(df: DataFrame, fitted: DataFrame | Lookup, cols, value: str, default, suffix: str,
                 max_joins: int = MAX_LOOKUP_JOINS, keep=None, **bounds) -> DataFrame:
    """Put one value per (feature, key) onto each listed column; a key that was not fitted -> default.

    Null is a key like any other: it meets a fitted null key, else gets the default. Rows are never
    merged, whatever ids they repeat: the long form keys them by a row number of its own. ``keep``: the
    columns of ``df`` to carry beside the values (default: all)."""
    look = fitted if isinstance(fitted, Lookup) else resolve_lookup(fitted, value, **bounds)
    kept = list(keep) if keep is not None else df.columns

    def filled(x: Column) -> Column:
        x = x.cast(look.kind)
        return x if default is None else F.coalesce(x, (default if isinstance(default, Column) else F.lit(default)).cast(look.kind))

    if look.literals is not None:
        return df.select(*kept, *[filled(_literal_lookup(look.literals.get(c, []), F.col(c))).alias(c + suffix) for c in cols]) \
            if keep is not None else df.withColumns({c + suffix: filled(_literal_lookup(look.literals.get(c, []), F.col(c))) for c in cols})
    hint = F.broadcast if look.small else (lambda t: t)
    if (look.small and len(cols) <= max_joins) or df.isStreaming:       # a stream's rows are never regrouped
        out = df
        for c in cols:
            part = look.table.filter(F.col("feature") == c).select(F.col("key").alias("_lk_key"), F.col("value").alias("_lk_value"))
            out = out.join(hint(part), F.col(c).cast("string").eqNullSafe(F.col("_lk_key")), "left") \
                .withColumn(c + suffix, filled(F.col("_lk_value"))).drop("_lk_key", "_lk_value")
        return out if keep is None else out.select(*kept, *[c + suffix for c in cols])
    if look.small and all(_plain(f.dataType) for f in [*df.select(*kept).schema.fields, T.StructField("value", look.kind)]) \
            and not {c + suffix for c in cols} & set(kept):
        out = _batch_lookup(df, look, cols, suffix, kept)
        return out if default is None else out.withColumns({c + suffix: filled(F.col(c + suffix)) for c in cols})
    # row numbers must not change between the two uses of the rows: a reliable checkpoint holds them
    rows = cut_lineage(df.withColumn("_lk_row", F.monotonically_increasing_id()))
    long = long_form(rows, cols, keep=["_lk_row"]).alias("l")
    looked = long.join(hint(look.table).alias("t"), (F.col("l.feature") == F.col("t.feature")) & F.col("l.key").eqNullSafe(F.col("t.key")))
    wide = looked.groupBy("l._lk_row").agg(*[F.max(F.when(F.col("l.feature") == c, F.col("t.value"))).alias(f"_lk_{i}")
                                             for i, c in enumerate(cols)])
    out = rows.join(wide, "_lk_row", "left")
    out = out.withColumns({c + suffix: filled(F.col(f"_lk_{i}")) for i, c in enumerate(cols)}) \
        .drop("_lk_row", *[f"_lk_{i}" for i in range(len(cols))])
    return out if keep is None else out.select(*kept, *[c + suffix for c in cols])


def _literal_lookup(pairs: list, key: Column) -> Column:
    known = [(k, v) for k, v in pairs if k is not None]
    of_null = next((F.lit(v) for k, v in pairs if k is None), F.lit(None))
    if not known:
        return F.when(key.isNull(), of_null)
    found = F.try_element_at(F.create_map(*[x for k, v in known for x in (F.lit(k), F.lit(v))]), key.cast("string"))
    return F.when(key.isNull(), of_null).otherwise(found)


def apply_ordinal(df: DataFrame, fitted: DataFrame, cols, unknown: int = -1, suffix: str = "_ord") -> DataFrame:
    """D3 apply: unknown or null -> -1."""
    return apply_lookup(df, fitted, cols, "code", unknown, suffix)


# ---------------------------------------------------------------- D4 one-hot, D5 normaliser, D1 pipeline
def one_hot_stages(cols, suffix: str = "_ohe"):
    """StringIndexer(keep) + OneHotEncoder(dropLast): the 'unknown' slot is last and dropped,
    so unseen (and null) categories become all zeros; no real category is dropped."""
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    idx = StringIndexer(inputCols=list(cols), outputCols=[c + "_idx" for c in cols],
                        handleInvalid="keep", stringOrderType="alphabetAsc")
    # the indexer's 'unknown' index is the last category the encoder sees; dropLast removes it
    ohe = OneHotEncoder(inputCols=[c + "_idx" for c in cols], outputCols=[c + suffix for c in cols],
                        dropLast=True)
    return [idx, ohe]


def l2_normalize(cols) -> dict[str, Column]:
    """D5 on plain numeric columns: x / ||row||_2 (a zero row stays zero)."""
    norm = F.sqrt(sum((F.coalesce(F.col(c), F.lit(0.0)) ** 2 for c in cols), F.lit(0.0)))
    return {c: F.coalesce(F.try_divide(F.col(c), F.nullif(norm, F.lit(0.0))), F.lit(0.0)) for c in cols}


def fit_preprocessor(df: DataFrame, numeric, categorical) -> tuple[DataFrame, DataFrame]:
    """D1 fit: D2 statistics of the numerics and D3 codes of the categories, two small tables
    (sources.save_fitted / load_fitted keep them)."""
    return fit_scaler(df, numeric), fit_ordinal(df, categorical)


def apply_preprocessor(df: DataFrame, fitted: tuple[DataFrame, DataFrame], numeric, categorical) -> DataFrame:
    """D1 apply, the same for every split: numerics scaled in place (population std), categories as
    ``<c>_ord`` (unknown or null -> -1)."""
    return apply_ordinal(apply_scaler(df, fitted[0], numeric), fitted[1], categorical)


# ---------------------------------------------------------------- D6 quantile bins
def fit_quantile_bins(df: DataFrame, col: str, q: int) -> DataFrame:
    """D6 fit: one row holding the sorted distinct edges at 0, 1/q, ..., 1 (duplicates dropped)."""
    qs = exact_quantiles(df, col, [i / q for i in range(q + 1)])
    return qs.agg(F.array_sort(F.array_distinct(F.collect_list("q"))).alias("edges"))


def fit_quantile_bins_multi(df: DataFrame, bins: dict) -> DataFrame:
    """D6 fit for several columns in ONE distributed pass: rows (feature, edges). The columns go to
    long form (feature, value); each feature keeps only its own probabilities."""
    probs = sorted({i / q for q in bins.values() for i in range(q + 1)})
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x"))
                                         for c in bins])).alias("_kv")).select("_kv.feature", "_kv.x")
    qs = exact_quantiles(long, "x", probs, ["feature"])
    wanted = F.create_map(*[x for c, q in bins.items()
                            for x in (F.lit(c), F.array(*[F.lit(i / q) for i in range(q + 1)]))])
    keep = qs.filter(F.array_contains(F.element_at(wanted, F.col("feature")), F.col("p")))
    return keep.groupBy("feature").agg(F.array_sort(F.array_distinct(F.collect_list("q"))).alias("edges"))


def apply_quantile_bins_multi(df: DataFrame, fitted: DataFrame, cols, suffix: str = "_bin") -> DataFrame:
    """D6 apply for the columns fitted together: ONE scalar subquery yields a feature -> edges map,
    so the shared fit runs once."""
    edge_map = fitted.agg(F.map_from_entries(F.collect_list(F.struct("feature", "edges")))).scalar()
    out = df.withColumn("_bin_edges", edge_map)
    out = out.withColumns({c + suffix: bin_expr(F.col(c), F.coalesce(F.element_at(F.col("_bin_edges"), F.lit(c)),
                                                                      F.array().cast("array<double>")))
                           for c in cols})
    return out.drop("_bin_edges")


def bin_expr(x: Column, edges: Column) -> Column:
    """Right-closed bins (lo, hi], lowest edge included; outside the edges or fewer than two edges -> null."""
    below = F.size(F.filter(edges, lambda e: e < x))
    ok = (F.size(edges) >= 2) & (x >= F.element_at(edges, 1)) & (x <= F.element_at(edges, -1))
    return F.when(ok, F.greatest(below - 1, F.lit(0)).cast("int"))


def apply_quantile_bins(df: DataFrame, fitted: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """D6 apply. The edges enter as a scalar subquery, so fit and apply are one query and AQE shares
    their common exchanges (measured faster than fitting eagerly). The subquery is bound to a column
    first: Spark does not allow subqueries inside the lambda itself."""
    tmp = f"_{col}_edges"
    with_edges = df.withColumn(tmp, fitted.select("edges").scalar())
    return with_edges.withColumn(out or f"{col}_bin", bin_expr(F.col(col), F.col(tmp))).drop(tmp)


# ---------------------------------------------------------------- D7 smoothed target encoding
def _smooth(n: Column, s: Column, prior: Column, smoothing: float, min_samples_leaf: float) -> Column:
    w = F.lit(1.0) / (F.lit(1.0) + F.exp(-(n - F.lit(float(min_samples_leaf))) / F.lit(float(smoothing))))
    mean = F.try_divide(s, n.cast("double"))
    return F.when(n > 0, prior * (F.lit(1.0) - w) + mean * w).otherwise(prior)


def fit_target_encoder(df: DataFrame, cols, label: str, smoothing: float = 20.0,
                       min_samples_leaf: float = 20.0) -> DataFrame:
    """D7 fit on all given rows: (feature, key, n, enc, prior). Null keys are a category of their own."""
    y = F.col(label).cast("double")
    prior = F.lit(df.select(F.avg(y)).first()[0]).cast("double")
    stats = long_form(df.select(*cols, label), cols, keep=[label]).groupBy("feature", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("s"))
    return cut_lineage(stats.select("feature", "key", "n", _smooth(F.col("n"), F.col("s"), prior, smoothing,
                                                                   min_samples_leaf).alias("enc"),
                                    prior.alias("prior")))


def fit_target_stats(df: DataFrame, cols, label: str) -> tuple[DataFrame, float]:
    """D7 statistics without a smoothing: ((feature, key, stat = struct<n, s>), prior)."""
    y = F.col(label).cast("double")
    prior = df.select(F.avg(y)).first()[0]
    stats = long_form(df.select(*cols, label), cols, keep=[label]).groupBy("feature", "key").agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s")).alias("stat"))
    return cut_lineage(stats), prior


def apply_target_stats(df: DataFrame, stats: DataFrame, cols) -> DataFrame:
    """Columns ``<c>_stat`` with the counts of the row's key (null: a key that was not fitted)."""
    return apply_lookup(df, resolve_lookup(stats, "stat", max_literals=-1), cols, "stat", None, "_stat")


def smoothed_stats(col: str, prior: float, smoothing: float, min_samples_leaf: float = 20.0) -> Column:
    """D7 value of a column whose ``<c>_stat`` is at hand: the same as a fit with this smoothing."""
    n, s = F.coalesce(F.col(f"{col}_stat.n"), F.lit(0)), F.coalesce(F.col(f"{col}_stat.s"), F.lit(0.0))
    return _smooth(n, s, F.lit(prior).cast("double"), smoothing, min_samples_leaf)


def _fold_counts(df: DataFrame, cols, label: str, fold_col: str, k: int) -> DataFrame:
    """Partial counts (feature, key, n_all, s_all, n0, s0, ...) of many columns: every batch is counted column by
    column, and a task adds up what it has seen while that is at most COUNTED_CELLS rows. A sum over no label is null."""
    fold = F.when((F.col(fold_col) >= 0) & (F.col(fold_col) < k), F.col(fold_col).cast("int")).otherwise(F.lit(k))
    rows = df.select(F.coalesce(fold, F.lit(k)).alias("_fc_fold"), F.col(label).cast("double").alias("_fc_y"),
                     *[F.col(c).cast("string").alias(f"_fc_{i}") for i, c in enumerate(cols)])
    sums = ["n_all", "s_all", *[f"{x}{f}" for f in range(k) for x in ("n", "s")]]
    schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("key", T.StringType()),
                           *[T.StructField(x, T.LongType() if x[0] == "n" else T.DoubleType()) for x in sums]])
    names, most, slots = list(cols), COUNTED_CELLS, k + 1

    def cells(batch) -> pa.Table:
        folds = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        y = batch.column(1)
        has = y.is_valid().to_numpy(zero_copy_only=False)
        y = y.fill_null(0.0).to_numpy(zero_copy_only=False)
        out = []
        for name, column in zip(names, batch.columns[2:], strict=True):
            coded = column.cast(pa.string()).dictionary_encode(null_encoding="encode")
            size = len(coded.dictionary)
            cell = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * slots + folds
            n, m, s = (np.bincount(cell, w, size * slots).reshape(size, slots) for w in (None, has, y))
            count = lambda x: pa.array(x.astype(np.int64))
            total = lambda x, of: pa.array(x, mask=of == 0)
            folded = [a for f in range(k) for a in (count(n[:, f]), total(s[:, f], m[:, f]))]
            out.append(pa.Table.from_arrays([pa.array([name] * size, pa.string()), coded.dictionary, count(n.sum(axis=1)),
                                             total(s.sum(axis=1), m.sum(axis=1)), *folded], names=schema.names))
        return pa.concat_tables(out)

    def added(tables) -> pa.Table:
        out = pa.concat_tables(tables).group_by(["feature", "key"]).aggregate([(x, "sum") for x in sums])
        return out.rename_columns([x.removesuffix("_sum") for x in out.column_names]).select(schema.names)

    def counted(batches):
        held, size, least = [], 0, 0
        for batch in batches:
            held.append(cells(batch))
            size += held[-1].num_rows
            if size > most + least:
                held = [added(held)]
                size = least = held[0].num_rows
                if least > most // 2:                # keys that seldom repeat: Spark's own grouping adds them up
                    yield from held[0].to_batches(max_chunksize=10_000)
                    held, size, least = [], 0, 0
        if held:
            yield from added(held).to_batches(max_chunksize=10_000)

    return rows.mapInArrow(counted, schema)


def fit_fold_target_encoder(df: DataFrame, cols, label: str, fold_col: str, k: int,
                            smoothing: float = 20.0, min_samples_leaf: float = 20.0) -> DataFrame:
    """D7 for cross-fitting: the encoder of every fold model in ONE pass.

    Model f is fitted on rows with fold != f, so its statistics are the totals minus fold f's
    share: n = N - n_f, s = S - s_f, prior_f = (S_all - s_all_f) / (N_all - n_all_f). One group-by with k
    conditional counts and sums gives them all. Emits (fold, feature, key, n, enc, prior) for every key seen
    in training, including keys absent from fold f's training rows (n = 0 -> prior)."""
    y = F.col(label).cast("double")
    if len(cols) > MAX_LOOKUP_JOINS and not df.isStreaming:
        per_key = _fold_counts(df, cols, label, fold_col, k).groupBy("feature", "key").agg(
            *[F.sum(x).alias(x) for x in ("n_all", "s_all", *(f"{x}{f}" for f in range(k) for x in ("n", "s")))])
    else:
        per_key = long_form(df.select(fold_col, label, *cols), cols, keep=[fold_col, label]).groupBy("feature", "key").agg(
            F.count(F.lit(1)).alias("n_all"), F.sum(y).alias("s_all"),
            *[x for f in range(k) for x in (F.count_if(F.col(fold_col) == f).alias(f"n{f}"), F.sum(F.when(F.col(fold_col) == f, y)).alias(f"s{f}"))])
    # one row per fold (k rows); a fold without rows is excluded from nothing
    sums = {r[0]: (r[1], r[2] or 0.0) for r in df.groupBy(fold_col).agg(F.count(F.lit(1)), F.sum(y)).collect()}
    n_rows, n_pos = sum(n for n, _ in sums.values()), sum(p for _, p in sums.values())

    def fit(f: int) -> Column:
        n_f, p_f = sums.get(f, (0, 0.0))
        prior = F.lit((n_pos - p_f) / (n_rows - n_f) if n_rows > n_f else None).cast("double")
        n = F.col("n_all") - F.col(f"n{f}")
        s = F.col("s_all") - F.coalesce(F.col(f"s{f}"), F.lit(0.0))
        return F.struct(F.lit(f).alias("fold"), n.alias("n"), _smooth(n, s, prior, smoothing, min_samples_leaf).alias("enc"), prior.alias("prior"))

    fits = per_key.select("feature", "key", F.explode(F.array(*[fit(f) for f in range(k)])).alias("_f"))
    return cut_lineage(fits.select("_f.fold", "feature", "key", "_f.n", "_f.enc", "_f.prior"))


def apply_fold_encodings(df: DataFrame, fitted: DataFrame, cols, k: int, keep=None) -> tuple[DataFrame, dict]:
    """D7 for a cross-fit: the encodings of all k fold models for every row, looked up once. Returns the rows
    with ``<c>_encs`` (array: fold -> encoding, null for a key that was not fitted) and fold -> prior;
    ``fold_encodings`` picks one fold's.

    Many columns go to long form after the rows were dealt by a number of their own: the keys are exploded, met
    with the map and gathered again inside the partitions that the rows already have, so that the rows are
    shuffled once and never joined back. ``df`` must read the same rows in the same order each time (a
    checkpoint or a file). ``keep``: the other columns to carry (default: all but ``cols``)."""
    priors = {r["fold"]: r["prior"] for r in fitted.groupBy("fold").agg(F.max("prior").alias("prior")).collect()}       # k rows
    by_key = fitted.groupBy("feature", "key").agg(*[F.max(F.when(F.col("fold") == f, F.col("enc"))).alias(f"e{f}") for f in range(k)]) \
        .select("feature", "key", F.array(*[f"e{f}" for f in range(k)]).alias("encs"))
    if len(cols) <= MAX_LOOKUP_JOINS or df.isStreaming:
        return apply_lookup(df, by_key, cols, "encs", None, "_encs"), priors
    look = resolve_lookup(by_key, "encs", max_literals=-1)
    rest = list(keep) if keep is not None else [c for c in df.columns if c not in set(cols)]
    rows = df.withColumn("_fe_row", F.monotonically_increasing_id()).repartition("_fe_row")
    keys = F.posexplode(F.array(*[F.col(c).cast("string") for c in cols])).alias("_fe_at", "_fe_key")
    long = rows.select("_fe_row", F.struct(*rest).alias("_fe_rest"), keys).alias("l")
    place = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    table = look.table.select(F.element_at(place, F.col("feature")).alias("at"), "key", "value").alias("t")
    same = (F.col("l._fe_at") == F.col("t.at")) & F.col("l._fe_key").eqNullSafe(F.col("t.key"))
    met = long.join(F.broadcast(table) if look.small else table, same, "left")
    wide = met.groupBy("_fe_row").agg(F.first("_fe_rest").alias("r"), F.sort_array(F.collect_list(F.struct(
        F.col("_fe_at").alias("at"), F.col("value").alias("v")))).alias("e"))
    return wide.select("r.*", *[F.col("e")[i]["v"].alias(f"{c}_encs") for i, c in enumerate(cols)]), priors


def fold_encodings(df: DataFrame, cols, fold: int, priors: dict, suffix: str = "_te") -> DataFrame:
    """One fold's encodings of ``apply_fold_encodings`` as columns ``<c><suffix>``."""
    prior = F.lit(priors.get(fold)).cast("double")
    return df.withColumns({c + suffix: F.coalesce(F.get(F.col(f"{c}_encs"), F.lit(fold)), prior) for c in cols})


def resolve_target_encoding(fitted: DataFrame, fold: int | None = None, **bounds) -> Lookup:
    """The lookup of one fit (or one fold's), with its prior."""
    table = fitted if fold is None else fitted.filter(F.col("fold") == fold)
    return resolve_lookup(table, "enc", prior="prior", **bounds)


def apply_target_encoding(df: DataFrame, fitted: DataFrame | Lookup, cols, fold: int | None = None,
                          suffix: str = "_te", keep=None, **bounds) -> DataFrame:
    """D7 apply (wide): each column gets its encoding; unseen key -> prior of that fit. Resolve the
    lookup once (resolve_target_encoding) when several frames get the same fit."""
    look = fitted if isinstance(fitted, Lookup) else resolve_target_encoding(fitted, fold, **bounds)
    return apply_lookup(df, look, cols, "enc", look.prior, suffix, keep=keep)


def oof_target_encoding(df: DataFrame, fitted_folds: DataFrame, id_col: str, fold_col: str, cols) -> DataFrame:
    """Long form (id, fold, feature, key, enc): every training row encoded by the model of its own
    fold, i.e. with statistics that exclude its fold (what the validation rows see)."""
    rows = long_form(df.select(id_col, fold_col, *cols), cols, keep=[id_col, fold_col]).alias("r")
    m = fitted_folds.select("fold", "feature", "key", "enc").alias("m")
    same = ((F.col(f"r.{fold_col}") == F.col("m.fold")) & (F.col("r.feature") == F.col("m.feature"))
            & F.col("r.key").eqNullSafe(F.col("m.key")))
    return rows.join(m, same, "left").select(f"r.{id_col}", f"r.{fold_col}", "r.feature", "r.key", "m.enc")


def hashed_normal(id_col: str, salt: str) -> Column:
    """A standard normal number from md5(id|salt) (Box-Muller): the same for a row in every run. Rows
    without an id share the number of the empty id."""
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"|{salt}")))
    part = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("double") / float(1 << 48)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - part(1))) * F.cos(F.lit(2 * math.pi) * part(13))


def add_noise(df: DataFrame, cols, sigma: float, id_col: str = "id", seed: int = 42,
              only_when: Column | None = None) -> DataFrame:
    """Gaussian noise on encoded columns (training rows only when ``only_when`` is given), drawn
    from the row's id, so that it does not depend on partitions or reruns."""
    out = {}
    for c in cols:
        noisy = F.col(c) + F.lit(float(sigma)) * hashed_normal(id_col, f"{seed}|{c}")
        out[c] = F.when(only_when, noisy).otherwise(F.col(c)) if only_when is not None else noisy
    return df.withColumns(out)


# ---------------------------------------------------------------- D9 ordered target encoding
def _ordered_rows(df: DataFrame, cols, label: str, id_col: str, a: float, seed: int, row_col: str | None) -> DataFrame:
    """(keep..., feature, key, enc). Rows come in the order of the shuffled id, then the id, then
    ``row_col`` where given, so that repeated and null ids are rows of their own."""
    from churnforge.operators.folds import shuffle_key
    prior = F.lit(df.select(F.avg(F.col(label).cast("double"))).first()[0]).cast("double")
    keep = [id_col, *([row_col] if row_col else [])]
    rows = long_form(df.select(*keep, label, *cols).withColumn("_perm", F.coalesce(shuffle_key(id_col, seed), F.lit(""))), cols,
                     keep=[*keep, label, "_perm"]).withColumn("_y", F.col(label).cast("double")) \
        .withColumn("_one", F.lit(1).cast("long"))
    run = prefix_sums(rows, ["_perm", *keep], ["_y", "_one"], ["feature", "key"])
    enc = (F.col("_y_before") + F.lit(float(a)) * prior) / (F.col("_one_before") + F.lit(float(a)))
    return run.select(*keep, "feature", "key", enc.alias("enc"))


def ordered_target_encoding(df: DataFrame, cols, label: str, id_col: str, a: float = 1.0, seed: int = 42,
                            suffix: str = "_cbe") -> DataFrame:
    """Each row sees only the rows before it (in a fixed shuffled order) with its key:
    (s_before + a * prior) / (n_before + a). Skew-safe: the running sums are two-phase, so a key
    holding a third of the rows is spread over many tasks."""
    return _ordered_rows(df, cols, label, id_col, a, seed, None)


def fit_ordered_encoder(df: DataFrame, cols, label: str, a: float = 1.0) -> DataFrame:
    """D9 fit for rows outside the training set: (feature, key, enc, prior) from all training rows,
    (s + a * prior) / (n + a); an unseen key gets the prior."""
    prior = F.lit(df.select(F.avg(F.col(label).cast("double"))).first()[0]).cast("double")
    stats = long_form(df.select(*cols, label), cols, keep=[label]).groupBy("feature", "key").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("s"))
    enc = (F.col("s") + F.lit(float(a)) * prior) / (F.col("n") + F.lit(float(a)))
    return stats.select("feature", "key", enc.alias("enc"), prior.alias("prior"))


def ordered_encoding_wide(df: DataFrame, cols, label: str, id_col: str, a: float = 1.0, seed: int = 42,
                          suffix: str = "_cbe") -> DataFrame:
    """D9 on training rows as columns ``<c><suffix>``. Every row of ``df`` comes out once: rows are told
    apart by a number of their own (held still by a checkpoint), whatever ids they lack or repeat."""
    rows = cut_lineage(df.withColumn("_cbe_row", F.monotonically_increasing_id()))
    long = _ordered_rows(rows, cols, label, id_col, a, seed, "_cbe_row")
    wide = long.groupBy("_cbe_row").agg(*[F.max(F.when(F.col("feature") == c, F.col("enc"))).alias(c + suffix) for c in cols])
    return rows.join(wide, "_cbe_row").drop("_cbe_row")


# ---------------------------------------------------------------- D10 count, D11 group mean, D13 weights
def fit_count_encoder(df: DataFrame, cols) -> DataFrame:
    """(feature, key, n) frequency table; nulls are not counted (a null gets 0 when applied)."""
    return long_form(df.select(*cols), cols).filter(F.col("key").isNotNull()).groupBy("feature", "key").agg(F.count(F.lit(1)).alias("n"))


def apply_count_encoding(df: DataFrame, fitted: DataFrame, cols, suffix: str = "_freq") -> DataFrame:
    return apply_lookup(df, fitted, cols, "n", 0, suffix)


def fit_group_mean(ref: DataFrame, key: Column | str, value: str) -> DataFrame:
    """D11 fit on another (reference) table: (key, mean)."""
    k = F.col(key) if isinstance(key, str) else key
    return ref.groupBy(k.alias("key")).agg(F.avg(F.col(value).cast("double")).alias("mean"))


def apply_group_mean(df: DataFrame, fitted: DataFrame, key: Column | str, out: str, default: float = 0.0) -> DataFrame:
    """D11 apply: unseen key -> default (0)."""
    k = F.col(key) if isinstance(key, str) else key
    table = broadcast_if_small(fitted.select(F.col("key").alias("_gm_fit"), F.col("mean").alias("_gm_mean")))
    joined = df.withColumn("_gm_key", k).join(table, F.col("_gm_key").eqNullSafe(F.col("_gm_fit")), "left")
    return joined.withColumn(out, F.coalesce(F.col("_gm_mean"), F.lit(float(default)))).drop("_gm_key", "_gm_fit", "_gm_mean")


def group_modes(df: DataFrame, group: str, cols, suffix: str = "_mode") -> DataFrame:
    """(group, <c>_mode...): the most frequent value of each column per group, the smallest on a tie,
    nulls ignored. Counts per (group, column, value) are combined map-side; no group's values are
    gathered. A group without any value has no row."""
    counts = long_form(df, cols, keep=[group]).filter(F.col("key").isNotNull()).groupBy(group, "feature", "key") \
        .agg((-F.count(F.lit(1))).alias("n"))
    best = counts.groupBy(group, "feature").agg(F.min(F.struct("n", "key"))["key"].alias("key"))
    return best.groupBy(group).agg(*[F.max(F.when(F.col("feature") == c, F.col("key"))).alias(c + suffix) for c in cols])


def class_weight(df: DataFrame, label: str, out: str = "weight", weight_col: str | None = None) -> DataFrame:
    """Positives weighted by negatives / positives (scale_pos_weight), negatives by 1; with
    ``weight_col``, counts are sums of these weights, and a row's own weight is multiplied in. A table of
    one class only weighs every row alike."""
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    ratio = df.select(F.try_divide(F.sum(w * (1 - F.col(label))), F.sum(w * F.col(label)))).first()[0] or 1.0
    return df.withColumn(out, w * F.when(F.col(label) == 1, F.lit(float(ratio))).otherwise(F.lit(1.0)))


# ---------------------------------------------------------------- L4 / P4 nulls kept: medians and indicators
IS_NULL = "_is_null"


def fit_median_imputer(df: DataFrame, cols, fold_col: str | None = None, k: int = 0) -> DataFrame:
    """(fold, feature, median, n, n_null): exact medians of the numbers that are there, for every fold model
    at once. Model f is fitted on rows with fold != f, so its counts of a value are the totals minus fold f's.
    Values are counted once per (feature, value, fold), and only these counts are set against each other;
    without ``fold_col`` there is one fit, with fold null. A column without any number has a null median."""
    fold = F.col(fold_col).cast("int") if fold_col else F.lit(None).cast("int")
    long = df.select(fold.alias("fold"), F.explode(F.array(*[F.struct(
        F.lit(c).alias("feature"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("x")) for c in cols])).alias("_kv")) \
        .select("fold", "_kv.feature", "_kv.x")
    counts = long.groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"), *[
        F.count_if(F.col("fold") == f).alias(f"n{f}") for f in range(k if fold_col else 0)])
    if fold_col:
        fits = F.array(*[F.struct(F.lit(f).alias("fold"), (F.col("n") - F.col(f"n{f}")).alias("c")) for f in range(k)])
    else:
        fits = F.array(F.struct(F.lit(None).cast("int").alias("fold"), F.col("n").alias("c")))
    rest = cut_lineage(counts.select("feature", "x", F.explode(fits).alias("_f")).select("feature", "x", "_f.fold", "_f.c").filter("c > 0"))
    mid = exact_quantiles(rest, "x", [0.5], ["fold", "feature"], counts="c").select("fold", "feature", F.col("q").alias("median")).alias("m")
    sums = rest.groupBy("fold", "feature").agg(F.sum("c").alias("n"), F.coalesce(F.sum(F.when(F.col("x").isNull(), F.col("c"))), F.lit(0))
                                               .alias("n_null")).alias("s")
    same = F.col("s.fold").eqNullSafe(F.col("m.fold")) & (F.col("s.feature") == F.col("m.feature"))
    return cut_lineage(sums.join(mid, same, "left").select("s.fold", "s.feature", "median", "n", "n_null"))


def median_table(fitted: DataFrame) -> dict:
    """fold -> {column: median} of a fitted imputer: folds x columns numbers."""
    out: dict = {}
    for r in fitted.select("fold", "feature", "median").collect():
        out.setdefault(r["fold"], {})[r["feature"]] = r["median"]
    return out


def impute_by(df: DataFrame, medians: dict, cols) -> DataFrame:
    """Each column with its median in place of null and NaN (0 where there was no number to fit on), and
    ``<c>_is_null``, 1.0 where it had none."""
    out = {}
    for c in cols:
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        out[c + IS_NULL] = x.isNull().cast("double")
        out[c] = F.coalesce(x, F.lit(float(medians.get(c) or 0.0)))
    return df.withColumns(out)


def apply_median_imputer(df: DataFrame, fitted: DataFrame, cols, fold: int | None = None) -> DataFrame:
    return impute_by(df, median_table(fitted).get(fold, {}), cols)
