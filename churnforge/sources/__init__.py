from churnforge.sources.tables import (  # noqa: F401
    PREDICTION_SCHEMA, read_table, read_csv_typed, read_predictions, existing_sources,
    union_sources, require_sources, write_table, write_predictions, append_run_metrics,
    save_fitted, load_fitted, save_model, load_model, positive_probability,
)
