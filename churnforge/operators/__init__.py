"""Operators over DataFrames: encoders, folds, metrics, ranking, clustering, models, ensembles."""
