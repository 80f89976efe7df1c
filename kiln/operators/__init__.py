"""Distributed operators: statistics, profiling, preparation rules, distributions,
correlations, splits, evaluation, nearest neighbours and model fitting."""
