"""Operators on tables: statistics, places, history, folds, priors, rules, scores, selection, models."""
