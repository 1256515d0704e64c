"""Operators on whole tables: joins, rankings, folds and state."""
