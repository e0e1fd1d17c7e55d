"""The SQL front end."""

from .sql import SqlPlan, compile_sql, run_sql

__all__ = ["SqlPlan", "compile_sql", "run_sql"]
