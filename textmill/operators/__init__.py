"""Relational operators: search, paging, budgets, reports, logs, jobs, layout."""
