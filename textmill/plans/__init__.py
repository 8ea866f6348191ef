"""Registered queries: textmill.plans.queries and textmill.plans.more."""
