"""Registered queries: each operator and job on the given tables, with its SQL counterpart."""
