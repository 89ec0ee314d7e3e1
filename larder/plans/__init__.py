"""Operator declaration, the named queries and the audited run."""
