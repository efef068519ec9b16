"""Registered queries, their SQL counterparts, and the derived tables both read."""
