"""Typed reads, guarded and idempotent writes, and plans over object inventories."""
