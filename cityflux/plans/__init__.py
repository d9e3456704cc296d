"""Shared plan shapes: shared-folder tables, size-checked broadcasts, ordered series, exact ranks."""
