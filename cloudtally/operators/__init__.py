"""Operators: ``DataFrame(s) -> DataFrame`` with explicit parameters and no globals."""
