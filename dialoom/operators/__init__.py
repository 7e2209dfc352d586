"""Operators on whole tables: filters, positions, selection, pairing, splits and metrics."""
