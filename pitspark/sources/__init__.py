"""Readers, conformers, sinks and the analytic views over base tables."""
