"""Readers and sinks: delimited and matrix files, gene sets, directory scans, provenance, idempotent writes, audits."""
