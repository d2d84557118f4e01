"""Registered queries over the driver tables."""
from . import q_bins, q_genes, q_peaks, q_reads, q_sites  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
