"""peakgrid: read-enrichment analytics expressed as Spark DataFrame operators."""
