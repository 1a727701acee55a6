"""Readers and writers: station lines, stop-level actuals, Parquet checkpoints,
and the derived views over the driver's test tables."""
