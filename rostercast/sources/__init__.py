"""Sources and sinks: the order-table bridge to the daily table, CSV/Parquet I/O."""
