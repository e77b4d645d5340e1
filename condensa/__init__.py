"""condensa: ranking, de-duplication and budgeted compression of record collections on Spark."""
