"""Lead data operators for Spark: tables in, tables out."""
