"""Risk analytics on transaction tables and streams, written as Spark DataFrame operators."""
