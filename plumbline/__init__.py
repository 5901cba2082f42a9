"""plumbline: conformance and regression analytics on Spark DataFrames."""
