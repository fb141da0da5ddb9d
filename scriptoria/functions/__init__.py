"""Scalar functions and rule tables, as SQL text that Spark and the test oracle both read."""
