"""Scalar functions: columns where Spark has the parts, vectorised Python where it has not."""
