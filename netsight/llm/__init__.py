"""Operators that prepare web text for language-model training, as Spark jobs."""
