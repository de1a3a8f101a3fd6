"""A PySpark engine for question-decomposition programs."""
