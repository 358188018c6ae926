"""quillspark: full-text concordance analytics as plain Spark DataFrame and SQL work."""

__version__ = "0.1.0"
