"""wordloom: a PySpark engine that prepares, mixes and measures text corpora for
language-model training and evaluation. Operators are DataFrame -> DataFrame."""

__version__ = "0.1.0"
