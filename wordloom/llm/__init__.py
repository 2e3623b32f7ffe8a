"""Training-data operators: toxicity, decontamination, mixing, URL reputation, repeats,
similarity join, surrogates, nearest neighbours, token rollups and secret scans.

Nothing outside this package imports it; ``__spark_entry__.py`` adds its queries when
it can be imported.
"""
