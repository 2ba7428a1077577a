"""Training-data pipeline operators (token counts, language id, dedup, PII, ...).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it can be imported.
"""
