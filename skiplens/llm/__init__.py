"""Training-data operators (language id, dedup, classifiers, tokenising, mixing).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries only when it can be imported.
"""
