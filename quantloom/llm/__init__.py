"""Training-data operators: filters, near-duplicate removal, mixing and tokenisation.

Nothing outside this subpackage imports it. ``queries.py`` registers one thin
query per operator; ``__spark_entry__.py`` adds them when the subpackage exists.
"""
