"""Training-data operators: scans, classifiers, tokenizing, near-duplicate removal.

Nothing outside this folder imports it; ``queries()`` and ``oracle_sql()`` are picked up by the entry module
when the folder is there.
"""
