"""Training-data operators: near-duplicate removal, classifiers, scans, extraction, language models and packing.

Nothing outside this folder imports it. ``queries.QUERIES`` holds the registered queries.
"""
