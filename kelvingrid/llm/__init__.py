"""Training-data operators: token counts, deduplication, filters, classifiers, sharding and packing.

Nothing else in the package imports this subpackage; its queries are collected in ``queries``.
"""
