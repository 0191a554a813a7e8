"""Training-data operators: deduplication, filters, decontamination, mixing and token output.

Nothing else in the library imports this subpackage.
"""
