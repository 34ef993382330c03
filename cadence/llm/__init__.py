"""Training-data operators: packing, classifiers, de-duplication, decontamination, search.

Nothing outside this subpackage imports it.
"""
