"""Training-data operators: packing, scans, extraction, encoding, deduplication.

Each module holds one operator with a general interface over a DataFrame of
texts (the id and text columns are parameters); ``queries`` registers one
thin query per operator.  Nothing else in the library imports this package.
"""
