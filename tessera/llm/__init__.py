"""Training-data operators: mixing, filtering, de-duplication, sharding and token output.

Nothing outside this package imports it; every operator takes and returns DataFrames.
"""
