"""Training-data operators: mixing, extraction, decontamination, classification, joins, sharding and token output.

Nothing outside this subpackage imports it.
"""
