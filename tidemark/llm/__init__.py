"""Training-data operators: scoring, cleaning, tokenising, packing, archiving and similarity search over text tables.

Nothing else in the package imports this one.
"""
