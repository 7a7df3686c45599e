"""Training-data operators: each module is one operator; queries.py binds them to the driver's tables.

Nothing outside this folder imports it, so it can be removed without touching the rest.
"""
