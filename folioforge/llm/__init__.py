"""Training-data operators: ten corpus-scale jobs and their registered queries.

Nothing else in the library imports this subpackage; it may be deleted whole.
"""
