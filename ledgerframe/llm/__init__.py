"""Training-data operators (ten components and their registered queries).

Nothing else in the library imports this subpackage; it may import the
library's general helpers.
"""
