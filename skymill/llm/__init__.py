"""Training-data operators over document, page and conversation tables.

Every operator takes and returns DataFrames. ``queries`` registers one query per operator; nothing else in the
library imports this subpackage.
"""
