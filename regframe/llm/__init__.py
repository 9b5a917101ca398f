"""Training-data operators: ten operators over documents, pages, conversations.

Nothing else in the library imports this subpackage.
"""
