"""Training-data operators: ten operators over documents, pages and embeddings.

Each module holds one operator by the method its docstring names;
``queries.py`` registers one query per operator.  Nothing outside this package
imports it.
"""
