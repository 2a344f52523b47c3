"""Training-data operators over documents, pages, conversations and embeddings.

Nothing outside this folder imports it, apart from the guarded registration in ``__spark_entry__.py``.
"""
