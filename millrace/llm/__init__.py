"""Operations of a training-data pipeline: thirteen operators over documents, pages, conversations and embeddings.

Nothing else in the library imports this subpackage.
"""
