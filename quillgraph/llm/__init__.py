"""Operations of a training-data pipeline over tables of documents.

Nothing outside this package imports it.  Every operator takes a DataFrame with
``doc_id`` and ``text`` (other columns may come along) and states in its
docstring what nulls, empty texts, ties and repeated rows give.
"""
