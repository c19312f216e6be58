"""Operators of a training-data pipeline over a table of documents.

Every operator takes ``docs`` with at least ``doc_id`` and ``text``; other columns
pass through or are ignored, whatever their names. A null text is an empty text
unless an operator says otherwise.
"""
