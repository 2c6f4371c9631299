"""Operators for preparing language-model training data, one module per operator.

Nothing else in the library imports this subpackage.  ``renewal.llm.catalog`` holds the
registered queries (``opN_<name>`` and ``pipeline``) and their SQL twins.
"""
