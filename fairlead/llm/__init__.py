"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; its queries and their SQL are registered by
``fairlead.llm.queries``.
"""
