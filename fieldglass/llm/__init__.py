"""Operators that prepare text corpora for language-model training.

Nothing outside this subpackage imports it; ``fieldglass.llm.queries`` lists
its queries.
"""
