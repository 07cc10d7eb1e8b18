"""All queries of this subpackage."""

from quillsift.llm import manifest_queries, native_queries, phrase_queries, text_queries, token_queries  # noqa: F401  (they register)
from quillsift.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
