"""The predicate language: syntax tree, parser and conjunct classification."""

from .analyze import Analysis, analyze
from .parser import parse
from .tree import PredicateError, to_sql

__all__ = ["Analysis", "PredicateError", "analyze", "parse", "to_sql"]
