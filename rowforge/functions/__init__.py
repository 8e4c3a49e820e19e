"""Column expressions shared by the operators."""

from .numbers import float_text, to_number
from .text import as_text, contains_ci, is_blank, pad_absent, strip

__all__ = ["as_text", "contains_ci", "float_text", "is_blank", "pad_absent", "strip", "to_number"]
