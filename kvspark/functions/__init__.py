"""Scalar functions and ranking helpers."""

from .scalars import display, lossy_text, older_than, strict_text, token_hash, zero_padded
from .ranking import numbered

__all__ = ["display", "lossy_text", "numbered", "older_than", "strict_text", "token_hash", "zero_padded"]
