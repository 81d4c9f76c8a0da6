"""The windows and winnowed fingerprints of digests, under the name the training-data problems use."""

from tidemark.functions.windows import GRAM, SIZES, asked, banded, fingerprint, kept, windows

__all__ = ["GRAM", "SIZES", "asked", "banded", "fingerprint", "kept", "windows"]
