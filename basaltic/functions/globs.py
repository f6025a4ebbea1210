"""Globs on file names as regular expressions: * and ? never match a path separator."""

import re


def glob_pattern(glob: str) -> str:
    """Anchored pattern of a glob with * and ?."""
    out = "".join("[^/\\\\]*" if c == "*" else "[^/\\\\]" if c == "?" else re.sub(r"([^A-Za-z0-9_])", r"\\\1", c) for c in glob)
    return f"^{out}\\z"
