"""Rule-source glob patterns -> anchored Java regular expressions.

Pattern language (relative to the source folder, ``/`` separated):
  ``**/``  zero or more whole directories
  ``**``   any text, separators included
  ``*``    any text without ``/`` or ``\\``
  every other character is literal, ``?`` and ``[ ]`` included.
The regex is compiled on the driver once per rule source and evaluated by
Spark (``rlike``) against both the relative and the absolute path.
"""

from __future__ import annotations


def _literal(ch: str) -> str:
    # Java regex: a backslash before a non-alphanumeric ASCII char makes it literal.
    if ch.isascii() and not ch.isalnum():
        return "\\" + ch
    return ch


def glob_to_regex(pattern: str) -> str:
    out: list[str] = []
    i, n = 0, len(pattern)
    while i < n:
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        elif pattern[i] == "*":
            out.append("[^/\\\\]*")
            i += 1
        else:
            out.append(_literal(pattern[i]))
            i += 1
    return "^" + "".join(out) + "$"
