"""Python-flavoured regular expressions for the JVM matcher.

The rule patterns are defined for Unicode text with Python's reading of ``\\s \\w \\d \\b`` and
``.``; Java reads those classes as ASCII and lets more characters end a line. ``compile_pattern``
writes the wanted classes out, so that an ``rlike`` gives the same answer.
"""

from __future__ import annotations

# --- fixed values: character classes ----------------------------------------------------------

# The 29 characters Python treats as white space.
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same as class members. Single Latin-1 characters become one table lookup in the JVM matcher, and the
# rest sits behind one range test, so that a letter is rejected in two steps.
_WIDE_SPACE = r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
_SPACE_BUT_BLANK = r"\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0" + _WIDE_SPACE
SPACE = r"\n\x20" + _SPACE_BUT_BLANK
SPACE_IN_LINE = r"\x20" + _SPACE_BUT_BLANK
OTHER_SPACE_IN_LINE = _SPACE_BUT_BLANK
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"

# --- end of fixed values ----------------------------------------------------------------------

_BOUNDARY = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
_CLASSES = {"s": SPACE, "w": WORD, "d": DIGIT}


def compile_pattern(pattern: str, multiline: bool = False) -> str:
    """Java pattern equal to a Python one, for use in ``rlike`` and the ``regexp_*`` functions."""
    flags = "d"
    if pattern.startswith("(?i)"):
        pattern, flags = pattern[4:], flags + "iu"
    if multiline:
        flags += "m"
    out = [f"(?{flags})"]
    in_class = False
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            nxt = pattern[i + 1]
            if nxt in _CLASSES:
                out.append(_CLASSES[nxt] if in_class else f"[{_CLASSES[nxt]}]")
            elif nxt == "b" and not in_class:
                out.append(_BOUNDARY)
            else:
                out.append(c + nxt)
            i += 2
            continue
        if c == "[" and in_class:
            out.append("\\[")
        else:
            if c == "[":
                in_class = True
            elif c == "]":
                in_class = False
            out.append(c)
        i += 1
    return "".join(out)
