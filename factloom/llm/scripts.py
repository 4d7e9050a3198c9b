"""Scripts of code points, and the dominant script of a text."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

# First and last code point of the main ranges of each script.
RANGES = (
    ("Latin", 0x0041, 0x024F),
    ("Latin", 0x1E00, 0x1EFF),
    ("Greek", 0x0370, 0x03FF),
    ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x0400, 0x052F),
    ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x077F),
    ("Arabic", 0xFB50, 0xFEFC),
    ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF),
    ("Tamil", 0x0B80, 0x0BFF),
    ("Thai", 0x0E00, 0x0E7F),
    ("Georgian", 0x10A0, 0x10FF),
    ("Hangul", 0x1100, 0x11FF),
    ("Hangul", 0xAC00, 0xD7AF),
    ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x9FFF),
    ("Han", 0xF900, 0xFAFF),
    ("Han", 0x20000, 0x3FFFF),
)
NAMES = ("none", "other", *dict.fromkeys(name for name, _, _ in RANGES))
TOP = 0x3FFFF  # greater code points count as this one, which is no letter


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the script of a letter or mark as a place in NAMES, and whether it is a letter."""
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(TOP + 1)])
    script = np.where((kinds == "L") | (kinds == "M"), 1, 0).astype(np.uint8)
    for name, first, last in RANGES:
        part = script[first : last + 1]
        part[part > 0] = NAMES.index(name)
    return script, kinds == "L"


def code_points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), TOP)


def dominant(text: str) -> str:
    """Script of most letters and marks; 'none' without any."""
    if text.isascii():
        return "Latin" if any(map(str.isalpha, text)) else "none"
    counts = np.bincount(tables()[0][code_points(text)], minlength=len(NAMES))[1:]
    return NAMES[int(counts.argmax()) + 1] if counts.any() else "none"
