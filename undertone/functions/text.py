"""Text folding inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Lower-case characters whose compatibility decomposition is one base character plus marks."""
    src, dst = [], []
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        ch = chr(code)
        parts = unicodedata.normalize("NFKD", ch)
        base = [c for c in parts if not unicodedata.combining(c)]
        if ch == ch.lower() and len(base) == 1 and base[0] != ch:
            src.append(ch)
            dst.append(base[0])
    return "".join(src), "".join(dst)


def fold(col: Column) -> Column:
    """Lower case without accents: precomposed letters become their base, combining marks go."""
    src, dst = _accents()
    return F.translate(F.regexp_replace(F.lower(col), r"\p{M}+", ""), src, dst)


def squeeze(col: Column) -> Column:
    """Folded text with every run of other characters than letters and digits as one space."""
    return F.trim(F.regexp_replace(fold(col), r"[^\p{L}\p{N}]+", " "))
