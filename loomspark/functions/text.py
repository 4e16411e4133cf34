"""Unicode-aware text helpers: folding, keyword and author normalisation."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspark.functions.expr import INSTITUTION

# The dash and dot class of the keyword rule.
_DASHES = re.compile(r"[·\-–—]+")
# End of fixed values.
_SPACES, _INSTITUTION = re.compile(r"\s+"), re.compile(INSTITUTION)


def fold_text(text: str) -> str:
    """NFKC, then trimmed of Unicode white space at both ends."""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).strip()


def keyword_text(text: str) -> str:
    """White space runs to one space, trimmed, lower case; then dash and dot runs to one space, trimmed again."""
    return _DASHES.sub(" ", _SPACES.sub(" ", text).strip().lower()).strip()


def author_key(entry: str) -> str:
    """name|institution of 'name(affiliation)'.

    The affiliation is what stands between the first opening bracket and a closing one at the very end; an entry that is
    not of this form is all name. The institution is the shortest stretch up to an institution word, else the first word
    of the affiliation, else ''.
    """
    name, bracket, rest = entry.partition("(")
    rest = rest.rstrip()
    if not bracket or not name or not rest.endswith(")") or "\n" in rest:
        return f"{entry.strip()}|"
    affiliation = rest[:-1]
    found = _INSTITUTION.search(affiliation)
    where = found[1].strip() if found else next(iter(affiliation.split()), "")
    return f"{name.strip()}|{where}"


def _per_value(f, series: pd.Series) -> pd.Series:
    """f over the distinct values of a batch only: labels repeat, normalising each once is enough."""
    codes, values = pd.factorize(series, use_na_sentinel=True)
    mapped = pd.Series([f(v) for v in values], dtype=object)
    return pd.Series([mapped[c] if c >= 0 else None for c in codes], index=series.index, dtype=object)


def folded(column: Column | str) -> Column:
    """NFKC and trimmed of Unicode white space; null stays null, blank becomes ''."""

    def fold(series: pd.Series) -> pd.Series:
        return _per_value(fold_text, series)

    return F.pandas_udf(fold, "string")(F.col(column) if isinstance(column, str) else column)
