"""Display labels, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cased letters, including letter-like ones such as the ordinal indicators
_CASED = r"\p{IsLowercase}\p{IsUppercase}\p{IsTitlecase}"
_RUNS = f"[{_CASED}]+|[^{_CASED}]+"
_REST_OF_STRING = 2**31 - 1


def title_label(text: Column) -> Column:
    """Title-case every run of letters, keeping the word ``SRS`` upper-case.

    ``initcap`` is not enough: it starts words at white space only, while here
    any character that is not a letter starts one (``"a-b"`` gives ``"A-B"``).
    """
    runs = F.regexp_extract_all(text, F.lit(_RUNS), F.lit(0))
    titled = F.transform(
        runs,
        lambda run: F.concat(
            F.upper(F.substring(run, 1, 1)),
            F.lower(F.substring(run, 2, _REST_OF_STRING)),
        ),
    )
    return F.regexp_replace(F.array_join(titled, ""), r"(?U)\bSrs\b", "SRS")


def relabel(column: Column, labels: dict[str, str]) -> Column:
    """Replace the listed values, leave all others (and null) as they are."""
    if not labels:
        return column
    branches = None
    for old, new in labels.items():
        condition, value = column == old, F.lit(new)
        branches = F.when(condition, value) if branches is None else branches.when(condition, value)
    return branches.otherwise(column)
