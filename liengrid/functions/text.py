"""Title case, account numbers and header names."""

from __future__ import annotations

import re
from collections.abc import Iterable

from liengrid.functions.nulls import if_else

# A word starts after whitespace or after a mark that is not part of a word; \x27 is
# the apostrophe.
_WORD_START_AFTER_MARK = r"(?<=[^\p{IsAlphabetic}\p{N}\s_\x27’.:])(?=[\p{IsAlphabetic}\p{N}])"
_SEAM = r"'\u0001 '"


def title_case(text: str) -> str:
    """Capitals at word starts, also after a hyphen or slash ("Paid-In-Full").

    initcap starts words at spaces only, so a seam is put before the other word
    starts and taken out again.
    """
    return f"replace(initcap(regexp_replace({text}, r'{_WORD_START_AFTER_MARK}', {_SEAM})), {_SEAM}, '')"


def has_letter(text: str) -> str:
    """Contains a letter of any script; null on null."""
    return rf"({text} rlike r'\p{{IsAlphabetic}}')"


def _without_padding(part: str) -> str:
    return if_else(has_letter(part), part, f"substring({part}, 2)")


def account_block(account: str) -> str:
    """block = first five characters, less the leading one unless a letter occurs."""
    return _without_padding(f"substring({account}, 1, 5)")


def account_lot(account: str) -> str:
    """lot = from the sixth character on, less the leading one unless a letter occurs."""
    return _without_padding(f"substring({account}, 6)")


def snake_names(headers: Iterable[str]) -> list[str]:
    """Header names as unique snake_case identifiers."""
    seen: dict[str, int] = {}
    names = []
    for header in headers:
        name = header.replace("'", "").replace('"', "").replace("%", "_percent_").replace("#", "_number_")
        name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
        name = re.sub(r"([A-Z]+)([A-Z][a-z])", r"\1_\2", name)
        name = re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_").lower() or "x"
        if name[0].isdigit():
            name = "x" + name
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return names
