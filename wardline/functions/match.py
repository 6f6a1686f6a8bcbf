"""The rule language on single values, for the stateful operator.

Equal to the column builders of ``net`` and ``text`` (tests hold them against each other), and both address versions.
"""

from __future__ import annotations

from functools import lru_cache

from wardline.functions.net import Net, address, items, net


@lru_cache(maxsize=65536)
def _nets(csv: str) -> tuple[tuple[bool, Net | None], ...]:
    return tuple((neg, net(text)) for neg, text in items(csv))


@lru_cache(maxsize=65536)
def _address(ip: str):
    return address(ip)


def address_in_list(ip: str, csv: str) -> bool:
    a, passed = _address(ip), False
    if a is None:
        return False
    for neg, n in _nets(csv):
        if n is None:
            return False
        if n.has(a):
            return not neg
        passed = passed or neg
    return passed


def value_in_list(term: str, csv: str) -> bool:
    found = items(csv)
    return next((not neg for neg, v in found if v == term), any(neg for neg, _ in found))


def text_matches(term: str, rule: str) -> bool:
    if "," in rule:
        return value_in_list(term, rule)
    neg = rule.startswith("!")
    return ((rule[1:] if neg else rule).strip().lower() == term.strip().lower()) != neg


@lru_cache(maxsize=4096)
def reference(text: str) -> int | None:
    """The stage that `:N` names, or None."""
    if ":" not in text:
        return None
    body = text.strip(":")
    return int(body) if body.lstrip("-").isdigit() and body.isascii() else None
