"""Text predicates of the rule language as column builders, with twins for single values in ``match``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.functions.net import items


def value_in_list(term: Column, csv: str) -> Column:
    """A rule's list over a column: the first item equal to the term decides; else it passes if an item is negated."""
    out, rest = None, any(neg for neg, _ in items(csv))
    for neg, text in items(csv):
        out = F.when(term == text, F.lit(not neg)) if out is None else out.when(term == text, F.lit(not neg))
    return F.lit(rest) if out is None else out.otherwise(F.lit(rest))


def text_matches(term: Column, rule: str) -> Column:
    """With a comma a list (case counts); without, equality after trimming in any case, negated by a leading `!`."""
    if "," in rule:
        return value_in_list(term, rule)
    neg = rule.startswith("!")
    same = F.lower(F.trim(term)) == (rule[1:] if neg else rule).strip().lower()
    return ~same if neg else same


def csv_array(csv: Column) -> Column:
    return F.filter(F.split(F.translate(csv, ",", " "), r"\s+"), lambda x: x != "")


def in_csv(csv: Column, term: Column | str) -> Column:
    return F.array_contains(csv_array(csv), term)


def contains_ci(text: Column, part: Column) -> Column:
    return F.contains(F.upper(text), F.upper(part))


def drop_first_char(text: Column) -> Column:
    return F.trim(F.substring(text, 2, 1 << 30))


def epoch_seconds(stamp: Column) -> Column:
    """Epoch seconds of an ISO 8601 text with zone; NULL where it can't be read."""
    return F.unix_timestamp(F.try_to_timestamp(stamp))


def in_time_of_day(ts: Column, start: str, end: str) -> Column:
    """Is the time between two HH:mm marks?  The end minute counts whole; a start after the end wraps midnight."""
    hm = F.date_format(ts, "HH:mm")
    return hm.between(start, end) if start <= end else (hm >= start) | (hm <= end)
