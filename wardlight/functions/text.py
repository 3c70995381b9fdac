"""Tokens, id lists and backend messages as native columns, with plain counterparts for the planner."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words by which a backend says that a request was too large.
LIMIT_WORDS = r"(too many|limit|quota|max results|max rows|allowed size)"
#: What stands between ids in one text.
_SEPARATORS = r"[\s,;]+"
_OR = r"\s+OR\s+"


def token_code(token: Column) -> Column:
    """What follows the first colon; NULL without one, or with nothing after it."""
    return F.nullif(F.regexp_extract(token, ":(.+)", 1), F.lit(""))


def token_kind(token: Column) -> Column:
    return F.substring(token, 1, 2)


def has_digit(token: Column) -> Column:
    return token.rlike(r"\d")


def id_list(ids: Column) -> Column:
    """Array of the ids that a string lists with OR, blanks, commas or semicolons."""
    return F.filter(F.split(F.regexp_replace(ids, _OR, " "), _SEPARATORS), lambda x: x != "")


def is_id_list(ids: Column) -> Column:
    return F.coalesce(ids.rlike(r"[\s,;]"), F.lit(False))


def is_limit_message(message: Column, pattern: str = LIMIT_WORDS) -> Column:
    return F.coalesce(F.lower(message).rlike(pattern), F.lit(False))


def limit_message(message: object, pattern: str = LIMIT_WORDS) -> bool:
    """The same for a message, or list of messages, in Python."""
    if message is None:
        return False
    parts = message if isinstance(message, (list, tuple)) else [message]
    return re.search(pattern, " ".join(str(p) for p in parts).lower()) is not None


def split_ids(ids: object) -> list[str]:
    """Ids of a value or list; every element is split, empty ones are dropped."""
    if ids is None:
        return []
    parts = ids if isinstance(ids, (list, tuple)) else [ids]
    return [x for p in parts if p is not None for x in re.split(_SEPARATORS, re.sub(_OR, " ", str(p))) if x]


def looks_like_id_list(ids: object) -> bool:
    if isinstance(ids, (list, tuple)):
        return len(ids) > 1
    return ids is not None and re.search(r"[\s,;]", str(ids)) is not None
