"""The first topic and group that Kafka requests name, by field programs for each API and version, run on batches of messages."""

from __future__ import annotations

import uuid

import pandas as pd

#: The version from which requests of an API are flexible: strings and arrays have their length as a variable integer, one above the real one, and the head
#: ends with tagged fields.
FLEXIBLE = {0: 9, 1: 12, 2: 6, 3: 9, 8: 8, 9: 6, 10: 3, 11: 6, 12: 4, 13: 4, 14: 4, 15: 5, 16: 3, 18: 3, 19: 5, 20: 4, 21: 2, 22: 2, 23: 4, 24: 3, 25: 3, 26: 3, 28: 3, 37: 2, 42: 2, 45: 0, 46: 0, 61: 0}
#: For each API, from a version on, the fields of the body as far as the first topic and group: a number is that many bytes to step over, ``s`` a string, ``g``
#: the string that is a group, ``[`` the length of an array, whose first element follows if there is one, ``t`` a topic's name and ``u`` its id.
PROGRAMS: dict[int, dict[int, str]] = {
    0: {0: "2 4 [ t", 3: "s 2 4 [ t", 13: "s 2 4 [ u"},
    1: {0: "4 4 4 [ t", 3: "4 4 4 4 [ t", 4: "4 4 4 4 1 [ t", 7: "4 4 4 4 1 4 4 [ t", 13: "4 4 4 4 1 4 4 [ u", 15: "4 4 4 1 4 4 [ u"},
    2: {0: "4 [ t", 2: "4 1 [ t"},
    3: {0: "[ t", 10: "[ u t"},
    8: {0: "g [ t", 1: "g 4 s [ t", 2: "g 4 s 8 [ t", 5: "g 4 s [ t", 7: "g 4 s s [ t", 10: "g 4 s s [ u"},
    9: {0: "g [ t", 8: "[ g [ t", 9: "[ g s 4 [ t", 10: "[ g s 4 [ u"},
    10: {0: "g", 1: "g", 4: "1 [ g"},
    11: {0: "g"},
    12: {0: "g"},
    13: {0: "g"},
    14: {0: "g"},
    15: {0: "[ g"},
    19: {0: "[ t"},
    20: {0: "[ t", 6: "[ t u"},
    21: {0: "[ t"},
    23: {0: "[ t", 3: "4 [ t"},
    24: {0: "s 8 2 [ t", 4: "[ s 8 2 1 [ t"},
    25: {0: "s 8 2 g"},
    28: {0: "s g 8 2 [ t", 3: "s g 8 2 4 s s [ t"},
    37: {0: "[ t"},
    42: {0: "[ g"},
    45: {0: "4 [ t", 1: "4 1 [ t"},
    46: {0: "4 [ t"},
    47: {0: "g [ t"},
    61: {0: "[ t"},
}


class Cut(ValueError):
    """The bytes end before the field does."""


def uvarint(b: bytes, at: int) -> tuple[int, int]:
    """A number of seven bits a byte, the lowest first, and where it ends."""
    value = shift = 0
    while at < len(b) and shift < 70:
        value |= (b[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if b[at - 1] < 128:
            return value, at
    raise Cut


def length(b: bytes, at: int, compact: bool, width: int) -> tuple[int, int]:
    """Length of a string (2 bytes) or array (4 bytes), below 0 for null, and where it ends."""
    if compact:
        n, at = uvarint(b, at)
        return n - 1, at
    if at + width > len(b):
        raise Cut
    return int.from_bytes(b[at : at + width], "big", signed=True), at + width


def text(b: bytes, at: int, compact: bool) -> tuple[str | None, int]:
    n, at = length(b, at, compact, 2)
    if n < 0:
        return None, at
    if at + n > len(b):
        raise Cut
    return b[at : at + n].decode("utf-8", "replace"), at + n


def tags(b: bytes, at: int) -> int:
    """Where tagged fields end."""
    many, at = uvarint(b, at)
    for _ in range(many):
        _, at = uvarint(b, at)
        n, at = uvarint(b, at)
        at += n
        if at > len(b):
            raise Cut
    return at


def named(b: bytes | None) -> tuple[str | None, str | None, str | None]:
    """(topic, its id, group) that a request names first; None for what it does not name or the bytes do not reach."""
    found: dict[str, str | None] = {"t": None, "u": None, "g": None}
    if b is None or len(b) < 14:
        return None, None, None
    api, version = int.from_bytes(b[4:6], "big"), int.from_bytes(b[6:8], "big")
    steps = PROGRAMS.get(api, {})
    program = next((steps[v] for v in sorted(steps, reverse=True) if v <= version), "")
    compact = version >= FLEXIBLE.get(api, 1 << 15)
    try:
        # The client's id is no compact string even in flexible heads.
        _, at = text(b, 12, False)
        at = tags(b, at) if compact else at
        for step in program.split():
            if step == "[":
                n, at = length(b, at, compact, 4)
                if n <= 0:
                    break
            elif step == "u":
                if at + 16 > len(b):
                    raise Cut
                found["u"] = str(uuid.UUID(bytes=b[at : at + 16])) if any(b[at : at + 16]) else None
                at += 16
            elif step in "stg":
                value, at = text(b, at, compact)
                found[step] = value
            else:
                at += int(step)
    except Cut:
        pass
    if api == 10 and found["g"] is not None and version >= 1:
        # A coordinator is looked for by the key of a group (0) or of a transaction (1).
        kind = b[at : at + 1] if version < 4 else b[_first_body(b, compact) : _first_body(b, compact) + 1]
        found["g"] = found["g"] if kind == b"\0" else None
    return found["t"], found["u"], found["g"]


def _first_body(b: bytes, compact: bool) -> int:
    at = text(b, 12, False)[1]
    return tags(b, at) if compact else at


NAMED = "topic string, topic_id string, group_id string"


def names(messages: pd.Series) -> pd.DataFrame:
    """``named`` of a batch of messages."""
    return pd.DataFrame([named(m) for m in messages], columns=["topic", "topic_id", "group_id"], dtype=object)
