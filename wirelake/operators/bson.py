"""A walk over BSON documents by their length prefixes: top-level elements only, what is nested is stepped over and never read."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd

from ..functions.names import MONGO_CODES, MONGO_COLLECTION_COMMANDS, MONGO_COMMANDS

#: Bytes of element types of one size.
SIZES = {0x01: 8, 0x06: 0, 0x07: 12, 0x08: 1, 0x09: 8, 0x0A: 0, 0x10: 4, 0x11: 8, 0x12: 8, 0x13: 16, 0x7F: 0, 0xFF: 0}
DOUBLE, STRING, DOCUMENT, ARRAY, BINARY, BOOLEAN, REGEX, POINTER, CODE, SYMBOL, SCOPED, INT32, INT64 = 0x01, 0x02, 0x03, 0x04, 0x05, 0x08, 0x0B, 0x0C, 0x0D, 0x0E, 0x0F, 0x10, 0x12


def _prefix(b: bytes, at: int) -> int:
    return int.from_bytes(b[at : at + 4], "little", signed=True) if at + 4 <= len(b) else -1


def _value_end(b: bytes, kind: int, at: int) -> int | None:
    """Where a value ends, None if its length is not there or cannot be."""
    if kind in SIZES:
        return at + SIZES[kind]
    if kind == REGEX:
        middle = b.find(0, at)
        end = b.find(0, middle + 1) if middle >= 0 else -1
        return end + 1 if end >= 0 else None
    n = _prefix(b, at)
    if kind in (STRING, CODE, SYMBOL):
        return at + 4 + n if n >= 1 else None
    if kind == POINTER:
        return at + 16 + n if n >= 1 else None
    if kind == BINARY:
        return at + 5 + n if n >= 0 else None
    if kind in (DOCUMENT, ARRAY, SCOPED):
        return at + n if n >= 5 else None
    return None


def elements(b: bytes, at: int) -> Iterator[tuple[int, str, int, int]]:
    """(type, key, start and end of the value) of the elements of the document at ``at``, as far as bytes go; it ends at a type that does not exist."""
    n = _prefix(b, at)
    if n < 5:
        return
    end, at = min(len(b), at + n), at + 4
    while at < end and b[at]:
        stop = b.find(0, at + 1, end)
        if stop < 0:
            return
        to = _value_end(b, b[at], stop + 1)
        if to is None or to > end:
            return
        yield b[at], b[at + 1 : stop].decode("utf-8", "replace"), stop + 1, to
        at = to


def scalar(b: bytes, kind: int, at: int, end: int) -> str | float | int | None:
    """A string, number or boolean; None for other types."""
    if kind in (STRING, SYMBOL):
        return b[at + 4 : end - 1].decode("utf-8", "replace")
    if kind == DOUBLE:
        return struct.unpack_from("<d", b, at)[0]
    if kind in (INT32, INT64):
        return int.from_bytes(b[at:end], "little", signed=True)
    return bool(b[at]) if kind == BOOLEAN else None


def body_of(message: bytes) -> int | None:
    """Where the body document of an OP_MSG is: the section of kind 0, which sequences of documents (kind 1) may precede."""
    at = 20
    while at < len(message):
        if message[at] == 0:
            return at + 1
        n = _prefix(message, at + 1)
        if message[at] != 1 or n < 4:
            return None
        at += 1 + n
    return None


def _as_text(value: str | float | int | None) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return str(int(value)) if value == value and abs(value) != float("inf") else None


def say(message: bytes | None) -> tuple:
    """(command, its value, collection, source, ok, code, name of the code) of an OP_MSG; None for what it does not say.

    The command is the first key of the body, as the protocol has it, if it is a command's name. All other keys are looked for at the top of the body alone: a key of the same
    name in a document that is inserted, or in an error within a list of errors, says nothing about the message.
    """
    at = body_of(message) if message else None
    if at is None or int.from_bytes(message[12:16], "little") != 2013:
        return (None,) * 7
    command = value = collection = source = ok = code = name = None
    for k, (kind, key, start, end) in enumerate(elements(message, at)):
        if k == 0 and key in MONGO_COMMANDS:
            command, value = key, _as_text(scalar(message, kind, start, end))
            if key in MONGO_COLLECTION_COMMANDS and kind == STRING:
                collection = value
        elif key == "collection" and collection is None and kind == STRING:
            collection = scalar(message, kind, start, end)
        elif key in ("$db", "ns") and kind == STRING and (source is None or key == "$db"):
            source = scalar(message, kind, start, end)
        elif key in ("ok", "code") and kind in (DOUBLE, INT32, INT64, BOOLEAN):
            number = scalar(message, kind, start, end)
            ok, code = (int(number), code) if key == "ok" and number == number else (ok, int(number) if number == number else None)
        elif key == "codeName" and kind == STRING:
            name = scalar(message, kind, start, end)
    if code is not None:
        name = name or MONGO_CODES.get(code, str(code))
    return command, value, collection, source, ok, code, name


SAID = "command string, command_value string, collection string, source string, ok int, code int, code_name string"


def said(messages: pd.Series) -> pd.DataFrame:
    """``say`` of a batch of messages."""
    rows = pd.DataFrame([say(m) for m in messages], columns=[x.split()[0] for x in SAID.split(", ")], dtype=object)
    return rows.assign(ok=rows["ok"].astype("Int32"), code=rows["code"].astype("Int32"))
