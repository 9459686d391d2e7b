"""AMQP messages put together by channel: method, content header and body frames that belong together become one row."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..functions.names import AMQP_CLASSES, AMQP_ERRORS, AMQP_METHODS
from .framing import Buffer, Fold, folded

METHOD, HEADER, BODY = 1, 2, 3
#: Channels of one direction of a connection that are waited for at most; a further one sends the smallest number away.
CHANNELS = 128
#: Methods that content follows.
CONTENT = frozenset({(60, 40), (60, 50), (60, 60), (60, 71)})
#: The first arguments of methods: a number is that many bytes to step over, ``c`` a reply code, ``s`` a short text, ``e`` the one that is an exchange, ``r`` a routing
#: key, ``q`` a queue.
ARGUMENTS = {
    (10, 50): "c s",
    (20, 40): "c s",
    (40, 10): "2 e",
    (40, 20): "2 e",
    (50, 10): "2 q",
    (50, 11): "q",
    (50, 20): "2 q e r",
    (50, 30): "2 q",
    (50, 40): "2 q",
    (50, 50): "2 q e r",
    (60, 20): "2 q s",
    (60, 40): "2 e r",
    (60, 50): "c s e r",
    (60, 60): "s 8 1 e r",
    (60, 70): "2 q",
    (60, 71): "8 1 e r",
}


def arguments(kind: tuple[int, int], b: bytes, at: int) -> dict[str, str | int]:
    """Arguments by letter, as far as bytes go."""
    out: dict[str, str | int] = {}
    for step in ARGUMENTS.get(kind, "").split():
        if step.isdigit():
            at += int(step)
        elif step == "c":
            if at + 2 > len(b):
                break
            out["c"], at = int.from_bytes(b[at : at + 2], "big"), at + 2
        else:
            if at >= len(b) or at + 1 + b[at] > len(b):
                break
            out[step], at = b[at + 1 : at + 1 + b[at]].decode("utf-8", "replace"), at + 1 + b[at]
    return out


@dataclass
class Slot:
    """What a channel is in the middle of: its method and, once the content header is there, how many bytes of the body are to come."""

    kind: tuple[int, int]
    said: dict[str, str | int]
    first_ns: int
    size: int = 0
    frames: int = 0
    body: int = 0
    left: int = -1


class Channels(Fold):
    """Rows of ``_MESSAGES``. A method without content is a row at once. One with content is a row when its body is whole; a method that comes before that takes its place, and
    frames of content without a method before them are left out, as what they belong to was not seen."""

    def __init__(self, most: int = CHANNELS):
        self.buffer, self.most = Buffer(), most
        self.slots: dict[int, Slot] = {}

    def feed(self, payload: bytes, ns: int) -> Iterator[tuple]:
        for frame, size, first, last in self.buffer.feed("amqp", payload, ns):
            if not frame.startswith(b"AMQP"):
                yield from self._frame(frame, size, first, last)

    def _frame(self, b: bytes, size: int, first: int, last: int) -> Iterator[tuple]:
        kind, channel = b[0], int.from_bytes(b[1:3], "big")
        if kind == METHOD and len(b) >= 11:
            method = int.from_bytes(b[7:9], "big"), int.from_bytes(b[9:11], "big")
            slot = Slot(method, arguments(method, b[: size - 1], 11), first)
            self.slots.pop(channel, None)
            if method not in CONTENT:
                yield self._row(channel, slot, size, last)
                return
            if len(self.slots) >= self.most:
                del self.slots[min(self.slots)]
            self.slots[channel] = slot
            slot.size, slot.frames = size, 1
            return
        slot = self.slots.get(channel)
        if slot is None or kind not in (HEADER, BODY):
            return
        slot.size, slot.frames = slot.size + size, slot.frames + 1
        if kind == HEADER and slot.left < 0 and len(b) >= 19:
            slot.body = slot.left = int.from_bytes(b[11:19], "big")
        elif kind == BODY and slot.left >= 0:
            slot.left -= size - 8
        else:
            del self.slots[channel]
            return
        if slot.left <= 0:
            del self.slots[channel]
            yield self._row(channel, slot, 0, last)

    def _row(self, channel: int, s: Slot, size: int, last: int) -> tuple:
        name, method = AMQP_CLASSES.get(s.kind[0], str(s.kind[0])), AMQP_METHODS.get(s.kind[0], {}).get(s.kind[1], str(s.kind[1]))
        code = s.said.get("c")
        texts = [s.said.get(k) for k in "erq"]
        return channel, name, method, f"{name}.{method}", *texts, s.body if s.kind in CONTENT else None, code, None if code is None else AMQP_ERRORS.get(code, "Unknown"), s.frames or 1, s.size or size, s.first_ns, last


_MESSAGES = "channel bigint, class string, method string, class_method string, exchange string, routing_key string, queue_name string, body_size bigint, error_code bigint, error string, frames bigint, size bigint, first_ns bigint, last_ns bigint"


def messages(segments: DataFrame, stream: Sequence[str], order: Sequence[str], most: int = CHANNELS) -> DataFrame:
    """One row for each method, with the content that follows it: what of exchange, routing key and queue it names, the body's size, how many frames and bytes it took."""
    return folded(segments, stream, order, lambda: Channels(most), _MESSAGES)
