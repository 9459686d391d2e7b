"""Header compression of HTTP/2 (RFC 7541), for one direction of a connection."""

from __future__ import annotations

#: The static table of the specification.
STATIC = [
    (":authority", ""), (":method", "GET"), (":method", "POST"), (":path", "/"), (":path", "/index.html"), (":scheme", "http"), (":scheme", "https"),
    *((":status", s) for s in ("200", "204", "206", "304", "400", "404", "500")), ("accept-charset", ""), ("accept-encoding", "gzip, deflate"),
    *((n, "") for n in (
        "accept-language accept-ranges accept access-control-allow-origin age allow authorization cache-control content-disposition content-encoding content-language "
        "content-length content-location content-range content-type cookie date etag expect expires from host if-match if-modified-since if-none-match if-range "
        "if-unmodified-since last-modified link location max-forwards proxy-authenticate proxy-authorization range referer refresh retry-after server set-cookie "
        "strict-transport-security transfer-encoding user-agent vary via www-authenticate"
    ).split()),
]
#: Bytes by the length of their Huffman code. Codes count on within a length and are shifted on to the next, so the lengths give them.
LENGTHS = {
    5: b"012aceiost",
    6: b" %-./3456789=A_bdfghlmnpru",
    7: b":BCDEFGHIJKLMNOPQRSTUVWYjkqvwxyz",
    8: b"&*,;XZ",
    10: b'!"()?',
    11: b"'+|",
    12: b"#>",
    13: b"\x00$@[]~",
    14: b"^}",
    15: b"<`{",
    19: b"\\\xc3\xd0",
    20: b"\x80\x82\x83\xa2\xb8\xc2\xe0\xe2",
    21: b"\x99\xa1\xa7\xac\xb0\xb1\xb3\xd1\xd8\xd9\xe3\xe5\xe6",
    22: b"\x81\x84\x85\x86\x88\x92\x9a\x9c\xa0\xa3\xa4\xa9\xaa\xad\xb2\xb5\xb9\xba\xbb\xbd\xbe\xc4\xc6\xe4\xe8\xe9",
    23: b"\x01\x87\x89\x8a\x8b\x8c\x8d\x8f\x93\x95\x96\x97\x98\x9b\x9d\x9e\xa5\xa6\xa8\xae\xaf\xb4\xb6\xb7\xbc\xbf\xc5\xe7\xef",
    24: b"\t\x8e\x90\x91\x94\x9f\xab\xce\xd7\xe1\xec\xed",
    25: b"\xc7\xcf\xea\xeb",
    26: b"\xc0\xc1\xc8\xc9\xca\xcd\xd2\xd5\xda\xdb\xee\xf0\xf2\xf3\xff",
    27: b"\xcb\xcc\xd3\xd4\xd6\xdd\xde\xdf\xf1\xf4\xf5\xf6\xf7\xf8\xfa\xfb\xfc\xfd\xfe",
    28: bytes([*range(2, 9), 11, 12, *range(14, 22), *range(23, 32), 127, 220, 249]),
    30: b"\n\r\x16",
}
#: Dynamic tables do not grow beyond what a receiver may announce within reason.
MOST = 65_536


def _codes() -> dict[tuple[int, int], int]:
    out, code, last = {}, 0, 0
    for size, chars in LENGTHS.items():
        code <<= size - last
        for c in chars:
            out[size, code] = c
            code += 1
        last = size
    return out


CODES = _codes()


class Unreadable(ValueError):
    """The block cannot be read, as when the capture began in the middle of the connection."""


def huffman(data: bytes) -> str:
    out, code, size = bytearray(), 0, 0
    for byte in data:
        for k in range(7, -1, -1):
            code, size = code << 1 | byte >> k & 1, size + 1
            c = CODES.get((size, code))
            if c is not None:
                out.append(c)
                code = size = 0
            elif size >= 30:
                raise Unreadable("the end's own code")
    if size > 7 or code != (1 << size) - 1:
        raise Unreadable("bad padding")
    return out.decode("utf-8", "replace")


class Decoder:
    """Reads header blocks in order; keeps the dynamic table."""

    def __init__(self) -> None:
        self.table: list[tuple[str, str]] = []
        self.room = 4096

    def _number(self, data: bytes, at: int, bits: int) -> tuple[int, int]:
        most = (1 << bits) - 1
        n = data[at] & most
        at += 1
        if n == most:
            shift = 0
            while True:
                if at >= len(data) or shift > 28:
                    raise Unreadable("cut number")
                n += (data[at] & 127) << shift
                shift += 7
                at += 1
                if not data[at - 1] & 128:
                    break
        return n, at

    def _string(self, data: bytes, at: int) -> tuple[str, int]:
        if at >= len(data):
            raise Unreadable("cut string")
        n, start = self._number(data, at, 7)
        part = data[start : start + n]
        if len(part) < n:
            raise Unreadable("cut string")
        return (huffman(part) if data[at] & 128 else part.decode("utf-8", "replace")), start + n

    def _entry(self, index: int) -> tuple[str, str]:
        if not 0 < index <= len(STATIC) + len(self.table):
            raise Unreadable("no such entry")
        return STATIC[index - 1] if index <= len(STATIC) else self.table[index - len(STATIC) - 1]

    def _trim(self) -> None:
        while self.table and sum(len(k) + len(v) + 32 for k, v in self.table) > self.room:
            self.table.pop()

    def read(self, data: bytes) -> list[tuple[str, str]]:
        out, at = [], 0
        while at < len(data):
            first = data[at]
            if first & 0x80:
                index, at = self._number(data, at, 7)
                out.append(self._entry(index))
            elif first & 0xE0 == 0x20:
                size, at = self._number(data, at, 5)
                self.room = min(size, MOST)
                self._trim()
            else:
                keep = first & 0x40
                index, at = self._number(data, at, 6 if keep else 4)
                if index:
                    name = self._entry(index)[0]
                else:
                    name, at = self._string(data, at)
                value, at = self._string(data, at)
                out.append((name, value))
                if keep:
                    self.table.insert(0, (name, value))
                    self._trim()
        return out


class Headers:
    """Fields of the frames of one direction: a block may run over several frames."""

    def __init__(self) -> None:
        self.decoder = Decoder()
        self.block = b""

    def feed(self, frame: bytes) -> dict[str, str] | None:
        """The fields of the block that ends with this frame (the last of equal names counts), else null. After a block that cannot be read a new table is begun."""
        if len(frame) < 9 or frame[3] not in (1, 5, 9):
            return None
        kind, flags, body = frame[3], frame[4], frame[9:]
        if kind != 9 and flags & 8:
            body = body[1 : len(body) - body[0]] if body else b""
        if kind == 1 and flags & 0x20:
            body = body[5:]
        if kind == 5:
            body = body[4:]
        self.block = (self.block if kind == 9 else b"") + body
        if not flags & 4:
            return None
        try:
            return dict(self.decoder.read(self.block))
        except Unreadable:
            self.decoder = Decoder()
            return None
