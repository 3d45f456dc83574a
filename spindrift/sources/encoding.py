"""Bytes of text files to characters: byte order marks, UTF-16 without one, UTF-8, legacy code pages, repair."""

from __future__ import annotations

#: Byte order marks, and names that mean "find out".
MARKS = [(b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe\x00\x00", "utf-32-le"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")]
AUTO = {"", "auto", "none"}
NAMES = {"latin1": "latin-1", "macintosh": "mac_roman", "ibm866": "cp866", "sjis": "cp932", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}


def is_binary(data: bytes) -> bool:
    """A NUL in the head, unless the bytes look like UTF-16."""
    return b"\0" in data[:8192] and wide(data) is None and not any(data.startswith(m) for m, _ in MARKS)


def wide(data: bytes) -> str | None:
    """UTF-16 without a mark: NULs nearly always on one side of the pairs and never on the other."""
    head = data[:4096]
    if len(head) < 8:
        return None
    even, odd = head[0::2].count(0), head[1::2].count(0)
    half = len(head) // 2
    if odd > 0.6 * half and even < 0.02 * half:
        return "utf-16-le"
    if even > 0.6 * half and odd < 0.02 * half:
        return "utf-16-be"
    return None


def decode(data: bytes, label: str = "auto") -> tuple[str, str, bool]:
    """Text, the encoding used and whether anything was repaired. A mark wins over the label, the label over guessing."""
    for mark, name in MARKS:
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace"), name, False
    wanted = (label or "").strip().lower()
    if wanted not in AUTO:
        try:
            return data.decode(NAMES.get(wanted, wanted)), wanted, False
        except (UnicodeDecodeError, LookupError):
            pass
    if guess := wide(data):
        return data.decode(guess, "replace"), guess, False
    try:
        return data.decode("utf-8"), "utf-8", False
    except UnicodeDecodeError as e:
        if e.start > 0.9 * len(data) and len(data) - e.start < 4:  # cut inside the last character
            return data[: e.start].decode("utf-8"), "utf-8", True
    high = sum(b >= 0x80 for b in data[:65536])
    try:
        text = data.decode("utf-8", "replace")
        if text.count("�") * 20 < high:  # nearly all of it is UTF-8
            return text, "utf-8", True
        return data.decode("cp1252"), "cp1252", False
    except UnicodeDecodeError:
        return data.decode("latin-1"), "latin-1", True
