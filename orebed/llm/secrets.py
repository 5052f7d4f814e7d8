"""Secret scans with a recursive decoding worklist.

A text is scanned, then its encoded parts are unwrapped: percent escapes and Unicode escapes give a
decoded copy of the whole layer, a base64 run, over line ends too and in every alignment, gives layers of its own
(the streams compressed in it, and its bytes as they are).  The list runs until nothing new appears.  A copy is
taken once for its text and its places; what a base64 run leads to is worked out once for its bytes and
reported at every place where they stand.  Spans found in a layer are mapped back through the layers to the whole text.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib

from pyspark.sql import DataFrame

from .spans import detect, offsets

KINDS = ("assign", "access", "hex", "bomb")
BASE_KINDS = KINDS[:3]
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
WORDS = ("password", "passwd", "secret", "token", "api")
LEAST_VALUE = 6
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
RUN64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 in lines, whose ends may themselves be escaped.
LINES64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}(?:[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t]*[A-Za-z0-9+/_-]+={0,2})+")
LINE_END = re.compile(r"[\x20\t]*(?:\r?\n|(?:\\r)?\\n)[\x20\t]*")
LEAST_RUN = 16
#: Beginnings of compressed streams that are told from other bytes anywhere; zlib's two bytes count only where a stream is due.
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
#: What is decompressed to more than this is reported as a span of kind bomb and scanned in windows of this size,
#: which overlap by OVERLAP_BYTES at most: memory stays bounded, and only layers longer than a window are seen in parts.
LAYER_BYTES, OVERLAP_BYTES = 8 << 20, 1 << 16
#: Compressed bytes given to a decompressor at once; few, where its output is not bounded.
FED_BYTES, FED_UNBOUNDED = 1 << 12, 1 << 8
BOMB = 3


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of assignments, access keys and long hexadecimal runs."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return out


def _replaced(text: str, pattern: re.Pattern, decode) -> tuple[str, list[tuple[int, int, int]]] | None:
    """``text`` with the matches decoded, and the pieces it is made of; None if nothing changes."""
    out, pieces, done = [], [], 0
    for m in pattern.finditer(text):
        new = decode(m)
        if new is None:
            continue
        if m.start() > done:
            out.append(text[done : m.start()])
            pieces.append((done, m.start(), m.start() - done))
        out.append(new)
        if pattern is PERCENT and 3 * len(new) == m.end() - m.start():
            pieces += [(m.start() + 3 * i, m.start() + 3 * i + 3, 1) for i in range(len(new))]
        else:
            pieces.append((m.start(), m.end(), len(new)))
        done = m.end()
    if not out:
        return None
    if done < len(text):
        out.append(text[done:])
        pieces.append((done, len(text), len(text) - done))
    return "".join(out), pieces


def _percent(m: re.Match) -> str:
    data = bytes.fromhex(m.group().replace("%", ""))
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _unicode(m: re.Match) -> str | None:
    code = int(next(g for g in m.groups() if g), 10 if m.group(5) else 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else None


def _tool(data: bytes, at: int, due: bool):
    """A decompressor for the stream that begins in ``data`` at ``at``, or None."""
    import zstandard

    head = data[at : at + 6]
    if head[:3] == b"\x1f\x8b\x08" or due and head[:1] == b"\x78" and len(head) > 2 and (head[0] * 256 + head[1]) % 31 == 0:
        return zlib.decompressobj(47)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    return None


def _stream(tool, data: bytes, at: int):
    """Output pieces of the stream at ``at``, fed in small parts so that a broken stream gives what stands before
    the break.  Returns the place after the stream, None for a broken one."""
    bounded = not type(tool).__module__.startswith("zstandard")
    fed, most = (FED_BYTES, max(1, LAYER_BYTES // 8)) if bounded else (FED_UNBOUNDED, 0)
    try:
        while at < len(data):
            part = data[at : at + fed]
            at += len(part)
            while True:
                yield tool.decompress(part, most) if bounded else tool.decompress(part)
                part = getattr(tool, "unconsumed_tail", b"")
                if tool.eof or not (part or bounded and not getattr(tool, "needs_input", True)):
                    break
            if tool.eof:
                return at - len(tool.unused_data)
    except (zlib.error, OSError, lzma.LZMAError, EOFError, ValueError):
        return None
    except Exception as broken:
        if type(broken).__name__ != "ZstdError":
            raise
    return None


def _layers(data: bytes):
    """What is decoded from ``data``: ("bytes", bytes), ("text", text) and ("bomb", None).

    Streams that follow each other are one layer; where anything is no stream, or is a broken one, the
    bytes are a layer as they are too, read as Latin-1 (every pattern is ASCII) and, with zero
    bytes among them, as the two halves of UTF-16."""
    at, due, plain = 0, True, False
    while at < len(data):
        tool = _tool(data, at, due)
        if tool is None:
            plain = True
            found = MAGIC.search(data, at)
            if not found:
                break
            at, due = found.start(), False
            tool = _tool(data, at, due)
        held, windows = bytearray(), 0
        overlap = min(OVERLAP_BYTES, LAYER_BYTES // 4)
        while tool is not None:
            begun, stream = at, _stream(tool, data, at)
            while True:
                try:
                    held += next(stream)
                except StopIteration as end:
                    after = end.value
                    break
                while len(held) > LAYER_BYTES:
                    if not windows:
                        yield "bomb", None
                    yield ("text", held[:LAYER_BYTES].decode("latin-1")) if windows else ("bytes", bytes(held[:LAYER_BYTES]))
                    windows += 1
                    del held[: LAYER_BYTES - overlap]
            if after is None:
                at, due, plain, tool = begun + 1, False, True, None
            else:
                at, due = after, True
                tool = _tool(data, at, due) if at < len(data) else None
        if held:
            yield ("text", held.decode("latin-1")) if windows else ("bytes", bytes(held))
    if plain:
        yield "text", data.decode("latin-1")
        if b"\0" in data:
            yield "text", data[::2].decode("latin-1")
            yield "text", data[1::2].decode("latin-1")


def _base64(run: str) -> list[bytes]:
    """The bytes of a run in each alignment, as it may follow a path or a name; an incomplete last group is left out.

    The first alignment is that of the run; parts after a sign that also separates words begin a layer of their
    own, for the compressed streams that are known only where they begin."""
    bare = run.rstrip("=").replace("-", "+").replace("_", "/")
    out = []
    starts = [0, 1, 2, 3]
    starts += [m.end() for m in ZLIB.finditer(bare) if _tool(base64.b64decode(bare[m.end() : m.end() + 4]), 0, True)]
    for start in starts:
        part = bare[start:]
        part = part[: len(part) - (len(part) % 4 == 1)]
        try:
            data = base64.b64decode(part + "=" * (-len(part) % 4))
        except binascii.Error:
            continue
        if data:
            out.append(data)
    return out


#: After a sign that also separates words, what base64 makes of zlib's first byte.
ZLIB = re.compile(r"[+/](?=e[AJN][A-Za-z0-9+/]{2})")


def _runs(text: str):
    """Start, end and decoded bytes of each base64 run; then of those over several lines."""
    for m in RUN64.finditer(text):
        for data in _base64(m.group()):
            yield m.start(), m.end(), data
    if "\n" in text or "\\n" in text:
        for m in LINES64.finditer(text):
            for run in LINE_END.sub("", m.group()).split("="):
                if len(run) >= LEAST_RUN:
                    for data in _base64(run):
                        yield m.start(), m.end(), data


def _copies(text: str):
    """The decoded copies of a whole layer, each with the pieces it is made of."""
    if "%" in text:
        yield _replaced(text, PERCENT, _percent)
    if "\\" in text or "&#" in text:
        yield _replaced(text, UNICODE, _unicode)


def _digest(*parts: bytes) -> bytes:
    return hashlib.blake2b(b"".join(hashlib.blake2b(p).digest() for p in parts), digest_size=16).digest()


class _Inner:
    """The kinds found in decoded bytes and in everything decoded from them.

    All of it maps to the one run that the bytes stand in, so kinds are enough.  What a layer holds and leads to is worked out
    once for a text, however often the layer occurs; each call then walks what its own bytes lead to,
    so cycles end and no occurrence is skipped.  Only digests are kept of the layers: those in work are the
    chain that leads to the one being decoded."""

    def __init__(self):
        self.known: dict[bytes, tuple[set[int], list[bytes]]] = {}
        self.kinds: dict[bytes, frozenset[int]] = {}

    @staticmethod
    def _expand(kind: str, value):
        """The kinds of one layer as numbers, and the layers decoded from it as (kind, value)."""
        if kind == "bytes":
            yield from _layers(value)
            return
        yield from {k for _, k, _ in base_spans(value)}
        if "%" in value:
            yield "text", PERCENT.sub(_percent, value)
        if "\\" in value or "&#" in value:
            yield "text", UNICODE.sub(lambda m: m.group() if (new := _unicode(m)) is None else new, value)
        for _, _, data in _runs(value):
            yield "bytes", data

    def of(self, data: bytes) -> frozenset[int]:
        first = _digest(b"bytes", data)
        if first not in self.known:
            self.known[first] = set(), []
            work = [(first, self._expand("bytes", data))]
            while work:
                key, rest = work[-1]
                new = next(rest, None)
                if new is None:
                    work.pop()
                elif isinstance(new, int):
                    self.known[key][0].add(new)
                elif new[0] == "bomb":
                    self.known[key][0].add(BOMB)
                else:
                    child = _digest(new[0].encode(), new[1] if new[0] == "bytes" else new[1].encode("utf-8", "surrogatepass"))
                    self.known[key][1].append(child)
                    if child not in self.known:
                        self.known[child] = set(), []
                        work.append((child, self._expand(*new)))
                new = None
        if first not in self.kinds:
            todo, reached, kinds = [first], {first}, set()
            while todo:
                found, following = self.known[todo.pop()]
                kinds |= found
                todo += (fresh := set(following) - reached)
                reached |= fresh
            self.kinds[first] = frozenset(kinds)
        return self.kinds[first]


def whole_layers(text: str):
    """``text`` and its decoded copies: (text, start, end in the first text and whether it was decoded, of each character; None for the first).

    A copy is the same as an earlier one if its text and its places are."""
    work, seen = [(text, None)], set()
    while work:
        now, at = work.pop()
        yield now, at
        for new in _copies(now):
            if not new:
                continue
            s, e = offsets(new[1])
            changed = (e - s) != 1
            if at is not None:
                e, s, changed = at[1][e - 1], at[0][s], changed | at[2][s] | at[2][e - 1]
            key = _digest(new[0].encode("utf-8", "surrogatepass"), s.tobytes(), e.tobytes())
            if key not in seen:
                seen.add(key)
                work.append((new[0], (s, e, changed)))


def find(text: str) -> tuple[list, list]:
    """Base spans, and all spans: base ones and those of the decoded layers mapped to ``text``."""
    base = base_spans(text)
    every = set(base)
    inner = _Inner()
    for layer, at in whole_layers(text):
        if at is not None:
            every.update((int(at[0][s]), k, int(at[1][e - 1])) for s, k, e in base_spans(layer) if at[2][s:e].any())
        own: list[tuple[int, int, int]] = []  # spans over lines say only what no line of theirs says
        for s, e, data in _runs(layer):
            place = (s, e) if at is None else (int(at[0][s]), int(at[1][e - 1]))
            for k in inner.of(data):
                if not any(k == q and place[0] <= a and b <= place[1] and (a, b) != place for a, q, b in own):
                    own.append((place[0], k, place[1]))
        every.update(own)
    return base, sorted(every)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base_spans, spans for each row of ``docs``.

    Spans are (kind, start, end) in code points of the whole text, sorted by start, then kind.  A null
    text is an empty text without spans.  Ids may be null or repeat; each row returns.  Other columns
    are not read.  An empty table returns no rows.
    """
    return detect(docs, KINDS, find, id_col, text_col)
