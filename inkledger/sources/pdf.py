"""PDF files as a glyph relation.

A reader in plain Python that does one thing: it walks the page tree, runs the
content streams, and emits a row for every code that is shown, with where it
came from. What it can't read becomes a diagnostic row and never ends the job.
On Spark, files are read as ``binaryFile`` and each is one row's work; rows
leave by the batch, so a long document is not held as objects.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from inkledger.sources.cjk import Predefined, predefined

#: Bytes that a stream may grow to, nesting of forms, diagnostics of a page.
MOST_BYTES, DEPTH, MOST_NOTES = 64 << 20, 12, 200
DEFAULT_BOX = [0.0, 0.0, 612.0, 792.0]
BATCH = 20_000

GLYPH_DDL = (
    "path string, kind string, id long, page_index int, unicode string, unmapped boolean, char_code binary, font_name string, font_size double, x double, y double, matrix array<double>, "
    "x0 double, y0 double, x1 double, y1 double, dx double, dy double, fill_space string, fill array<double>, render_mode int, invisible boolean, source_kind string, operator_index int, state string, reason string, message string"
)
_SCHEMA = pa.schema(
    [("path", pa.string()), ("kind", pa.string()), ("id", pa.int64()), ("page_index", pa.int32()), ("unicode", pa.string()), ("unmapped", pa.bool_()), ("char_code", pa.binary()), ("font_name", pa.string()), ("font_size", pa.float64()), ("x", pa.float64()), ("y", pa.float64()), ("matrix", pa.list_(pa.float64()))]
    + [(n, pa.float64()) for n in ("x0", "y0", "x1", "y1", "dx", "dy")]
    + [("fill_space", pa.string()), ("fill", pa.list_(pa.float64())), ("render_mode", pa.int32()), ("invisible", pa.bool_()), ("source_kind", pa.string()), ("operator_index", pa.int32()), ("state", pa.string()), ("reason", pa.string()), ("message", pa.string())]
)


class Name(str):
    """A PDF name, without its slash."""


class Operator(str):
    """A word of a content stream that isn't a value."""


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    data: bytes


_WHITE, _DELIMITERS = b"\x00\t\n\x0c\r ", b"()<>[]{}/%"
_TOKEN = re.compile(rb"[^\x00\t\n\x0c\r ()<>\[\]{}/%]+")
_NUMBER = re.compile(rb"[+-]?(?:\d+\.?\d*|\.\d+)\Z")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Lexer:
    """Values and operators of a byte string, one after the other."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs

    def _skip(self) -> None:
        data, n = self.data, len(self.data)
        while self.at < n:
            c = data[self.at]
            if c in _WHITE:
                self.at += 1
            elif c == 0x25:  # a comment
                while self.at < n and data[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def next(self):
        """The next value; None at the end."""
        self._skip()
        data = self.data
        if self.at >= len(data):
            return None
        c = data[self.at : self.at + 1]
        if c == b"/":
            m = _TOKEN.match(data, self.at + 1)
            raw = m[0] if m else b""
            self.at += 1 + len(raw)
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), raw).decode("latin-1"))
        if c == b"(":
            return self._literal()
        if c == b"<":
            if data[self.at : self.at + 2] == b"<<":
                self.at += 2
                return self._dict()
            end = data.find(b">", self.at)
            end = len(data) if end < 0 else end
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[self.at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            out = []
            while True:
                self._skip()
                if self.at >= len(data) or data[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self.next())
        if c in (b")", b">", b"]", b"{", b"}"):
            self.at += 1
            return Operator(c.decode())
        m = _TOKEN.match(data, self.at)
        self.at = m.end()
        word = m[0]
        if _NUMBER.match(word):
            if self.refs and word.isdigit() and (r := re.compile(rb"[\x00\t\n\x0c\r ]+\d+[\x00\t\n\x0c\r ]+R(?![A-Za-z])").match(data, self.at)):
                self.at = r.end()
                return Ref(int(word))
            return float(word) if b"." in word else int(word)
        return {b"true": True, b"false": False}.get(word, Operator(word.decode("latin-1")))

    def _literal(self) -> bytes:
        out, depth, data, n = bytearray(), 1, self.data, len(self.data)
        self.at += 1
        while self.at < n:
            c = data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                e = data[self.at : self.at + 1]
                self.at += 1
                if e in _ESCAPES:
                    out += _ESCAPES[e]
                elif e.isdigit() and e < b"8":
                    m = re.compile(rb"[0-7]{1,3}").match(data, self.at - 1)
                    self.at = m.end()
                    out.append(int(m[0], 8) & 255)
                elif e == b"\r":
                    self.at += data[self.at : self.at + 1] == b"\n"
                elif e != b"\n":
                    out += e
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
        return bytes(out)

    def _dict(self) -> dict:
        out = {}
        while True:
            self._skip()
            if self.at >= len(self.data) or self.data[self.at : self.at + 2] == b">>":
                self.at += 2
                return out
            key = self.next()
            value = self.next()
            if isinstance(key, Name):
                out[str(key)] = value


class Document:
    """Objects of a file, found by their own marks and not by its cross-reference table, so damaged tables do no harm."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        if re.search(rb"/Encrypt\b", data):
            raise ValueError("encrypted")
        self.objects: dict[int, object] = {}
        for m in re.finditer(rb"(?<![0-9])(\d{1,10})[\x00\t\n\x0c\r ]+\d{1,5}[\x00\t\n\x0c\r ]+obj\b", data):
            self.objects[int(m[1])] = self._object(data, m.end())
        for x in list(self.objects.values()):
            if isinstance(x, Stream) and x.head.get("Type") == "ObjStm":
                self._packed(x)

    def _object(self, data: bytes, at: int):
        lexer = Lexer(data, at)
        value = lexer.next()
        if isinstance(value, dict):
            lexer._skip()
            if data[lexer.at : lexer.at + 6] == b"stream":
                start = lexer.at + 6
                start += 2 if data[start : start + 2] == b"\r\n" else 1
                length = value.get("Length")
                end = start + length if isinstance(length, int) and data[start + length : start + length + 20].lstrip().startswith(b"endstream") else data.find(b"endstream", start)
                return Stream(value, data[start : end if end >= 0 else len(data)])
        return value

    def _packed(self, stream: Stream) -> None:
        data = self.decoded(stream)
        lexer = Lexer(data)
        pairs = [(lexer.next(), lexer.next()) for _ in range(self.get(stream.head.get("N"), 0))]
        first = self.get(stream.head.get("First"), 0)
        for number, offset in pairs:
            if isinstance(number, int) and isinstance(offset, int):
                self.objects.setdefault(number, Lexer(data, first + offset).next())

    def get(self, x, default=None):
        for _ in range(32):
            if not isinstance(x, Ref):
                break
            x = self.objects.get(x.number)
        return default if x is None else x

    def decoded(self, stream: Stream) -> bytes:
        filters = self.get(stream.head.get("Filter"), [])
        data = stream.data
        for f in filters if isinstance(filters, list) else [filters]:
            if self.get(f) in ("FlateDecode", "Fl"):
                data = zlib.decompressobj().decompress(data, MOST_BYTES)
            elif self.get(f) in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
                data = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            else:
                raise ValueError(f"filter {f}")
        return data

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with what they inherit."""
        root = next((x for x in self.objects.values() if isinstance(x, dict) and x.get("Type") == "Catalog"), None)
        if root is None:
            return [x for _, x in sorted(self.objects.items()) if isinstance(x, dict) and x.get("Type") == "Page"]
        out, seen = [], set()

        def walk(x, inherited: dict) -> None:
            if isinstance(x, Ref):
                if x.number in seen:
                    return
                seen.add(x.number)
            node = self.get(x)
            if not isinstance(node, dict):
                return
            merged = inherited | {k: node[k] for k in ("MediaBox", "Rotate", "Resources") if k in node}
            if "Kids" in node:
                for kid in self.get(node["Kids"], []):
                    walk(kid, merged)
            else:
                out.append(merged | node)

        walk(root.get("Pages"), {})
        return out


# Names of glyphs that aren't their own character.
_GLYPH_NAMES = dict(
    zip(
        "space exclam quotedbl numbersign dollar percent ampersand quotesingle parenleft parenright asterisk plus comma hyphen period slash zero one two three four five six seven eight nine colon semicolon less equal greater question at bracketleft backslash bracketright asciicircum underscore grave braceleft bar braceright asciitilde quoteleft quoteright quotedblleft quotedblright bullet endash emdash ellipsis fi fl minus degree section".split(),
        " !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~‘’“”•–—…ﬁﬂ−°§",
        strict=True,
    )
)


def glyph_unicode(name: str) -> str | None:
    base = name.split(".")[0]
    if len(base) == 1:
        return base
    if m := re.fullmatch(r"uni([0-9A-F]{4})|u([0-9A-F]{4,6})", base):
        return chr(int(m[1] or m[2], 16))
    return _GLYPH_NAMES.get(base)


def parse_cmap(data: bytes) -> tuple[dict[bytes, str], list[tuple[bytes, bytes, object]]]:
    """Single codes, and ranges (low, high, first text or list), of a ToUnicode map."""
    single, ranges, held = {}, [], []
    lexer = Lexer(data, refs=False)
    while (x := lexer.next()) is not None:
        if not isinstance(x, Operator):
            held.append(x)
            continue
        if x == "endbfchar":
            single.update({a: b.decode("utf-16-be", "replace") for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)})
        elif x == "endbfrange":
            ranges += [(a, b, c) for a, b, c in zip(held[::3], held[1::3], held[2::3], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)]
        held = []
    return single, ranges


@dataclass
class Font:
    name: str = "unknown"
    two_bytes: bool = False
    single: dict = field(default_factory=dict)
    ranges: list = field(default_factory=list)
    codec: str = "cp1252"
    predefined: Predefined | None = None
    differences: dict = field(default_factory=dict)
    widths: dict = field(default_factory=dict)
    default: float = 500.0

    def codes(self, text: bytes) -> Iterator[bytes]:
        if self.predefined:
            yield from self.predefined.codes(text)
            return
        n = 2 if self.two_bytes else 1
        for i in range(0, len(text), n):
            yield text[i : i + n]

    def unicode(self, code: bytes) -> str | None:
        if code in self.single:
            return self.single[code]
        for low, high, to in self.ranges:
            if len(low) == len(code) and low <= code <= high:
                k = int.from_bytes(code, "big") - int.from_bytes(low, "big")
                if isinstance(to, list):
                    return to[k].decode("utf-16-be", "replace") if k < len(to) and isinstance(to[k], bytes) else None
                text = to.decode("utf-16-be", "replace")
                return text[:-1] + chr(ord(text[-1]) + k) if text else None
        if self.predefined:
            return self.predefined.unicode(code)
        if self.two_bytes:
            return None
        if code[0] in self.differences:
            return glyph_unicode(self.differences[code[0]])
        text = code.decode(self.codec, "ignore")
        return text if text and (text.isprintable() or text == "\xa0") else None

    def width(self, code: bytes) -> float:
        return self.widths.get(int.from_bytes(code, "big"), self.default) / 1000


def load_font(doc: Document, spec) -> Font:
    spec = doc.get(spec, {})
    font = Font(name=str(doc.get(spec.get("BaseFont"), "unknown")))
    try:
        if isinstance(stream := doc.get(spec.get("ToUnicode")), Stream):
            font.single, font.ranges = parse_cmap(doc.decoded(stream))
    except (ValueError, zlib.error):
        pass
    encoding = doc.get(spec.get("Encoding"))
    base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
    font.codec = "mac_roman" if base == "MacRomanEncoding" else "cp1252"
    if isinstance(encoding, dict):
        at = 0
        for x in doc.get(encoding.get("Differences"), []):
            if isinstance(x, int):
                at = x
            else:
                font.differences[at] = str(x)
                at += 1
    if spec.get("Subtype") == "Type0":
        font.two_bytes = True
        font.predefined = predefined(encoding) if isinstance(encoding, str) else None
        below = doc.get((doc.get(spec.get("DescendantFonts"), [{}]) or [{}])[0], {})
        font.default = float(doc.get(below.get("DW"), 1000))
        values, i = doc.get(below.get("W"), []), 0
        while i + 1 < len(values):
            first, second = doc.get(values[i]), doc.get(values[i + 1])
            if isinstance(second, list):
                font.widths.update({first + k: float(doc.get(w, 0)) for k, w in enumerate(second)})
                i += 2
            else:
                w = float(doc.get(values[i + 2], 0)) if i + 2 < len(values) else font.default
                font.widths.update(dict.fromkeys(range(first, min(second, first + 65535) + 1), w))
                i += 3
    else:
        first = doc.get(spec.get("FirstChar"), 0)
        font.widths = {first + k: float(doc.get(w, 0)) for k, w in enumerate(doc.get(spec.get("Widths"), []))}
        descriptor = doc.get(spec.get("FontDescriptor"), {})
        font.default = float(doc.get(descriptor.get("MissingWidth"), 500) or 500)
    return font


def times(m: tuple, n: tuple) -> tuple:
    """First ``m``, then ``n``."""
    a, b, c, d, e, f = m
    g, h, i, j, k, o = n
    return (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + o)


@dataclass(frozen=True)
class State:
    ctm: tuple = (1, 0, 0, 1, 0, 0)
    font: Font = field(default_factory=Font)
    size: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0
    space: str = "DeviceGray"
    fill: tuple = (0.0,)


class Page:
    """Runs one page's content; ``rows`` gets glyphs, regions and diagnostics."""

    def __init__(self, doc: Document, index: int, spec: dict, first_id: int):
        self.doc, self.index, self.spec = doc, index, spec
        self.rows: list[dict] = []
        self.next_id, self.notes = first_id, 0
        self.fonts: dict[int, Font] = {}

    def note(self, message: str) -> None:
        if self.notes < MOST_NOTES:
            self.rows.append({"kind": "diagnostic", "page_index": self.index, "message": message})
        self.notes += 1

    def run(self) -> None:
        box = [float(self.doc.get(v, 0)) for v in self.doc.get(self.spec.get("MediaBox"), DEFAULT_BOX)]
        self.rows.append({"kind": "page", "page_index": self.index, "x0": box[0], "y0": box[1], "x1": box[2], "y1": box[3], "render_mode": int(self.doc.get(self.spec.get("Rotate"), 0))})
        contents = self.doc.get(self.spec.get("Contents"), [])
        parts = []
        for part in contents if isinstance(contents, list) else [contents]:
            stream = self.doc.get(part)
            if isinstance(stream, Stream):
                try:
                    parts.append(self.doc.decoded(stream))
                except (ValueError, zlib.error) as e:
                    self.note(f"content stream: {e}")
        self.content(b"\n".join(parts), self.doc.get(self.spec.get("Resources"), {}), State(), "page", 0)

    def content(self, data: bytes, resources: dict, state: State, kind: str, depth: int) -> None:
        doc, lexer, args, stack = self.doc, Lexer(data, refs=False), [], []
        matrix = line = (1, 0, 0, 1, 0, 0)
        path: list[tuple[float, float]] = []
        at = -1

        def number(k: int) -> float:
            return float(args[k]) if -len(args) <= k < len(args) and isinstance(args[k], (int, float)) else 0.0

        def show(text: bytes) -> None:
            nonlocal matrix
            for code in state.font.codes(text):
                advance = state.font.width(code) * state.size + state.char_space + (state.word_space if code == b" " else 0.0)
                self.glyph(code, times((state.size * state.scale, 0, 0, state.size, 0, state.rise), times(matrix, state.ctm)), advance * state.scale, times(matrix, state.ctm), state, kind, at)
                matrix = times((1, 0, 0, 1, advance * state.scale, 0), matrix)

        while (x := lexer.next()) is not None:
            if not isinstance(x, Operator):
                args.append(x)
                continue
            at += 1
            if x == "q":
                stack.append(state)
            elif x == "Q":
                state = stack.pop() if stack else state
            elif x == "cm":
                state = replace(state, ctm=times(tuple(number(k) for k in range(6)), state.ctm))
            elif x == "BT":
                matrix = line = (1, 0, 0, 1, 0, 0)
            elif x in ("Td", "TD"):
                if x == "TD":
                    state = replace(state, leading=-number(1))
                matrix = line = times((1, 0, 0, 1, number(0), number(1)), line)
            elif x == "Tm":
                matrix = line = tuple(number(k) for k in range(6))
            elif x in ("T*", "'", '"'):
                if x == '"':
                    state = replace(state, word_space=number(0), char_space=number(1))
                matrix = line = times((1, 0, 0, 1, 0, -state.leading), line)
                if x != "T*" and args and isinstance(args[-1], bytes):
                    show(args[-1])
            elif x == "Tj" and args and isinstance(args[-1], bytes):
                show(args[-1])
            elif x == "TJ" and args and isinstance(args[-1], list):
                for item in args[-1]:
                    if isinstance(item, bytes):
                        show(item)
                    elif isinstance(item, (int, float)):
                        matrix = times((1, 0, 0, 1, -item / 1000 * state.size * state.scale, 0), matrix)
            elif x == "Tf":
                spec = doc.get(doc.get(resources.get("Font"), {}).get(str(args[0]) if args else "", None))
                if spec is None:
                    self.note(f"no font {args[0] if args else ''}")
                key = id(spec)
                if key not in self.fonts:
                    self.fonts[key] = load_font(doc, spec or {})
                state = replace(state, font=self.fonts[key], size=number(1))
            elif x in ("Tc", "Tw", "Tz", "TL", "Ts", "Tr"):
                name = {"Tc": "char_space", "Tw": "word_space", "Tz": "scale", "TL": "leading", "Ts": "rise", "Tr": "mode"}[x]
                value = number(0)
                state = replace(state, **{name: value / 100 if x == "Tz" else int(value) if x == "Tr" else value})
            elif x in ("g", "rg", "k"):
                state = replace(state, space={"g": "DeviceGray", "rg": "DeviceRGB", "k": "DeviceCMYK"}[x], fill=tuple(number(k) for k in range({"g": 1, "rg": 3, "k": 4}[x])))
            elif x == "re":
                a, b, w, h = (number(k) for k in range(4))
                path += [(a, b), (a + w, b), (a + w, b + h), (a, b + h)]
            elif x in ("m", "l", "c", "v", "y"):
                path.append((number(-2), number(-1)))
            elif x in ("f", "F", "f*", "S", "s", "B", "B*", "b", "b*", "n"):
                if x != "n" and path:
                    self.region(path, state.ctm, "path")
                path = []
            elif x == "Do":
                form = doc.get(doc.get(resources.get("XObject"), {}).get(str(args[0]) if args else "", None))
                if isinstance(form, Stream) and form.head.get("Subtype") == "Image":
                    self.region([(0, 0), (1, 0), (1, 1), (0, 1)], state.ctm, "image")
                elif isinstance(form, Stream) and depth < DEPTH:
                    own = tuple(float(doc.get(v, 0)) for v in doc.get(form.head.get("Matrix"), (1, 0, 0, 1, 0, 0)))
                    try:
                        self.content(doc.decoded(form), doc.get(form.head.get("Resources"), resources), replace(state, ctm=times(own, state.ctm)), "form", depth + 1)
                    except (ValueError, zlib.error) as e:
                        self.note(f"form: {e}")
                else:
                    self.note("forms are nested too deeply" if isinstance(form, Stream) else f"no object {args[0] if args else ''}")
            elif x == "BI":  # an inline image: its bytes are no operators
                end = re.compile(rb"[\x00\t\n\x0c\r ]EI(?=[\x00\t\n\x0c\r ]|\Z)").search(data, lexer.at)
                lexer.at = end.end() if end else len(data)
                self.region([(0, 0), (1, 0), (1, 1), (0, 1)], state.ctm, "image")
            args = []

    def region(self, points: list, ctm: tuple, kind: str) -> None:
        placed = [times((1, 0, 0, 1, x, y), ctm)[4:] for x, y in points]
        xs, ys = zip(*placed, strict=True)
        self.rows.append({"kind": kind, "page_index": self.index, "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys)})

    def glyph(self, code: bytes, m: tuple, advance: float, text: tuple, state: State, kind: str, at: int) -> None:
        unicode = state.font.unicode(code)
        corners = [times((1, 0, 0, 1, x, y), m)[4:] for x in (0.0, max(state.font.width(code), 1e-3)) for y in (-0.2, 0.8)]
        xs, ys = zip(*corners, strict=True)
        self.rows.append(
            {
                "kind": "glyph", "id": self.next_id, "page_index": self.index, "unicode": unicode or "�", "unmapped": unicode is None, "char_code": code, "font_name": state.font.name,
                "font_size": math.hypot(m[2], m[3]), "x": m[4], "y": m[5], "matrix": list(m), "x0": min(xs), "y0": min(ys), "x1": max(xs), "y1": max(ys), "dx": advance * text[0], "dy": advance * text[1],
                "fill_space": state.space, "fill": list(state.fill), "render_mode": state.mode, "invisible": state.mode in (3, 7), "source_kind": kind, "operator_index": at, "state": "pending",
            }
        )
        self.next_id += 1


def extract(data: bytes, max_pages: int | None = None) -> Iterator[dict]:
    """Rows of a file, a page after the other: page, glyph, path, image and diagnostic."""
    try:
        doc = Document(data)
        pages = doc.pages()
    except Exception as e:  # a file that can't be read is a row
        yield {"kind": "diagnostic", "message": f"{type(e).__name__}: {e}"}
        return
    first = 0
    for k, spec in enumerate(pages[:max_pages]):
        page = Page(doc, k, spec, first)
        try:
            page.run()
        except Exception as e:
            page.note(f"{type(e).__name__}: {e}")
        first = page.next_id
        yield from page.rows


def read_pdfs(spark: SparkSession, path: str, max_pages: int | None = None) -> DataFrame:
    """All rows of the PDF files below ``path``; filter on ``kind``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = []
                for r in extract(content.as_py(), max_pages):
                    rows.append(r | {"path": name})
                    if len(rows) >= BATCH:
                        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, GLYPH_DDL)


def hello(text: str = "Hello", lines: int = 1) -> bytes:
    """A small PDF with ``lines`` lines of ``text``, for tests and trials."""
    body = "BT /F1 24 Tf 72 720 Td 28 TL " + " ".join(f"({text}) Tj T*" for _ in range(lines)) + " ET"
    parts = ["<< /Type /Catalog /Pages 2 0 R >>", "<< /Type /Pages /Kids [3 0 R] /Count 1 >>", "<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", f"<< /Length {len(body)} >>\nstream\n{body}\nendstream", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"]
    return ("%PDF-1.4\n" + "".join(f"{k} 0 obj\n{p}\nendobj\n" for k, p in enumerate(parts, 1)) + "trailer << /Root 1 0 R >>\n%%EOF\n").encode("latin-1")
