"""Header parsers of the two container formats: strict, bounds-checked, no payload read."""

from __future__ import annotations

import json
import math
import struct
from dataclasses import dataclass, field
from typing import Any

from weft.functions.codecs import BLOCKS

MAX_HEADER, U64 = 100_000_000, 2**64 - 1


class FormatError(ValueError):
    """A file that breaks its format's rules. The sentences below that name a rule are fixed values: reports quote them."""


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise FormatError(message)


def quoted(text: str) -> str:
    """A name in double quotes, with control characters escaped."""
    plain = {"\n": "\\n", "\r": "\\r", "\t": "\\t", "\0": "\\0", '"': '\\"', "\\": "\\\\", "'": "'"}
    return '"' + "".join(plain.get(c, c if c.isprintable() else f"\\u{{{ord(c):x}}}") for c in text) + '"'


@dataclass
class Tensor:
    name: str
    type_name: str
    shape: list[int]
    data_offset: int
    file_offset: int
    byte_len: int
    elements: int
    dims: list[int] | None = None

    @property
    def dtype(self) -> str | None:
        return self.type_name if self.type_name in BLOCKS else None


@dataclass
class Header:
    format: str
    data_start: int
    tensors: list[Tensor]
    metadata: list[tuple[str, str, Any]] = field(default_factory=list)
    header_len: int | None = None
    version: int | None = None
    alignment: int | None = None


def _product(shape: list[int], message: str) -> int:
    n = 0 if 0 in shape else math.prod(shape)
    _need(n <= U64, message)
    return n


# --- safetensors

#: Bytes per element of the format's byte-sized types.
WIDTHS = {"BOOL": 1, "U8": 1, "I8": 1, "F8_E4M3": 1, "F8_E5M2": 1, "U16": 2, "I16": 2, "F16": 2, "BF16": 2, "U32": 4, "I32": 4, "F32": 4, "U64": 8, "I64": 8, "F64": 8}


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) != len(pairs):
        seen: set[str] = set()
        for key, _ in pairs:
            _need(key not in seen, f"duplicate key {quoted(key)}")
            seen.add(key)
    return out


def _constant(name: str) -> Any:
    raise ValueError(f"{name} is no JSON number")


def _whole(x: Any) -> bool:
    return type(x) is int and 0 <= x <= U64


def parse_safetensors(head: bytes, size: int) -> Header:
    """head: the first bytes, up to the end of the JSON at least; size: of the file."""
    _need(len(head) >= 8, "file is shorter than the 8-byte length prefix")
    (n,) = struct.unpack_from("<Q", head)
    _need(n <= MAX_HEADER, "header exceeds the 100 MB safety limit")
    _need(len(head) >= 8 + n and size >= 8 + n, "truncated JSON header")
    body = head[8 : 8 + n]
    _need(body[:1] == b"{", "header must begin with '{'")
    try:
        entries = json.loads(body.decode("utf-8"), object_pairs_hook=_unique, parse_constant=_constant)
    except FormatError as e:
        raise FormatError(f"invalid header JSON or tensor fields: {e}") from None
    except (ValueError, RecursionError) as e:
        raise FormatError(f"invalid header JSON or tensor fields: {e}") from None
    metadata, tensors, room, total = [], [], size - 8 - n, 0
    for name in sorted(entries, key=lambda s: s.encode("utf-8", "surrogatepass")):
        entry = entries[name]
        _need(isinstance(entry, dict), "invalid header JSON or tensor fields: an entry must be an object")
        text = all(isinstance(v, str) for v in entry.values())
        if name == "__metadata__":
            _need(text, "__metadata__ must be a string-to-string object")
            metadata = [(k, "string", entry[k]) for k in sorted(entry)]
            continue
        said = f"tensor {quoted(name)}"
        if set(entry) != {"dtype", "shape", "data_offsets"}:
            _need(not text, f"{said}: missing dtype, shape, or data_offsets")
            raise FormatError("invalid header JSON or tensor fields: dtype, shape and data_offsets are the fields of a tensor")
        dtype, shape, offsets = entry["dtype"], entry["shape"], entry["data_offsets"]
        fine = isinstance(dtype, str) and isinstance(shape, list) and all(map(_whole, shape)) and isinstance(offsets, list) and len(offsets) == 2 and all(map(_whole, offsets))
        _need(fine, "invalid header JSON or tensor fields: wrong type of a field")
        _need(dtype in WIDTHS, f"{said}: unsupported dtype {quoted(dtype)}")
        elements = _product(shape, f"{said}: shape product overflow")
        wanted, (begin, end) = elements * WIDTHS[dtype], offsets
        _need(wanted <= U64, f"{said}: byte size overflow")
        _need(begin <= end, f"{said}: reversed offsets")
        _need(end - begin == wanted, f"{said}: shape/dtype require {wanted} bytes, offsets describe {end - begin}")
        _need(end <= room, f"{said}: data extends beyond end of file")
        total += elements
        _need(total <= U64, "total element count overflow")
        tensors.append(Tensor(name, dtype, shape, begin, 8 + n + begin, end - begin, elements))
    at = 0
    for t in sorted(tensors, key=lambda t: (t.data_offset, t.byte_len)):
        _need(t.data_offset == at, f"tensor {quoted(t.name)}: gap or overlap at data offset {t.data_offset} (expected {at})")
        at += t.byte_len
    _need(at == room, f"unclaimed trailing tensor data: {room - at} bytes")
    return Header("safetensors", 8 + n, tensors, metadata, header_len=n)


# --- GGUF

#: Id, name, elements and bytes of a block.
GGML_TYPES = {
    0: ("F32", 1, 4), 1: ("F16", 1, 2), 2: ("Q4_0", 32, 18), 3: ("Q4_1", 32, 20), 6: ("Q5_0", 32, 22), 7: ("Q5_1", 32, 24), 8: ("Q8_0", 32, 34), 9: ("Q8_1", 32, 36),
    10: ("Q2_K", 256, 84), 11: ("Q3_K", 256, 110), 12: ("Q4_K", 256, 144), 13: ("Q5_K", 256, 176), 14: ("Q6_K", 256, 210), 15: ("Q8_K", 256, 292),
    16: ("IQ2_XXS", 256, 66), 17: ("IQ2_XS", 256, 74), 18: ("IQ3_XXS", 256, 98), 19: ("IQ1_S", 256, 50), 20: ("IQ4_NL", 32, 18), 21: ("IQ3_S", 256, 110), 22: ("IQ2_S", 256, 82), 23: ("IQ4_XS", 256, 136),
    24: ("I8", 1, 1), 25: ("I16", 1, 2), 26: ("I32", 1, 4), 27: ("I64", 1, 8), 28: ("F64", 1, 8), 29: ("IQ1_M", 256, 56), 30: ("BF16", 1, 2), 34: ("TQ1_0", 256, 54), 35: ("TQ2_0", 256, 66), 39: ("MXFP4", 32, 17),
}
#: Ids that the format dropped.
REMOVED = {4: "Q4_2", 5: "Q4_3", 31: "Q4_0_4_4", 32: "Q4_0_4_8", 33: "Q4_0_8_8", 36: "IQ4_NL_4_4", 37: "IQ4_NL_4_8", 38: "IQ4_NL_8_8"}
#: Metadata value types by id, with struct codes; 8 is a string, 9 an array.
VALUE_TYPES = {0: ("u8", "B"), 1: ("i8", "b"), 2: ("u16", "H"), 3: ("i16", "h"), 4: ("u32", "I"), 5: ("i32", "i"), 6: ("f32", "f"), 7: ("bool", "B"), 8: ("string", ""), 9: ("array", ""), 10: ("u64", "Q"), 11: ("i64", "q"), 12: ("f64", "d")}
ALIGNMENT, MAX_DIMS, MAX_DEPTH, PREVIEW = 32, 4, 8, 8


class Truncated(FormatError):
    """The given bytes end before the header does."""


class _Cursor:
    def __init__(self, data: bytes, size: int):
        self.data, self.size, self.at = data, size, 0

    def take(self, n: int, what: str) -> bytes:
        if self.at + n > self.size:
            raise FormatError(f"truncated: {what} needs {n} bytes at {self.at}, the file has {self.size - self.at} left")
        if self.at + n > len(self.data):
            raise Truncated(what)
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, code: str, what: str) -> Any:
        return struct.unpack(f"<{code}", self.take(struct.calcsize(f"<{code}"), what))[0]

    def text(self, what: str) -> str:
        raw = self.take(self.number("Q", f"{what} length"), what)
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            raise FormatError(f"{what} is not valid UTF-8") from None

    def fits(self, count: int, least: int, what: str) -> None:
        rest = self.size - self.at
        _need(count <= rest // least, f"{what} count {count} cannot fit in the remaining {rest} bytes")

    def value(self, kind: int, depth: int = 0) -> Any:
        """Scalars as they are; arrays as (element type name, length, first items)."""
        _need(kind in VALUE_TYPES, f"unknown metadata value type {kind}")
        name, code = VALUE_TYPES[kind]
        if kind == 8:
            return self.text("string value")
        if kind != 9:
            got = self.number(code, name)
            _need(kind != 7 or got in (0, 1), f"bool must be 0 or 1, found {got}")
            return bool(got) if kind == 7 else got
        _need(depth < MAX_DEPTH, f"arrays nested more than {MAX_DEPTH} deep")
        inner, n = self.number("I", "array element type"), self.number("Q", "array length")
        _need(inner in VALUE_TYPES, f"unknown metadata value type {inner}")
        self.fits(n, {8: 8, 9: 12}.get(inner) or struct.calcsize(f"<{VALUE_TYPES[inner][1]}"), "array element")
        kept: list[Any] = []
        for k in range(n):
            try:
                item = self.value(inner, depth + 1)
            except Truncated:
                raise
            except FormatError as e:
                raise FormatError(f"array element {k}: {e}") from None
            if len(kept) < PREVIEW:
                kept.append((VALUE_TYPES[inner][0], item))
        return VALUE_TYPES[inner][0], n, kept


def parse_gguf(head: bytes, size: int) -> Header:
    """head: the first bytes of the file; Truncated asks for more of them."""
    c = _Cursor(head, size)
    _need(c.take(4, "magic") == b"GGUF", "not a GGUF file (bad magic)")
    version = c.number("I", "version")
    _need(version != 1, "GGUF v1 is not read: its counts have 32 bits; write the file anew as version 2 or 3")
    _need(int.from_bytes(version.to_bytes(4, "little"), "big") not in (1, 2, 3), "big-endian GGUF files are not supported")
    _need(version in (2, 3), f"unsupported GGUF version {version}")
    n_tensors, n_meta = c.number("Q", "tensor count"), c.number("Q", "metadata count")
    c.fits(n_meta, 13, "metadata")
    c.fits(n_tensors, 24, "tensor")
    metadata: dict[str, tuple[str, Any]] = {}
    for _ in range(n_meta):
        key, kind = c.text("metadata key"), c.number("I", "metadata value type")
        try:
            value = c.value(kind)
        except Truncated:
            raise
        except FormatError as e:
            raise FormatError(f"metadata key {quoted(key)}: {e}") from None
        _need(key not in metadata, f"duplicate metadata key {quoted(key)}")
        metadata[key] = (VALUE_TYPES[kind][0], value)
    kind, align = metadata.get("general.alignment", ("u32", ALIGNMENT))
    _need(kind == "u32", f"general.alignment must be a u32, found {kind}")
    _need(align > 0 and align & (align - 1) == 0, f"general.alignment must be a nonzero power of two, found {align}")
    infos, names = [], set()
    for _ in range(n_tensors):
        name = c.text("tensor name")
        said = f"tensor {quoted(name)}"
        _need(name not in names, f"duplicate tensor name {quoted(name)}")
        names.add(name)
        n_dims = c.number("I", "dimension count")
        _need(n_dims <= MAX_DIMS, f"{said}: {n_dims} dimensions; ggml supports at most {MAX_DIMS}")
        dims = [c.number("Q", "tensor dimension") for _ in range(n_dims)]
        kind = c.number("I", "tensor type")
        _need(kind not in REMOVED, f"{said}: ggml type {kind} ({REMOVED.get(kind)}) was removed from GGUF; write the tensor in a type that is still there")
        _need(kind in GGML_TYPES, f"{said}: unknown ggml type id {kind} (block size unknown)")
        infos.append((name, said, dims, GGML_TYPES[kind], c.number("Q", "tensor offset")))
    up = lambda x: -(-x // align) * align
    start, expected, tensors = up(c.at), 0, []
    for name, said, dims, (type_name, per, width), offset in infos:
        elements = _product(dims, f"{said}: element count overflow")
        row = dims[0] if dims else 1
        _need(row % per == 0, f"{said}: innermost dimension {row} is not a multiple of the {type_name} block size {per}")
        n = elements // per * width
        _need(n <= U64, f"{said}: byte size overflow")
        _need(offset == expected, f"{said}: data offset {offset}, expected {expected} (tensors follow header order, each padded to {align} bytes)")
        expected = up(offset + n)
        _need(expected <= U64, f"{said}: data offset overflow")
        _need(start + offset + n <= size, f"{said}: data extends beyond end of file")
        tensors.append(Tensor(name, type_name, dims[::-1], offset, start + offset, n, elements, dims))
    return Header("GGUF", start, tensors, [(k, t, v) for k, (t, v) in metadata.items()], version=version, alignment=align)


def parse(head: bytes, size: int) -> Header:
    return parse_gguf(head, size) if head[:4] == b"GGUF" else parse_safetensors(head, size)
