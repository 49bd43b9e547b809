"""Secret scans with structural confirmation.

Three base patterns report what they match: assignments, access key ids and long hex runs. Longer
base64, base64url and hex runs are only candidates: they are decoded, and reported if what comes out parses
as a private key (DER with all nested lengths closed, OpenSSH's container with all its
fields) or as a signed token (a JSON header with an algorithm, a JSON payload, a signature). A key may begin at any
place of a run (every place where its first bytes can stand is tried), ends where its own lengths say, and may be
wrapped over lines. PEM blocks, with plain or escaped line ends, are confirmed by the same parsers, also where
the whole block is in base64 or hex once more (one such layer).

Scale: one narrow scan, no shuffle; runs are found on byte arrays, and Python looks at candidates alone. Whole texts are
scanned in slices of bounded bytes (one text at least). Spans are in code points, end exclusive.

Nulls and repeats: a null text is empty and has no spans; a null doc_id is carried; each row has one
row in the result, repeated or not; an empty table gives no rows. Very long texts are scanned whole, in time that follows their length.
Extra columns are ignored (redact keeps them, and sets an integer n_chars to the new length).
"""

from __future__ import annotations

import base64
import binascii
import codecs
import json
import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructField, StructType

from weft.llm._shared import LOWER, chunks, only, small_batches, text_buffer, word_spans

#: Kinds in the order that breaks ties of the start; the first three are the base.
KINDS = ("assign", "access", "hex", "jwt", "key", "openssh", "pem")
BASE = KINDS[:3]
MARK = "[SECRET]"
_SPANS = "array<struct<kind: string, start: long, end: long>>"

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----((?:[^-]|-(?!----))*)-----END \1PRIVATE KEY-----")
_SEALED = re.compile(r"Proc-Type:\s*4,ENCRYPTED.*?DEK-Info:\s*[A-Z0-9-]+,[0-9A-Fa-f]{16,}", re.DOTALL)
_ENDS = re.compile(r"\s|\\+(?:[nrt]|u000[ad]|x0[ad]|(?=\s))|%0[ad]|&#(?:10|13|x[ad]);", re.IGNORECASE)
_NEXT = re.compile(r"[\x20\t]*(?:\r?\n|(?:\\+r)?\\+n)[\x20\t]*([A-Za-z0-9+/_=.-]+)")
_PART, _TOKEN = re.compile(r"[A-Za-z0-9_=-]+"), re.compile(r"[A-Za-z0-9_=-]+\.[A-Za-z0-9_=-]+\.[A-Za-z0-9_-]*")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def _table(pattern: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(pattern)] = True
    return out


_DIGITS, _UPPER, _LOWER = b"0123456789", bytes(range(65, 91)), bytes(range(97, 123))
_HEX = _table(_DIGITS + b"abcdef")
_RUN = _table(_DIGITS + _UPPER + _LOWER + b"+/_=.-")
_LONG = 40


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of DER elements that fill data to the last byte; None if a length does not fit."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data):
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        out.append((tag, data[at : at + size]))
        at += size
    return out


def is_der_key(data: bytes) -> bool:
    """A private key as PKCS#1, PKCS#8 (plain or encrypted) or SEC 1."""
    top = der_items(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = der_items(top[0][1])
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if len(tags) in (6, 9, 10) and set(tags[:9]) == {0x02} and inner[0][1] in (b"\0", b"\1"):
        return all(body for _, body in inner) and sum(len(b) for _, b in inner) >= 40
    if tags[:3] == [0x02, 0x30, 0x04] and inner[0][1] in (b"\0", b"\1"):
        named = der_items(inner[1][1])
        return bool(named) and named[0][0] == 0x06 and bool(der_items(inner[2][1]))
    if tags[:2] == [0x02, 0x04] and inner[0][1] == b"\1" and 16 <= len(inner[1][1]) <= 66:
        return all(t in (0xA0, 0xA1) and der_items(body) for t, body in inner[2:])
    if tags == [0x30, 0x04] and len(inner[1][1]) >= 32:
        named = der_items(inner[0][1])
        return bool(named) and len(named) == 2 and named[0][0] == 0x06 and named[0][1].startswith(b"\x2a\x86\x48\x86\xf7\x0d\x01")
    return False


def is_openssh_key(data: bytes) -> bool:
    """OpenSSH's private container: its magic, three named fields, the number of keys, and so many fields to the end."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, fields, n = len(magic), 0, None
    while at < len(data):
        if at + 4 > len(data):
            return False
        (size,) = struct.unpack_from(">I", data, at)
        at += 4
        if fields == 3 and n is None:
            n = size
            continue
        if at + size > len(data):
            return False
        at, fields = at + size, fields + 1
    return n is not None and n >= 1 and fields == 3 + n + 1


def _decoded(text: str) -> bytes | None:
    """base64 in either alphabet, with or without its padding."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _object(text: str) -> dict | None:
    """The JSON object that base64 text holds."""
    try:
        got = json.loads(_decoded(text) or b"")
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def _can_begin(run: str, at: int, end: int) -> bool:
    """False if some first characters of run[at:end] already show that it is no base64 of JSON; so most places are left after a few of them."""
    n = 64
    while at + n < end:
        try:
            said = codecs.getincrementaldecoder("utf-8")().decode(_decoded(run[at : at + n]) or b"")
            json.loads(said)
            return False  # it ends before the text does
        except json.JSONDecodeError as e:
            if e.pos < len(said) - 12 and not e.msg.startswith("Unterminated string"):
                return False
        except (UnicodeDecodeError, RecursionError):
            return False
        n *= 2
    return True


def _rest(payload: str, signature: str) -> int:
    """What follows a header: 0 if it belongs to no token, 1 if to one without a signature, 2 if to any."""
    if _object(payload) is None:
        return 0
    return 2 if len(_decoded(signature) or b"") >= 16 else 1


def _header(run: str, at: int, end: int, rest: int) -> bool:
    """Whether run[at:end] is a token's header, JSON with an algorithm, that fits what follows."""
    if not rest or not _can_begin(run, at, end):
        return False
    alg = (_object(run[at:end]) or {}).get("alg")
    return isinstance(alg, str) and (rest == 2 or alg.lower() == "none")


def is_token(text: str) -> bool:
    """header.payload.signature, the header JSON with an algorithm, the payload JSON."""
    parts = text.split(".")
    return len(parts) == 3 and all(parts[:2]) and _header(text, 0, len(parts[0]), _rest(*parts[1:]))


def _tokens(run: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed tokens within one run of base64 and dot characters. What follows a first part is read once for all places where a token can begin in it."""
    at, dot, rest, end = run.find("eyJ"), -1, 0, 0
    while at >= 0:
        if at >= dot:
            token = _TOKEN.match(run, at)
            dot, end = _PART.match(run, at).end(), token.end() if token else 0
            rest = _rest(*token[0].split(".")[1:]) if token else 0
        if _header(run, at, dot, rest):
            yield "jwt", at, end
            at, dot = run.find("eyJ", end), -1
        else:
            # Without the other parts no place in this first part can begin a token, so a long run is passed once.
            at = run.find("eyJ", at + 3 if rest else dot)


def _reader(text: str, start: int, hexed: bool) -> Callable[[int, int], bytes]:
    """get(at, n): n bytes (fewer at the end) from byte `at` of what text decodes to from `start` on; only their own characters are decoded."""

    def get(at: int, n: int) -> bytes:
        if hexed:
            own = text[start + 2 * at : start + 2 * (at + n)]
            return bytes.fromhex(own[: len(own) & ~1])
        low = at // 3
        own = text[start + 4 * low : start + -(-(at + n) // 3) * 4]
        return (_decoded(own[:-1] if len(own) % 4 == 1 else own) or b"")[at - 3 * low : at - 3 * low + n]

    return get


def _element(get: Callable[[int, int], bytes], at: int) -> tuple[int, int, int] | None:
    """Tag, first content byte and end of the DER element at a byte."""
    head = get(at, 6)
    if len(head) < 2:
        return None
    size, n = head[1], 0
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or len(head) < 2 + n:
            return None
        size = int.from_bytes(head[2 : 2 + n], "big")
    return head[0], at + 2 + n, at + 2 + n + size


def _key_size(get: Callable[[int, int], bytes], most: int) -> int | None:
    """Bytes of the DER key that can begin at byte 0, of at most `most`, by the lengths of its elements; is_der_key confirms it."""
    top = _element(get, 0)
    if not top or top[0] != 0x30 or top[2] > most:
        return None
    at, many = top[1], 0
    while at < top[2] and many < 10:
        one = _element(get, at)
        if not one or one[2] > top[2] or (not many and one[0] not in (0x02, 0x30)) or (not many and one[0] == 0x02 and get(at, 3) not in (b"\2\1\0", b"\2\1\1")):
            return None
        at, many = one[2], many + 1
    return at if at == top[2] and many else None


def _openssh_size(get: Callable[[int, int], bytes], most: int) -> int | None:
    """Bytes of the OpenSSH container that begins at byte 0; is_openssh_key confirms it."""
    at, left = 15, 3
    for count in (True, False):
        while left:
            size = get(at, 4)
            at += 4 + int.from_bytes(size, "big")
            if len(size) < 4 or at > most:
                return None
            left -= 1
        if count:
            left, at = int.from_bytes(get(at, 4), "big") + 1, at + 4
    return at


def _layers(marker: bytes) -> list[tuple[str, int]]:
    """What marker looks like in base64 at each of three offsets, and how many characters before it its group begins."""
    out = []
    for shift in range(3):
        lead = -(-shift * 8 // 6)
        out.append((base64.b64encode(b"\0" * shift + marker)[lead : (shift + len(marker)) * 8 // 6].decode(), lead))
    return out


_BEGIN = b"-----BEGIN "
_IN_BASE64, _IN_HEX = _layers(_BEGIN), re.compile(_BEGIN.hex(), re.IGNORECASE)
_STARTS = re.compile("M(?=[A-P])|b3BlbnNzaC1rZXktdjEA")
_HEX_STARTS = re.compile("3(?=0(?:8[1-4]|[0-7]))|(?:6f70656e7373682d6b65792d763100)", re.IGNORECASE)


def _keys(run: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed private keys within one run, in base64 or hex, bare or as PEM text; each begins at any place and ends by its own lengths."""
    for part in re.finditer(r"[A-Za-z0-9+/_-]{40,}={0,2}", run):
        text = part[0].rstrip("=").replace("-", "+").replace("_", "/")
        for hexed, low, high in [(False, 0, len(text))] + [(True, *m.span()) for m in re.finditer("[0-9A-Fa-f]{40,}", text)]:
            own, done = text[low:high], 0
            # PEM text: what was decoded once from one offset shows all blocks behind it.
            marks = [(m.start(), 0) for m in _IN_HEX.finditer(own)] if hexed else [(m.start() - lead, lead) for mark, lead in _IN_BASE64 for m in re.finditer(re.escape(mark), own)]
            group, found = 2 if hexed else 4, []
            for at in {at % group: at for at, _ in sorted(marks, reverse=True) if at >= 0}.values():
                for a, b in _pems(_reader(own, at, hexed)(0, len(own)).decode("latin-1")):
                    found.append(("pem", at + (2 * a if hexed else a * 8 // 6), at + (2 * b if hexed else -(-b * 8 // 6))))
            for m in (_HEX_STARTS if hexed else _STARTS).finditer(own):
                at = m.start()
                if at < done:
                    continue
                get = _reader(own, at, hexed)
                most = (len(own) - at) // 2 if hexed else (len(own) - at) * 6 // 8
                ssh = m[0][0] not in "M3"
                size = (_openssh_size if ssh else _key_size)(get, most)
                if size and (is_openssh_key if ssh else is_der_key)(get(0, size)):
                    done = at + (2 * size if hexed else -(-size * 8 // 6))
                    found.append(("openssh" if ssh and not hexed else "key", at, done))
            for kind, a, b in found:
                # The padding belongs to a span that reaches it.
                yield kind, part.start() + low + a, part.end() if low + b == len(text) else part.start() + low + b


def _pems(text: str) -> Iterator[tuple[int, int]]:
    """Confirmed PEM blocks, their line ends plain or escaped. Of one that is sealed by a password only the headers and whole cipher blocks can be confirmed."""
    for m in _PEM.finditer(text):
        sealed = _SEALED.search(m[2])
        data = _decoded(_ENDS.sub("", m[2][sealed.end() if sealed else 0 :]).replace("\\/", "/"))
        if data and (len(data) >= 32 and len(data) % 8 == 0 if sealed else is_der_key(data) or is_openssh_key(data)):
            yield m.span()


def _joined(text: str, a: int, b: int) -> tuple[str, list[int] | None, int]:
    """A run with those that follow it line by line, the place of each of its characters (None: from a on), and its end."""
    lines = [(a, b)]
    while m := _NEXT.match(text, lines[-1][1]):
        lines.append(m.span(1))
    if len(lines) == 1:
        return text[a:b], None, b
    return "".join(text[x:y] for x, y in lines), [k for x, y in lines for k in range(x, y)], lines[-1][1]


def find_secrets(text: str, hexes: list[tuple[int, int]] | None = None, runs: list[tuple[int, int]] | None = None) -> list[tuple[str, int, int]]:
    """All spans of one text, sorted; hexes and runs in code points, found here where not given."""
    found = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    hexes = [m.span() for m in re.finditer("[0-9a-f]{32,}", text)] if hexes is None else hexes
    runs = [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=.-]{%d,}" % _LONG, text)] if runs is None else runs
    found += [("hex", a, b) for a, b in hexes]
    pems = list(_pems(text))
    found += [("pem", a, b) for a, b in pems]
    done = 0
    for a, b in runs:
        found += [(kind, a + x, a + y) for kind, x, y in _tokens(text[a:b])]
        if a < done:
            continue
        own, places, done = (text[a:b], None, b) if any(x <= a < y for x, y in pems) else _joined(text, a, b)
        found += [(kind, a + x, a + y) if places is None else (kind, places[x], places[y - 1] + 1) for kind, x, y in _keys(own)]
    return sorted(set(found), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _scan(raw: np.ndarray, offs: np.ndarray) -> list[list[tuple[str, int, int]]]:
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(offs) - 1)]
    data, low = raw.tobytes(), LOWER[raw].tobytes()
    spans = {}
    for name, table, least in (("hex", _HEX, 32), ("run", _RUN, _LONG)):
        s, e, r = word_spans(raw, offs, table)
        keep = e - s >= least
        spans[name] = (s[keep], e[keep], r[keep])
    look = set(spans["hex"][2].tolist()) | set(spans["run"][2].tolist())
    for name, where in [(n, low) for n in _NAMES] + [(b"AKIA", data), (b"PRIVATE KEY-----", data)]:
        at = where.find(name)
        while at >= 0:
            i = int(np.searchsorted(offs, at, "right")) - 1
            look.add(i)
            at = where.find(name, int(offs[i + 1]))
    # Bytes that begin no code point: few, so places in code points take little memory.
    inner = np.flatnonzero((raw & 0xC0) == 0x80) if look else np.zeros(0, np.int64)
    for i in look:
        text = data[offs[i] : offs[i + 1]].decode("utf-8", "replace")
        own = {}
        for name, (s, e, r) in spans.items():
            a, b = np.searchsorted(r, [i, i + 1])
            first = np.searchsorted(inner, offs[i])
            s, e = (at - offs[i] - (np.searchsorted(inner, at) - first) for at in (s[a:b], e[a:b]))
            own[name] = list(zip(s.tolist(), e.tolist(), strict=True))
        out[i] = find_secrets(text, own["hex"], own["run"])
    return out


_KIND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _spans(batch: pa.RecordBatch) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in own] for own in _scan(*text_buffer(batch.column("text")))], _KIND)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id and spans, one row per row of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _spans(batch)], names=["doc_id", "spans"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return small_batches(docs).mapInArrow(run, f"doc_id long, spans {_SPANS}")


def redact(documents: DataFrame, mark: str = MARK) -> DataFrame:
    """documents with all secrets replaced by the mark, spans that touch or overlap by one; n_chars follows where a text changed."""
    sized = any(f.name == "n_chars" and isinstance(f.dataType, IntegralType) for f in documents.schema.fields)
    schema = StructType([StructField(f.name, f.dataType) for f in documents.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            own = _scan(*text_buffer(batch.column("text")))
            if any(own):
                texts = batch.column("text").to_pylist()
                sizes = batch.column("n_chars").to_pylist() if sized else []
                for i, spans in enumerate(own):
                    if spans:
                        parts, at, text = [], 0, texts[i]
                        for _, a, b in spans:
                            if a > at or not parts:
                                parts += [text[at:a], mark]
                            at = max(at, b)
                        texts[i] = "".join(parts) + text[at:]
                        if sized:
                            sizes[i] = len(texts[i])
                columns = {"text": pa.array(texts, pa.string())} | ({"n_chars": pa.array(sizes, batch.schema.field("n_chars").type)} if sized else {})
                batch = pa.RecordBatch.from_arrays([columns.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)
            yield batch

    return small_batches(documents).mapInArrow(run, schema)


def _equal(kind: str):
    return lambda x: x == kind


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(only(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
    said = lambda of: F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    many = [F.size(F.filter(F.col("spans.kind"), _equal(k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *many, F.sha2(said(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
