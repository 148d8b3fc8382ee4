"""Operator 3: secret scan by a recursive decoding worklist.

Every text is scanned for three kinds of secret.  Encoded runs inside it are
decoded into layers, each layer is scanned in the same way and searched for further
encoded runs, until no new layer appears:

* URL escapes, character by character (bytes that are no UTF-8 as Latin-1);
* Unicode escapes: ``\\uXXXX``, ``\\u{X}``, ``\\UXXXXXXXX``, ``\\xXX``, ``%uXXXX``,
  ``&#xX;``, ``&#9;``;
* base64 in both alphabets, also broken over lines, at all four alignments of a run
  and in its parts of one alphabet, so that what stands before the encoded text
  (``path/``, ``a-``) hides nothing;
* gzip, zlib, bzip2 and xz data anywhere in a layer whose characters stand for
  bytes, members in a row as one; of a broken stream what it gives up to the break;
* NULs are taken out, and bytes with NULs are read as UTF-16 and UTF-32 too.

A layer whose content was seen before at the same place is not expanded again,
which ends cycles.  Bytes are read as UTF-8, else as Latin-1, so that every layer is
scanned whole; ``n_layers`` counts those of printable text.  A secret found in
a layer is reported at the span of the original text that the layer came from:
character by character for escapes, the whole encoded run for base64.

Spans are code-point offsets of whole matches, end exclusive.

Defined results: a null text is empty and has no spans; repeated rows give
repeated results; an empty table gives no rows; further columns are ignored; a
null ``doc_id`` stays null; texts are scanned whole, however long; spans that start
together stand by end, then kind, and equal spans of several layers count once.  A
compressed layer that unpacks to more than ``max_layer_bytes`` (64 MiB; a larger
number lifts it) is not expanded and counted in ``n_refused``: a guard against
decompression bombs, as the document's own text is always scanned whole.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ledgerfold.llm.common import python_ready, table, text_of, worker_task

KINDS = ("assign", "access", "hex")

#: The patterns and shortest lengths of the three kinds.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32
# A run of 32 or more is the whole maximal run, so this finds the same spans faster.
LONG_HEX = re.compile(r"[0-9a-f]{32,}")

URL_ONE = re.compile(r"%[0-9A-Fa-f]{2}")
URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
UNICODE_ONE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|%u([0-9A-Fa-f]{4})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
UNICODE_RUN = re.compile("(?:" + re.sub(r"\((?!\?)", "(?:", UNICODE_ONE.pattern) + ")+")
# A run may go on over line ends while whole lines are of the alphabet.
BASE64_RUN = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+(?==|[ \t]*(?:\r?\n|\Z)))*={0,2}")
LEAST_BASE64 = 16

#: How compressed data begin, as Latin-1, with their decompressors.
PACKED = re.compile("(\x1f\x8b\x08)|(x[\x01^\x9c\xda])|(BZh[1-9]1AY&SY)|(\xfd7zXZ\0)")
UNPACKERS = (lambda: zlib.decompressobj(31), lambda: zlib.decompressobj(15), bz2.BZ2Decompressor, lzma.LZMADecompressor)
PACKED_MARKS = ("\x1f\x8b\x08", "x\x01", "x^", "x\x9c", "x\xda", "BZh", "\xfd7zXZ")
FED = 1 << 16

#: What a text needs to hold for any of the exact patterns to matter; one pass of
#: a linear-time matcher over the Arrow batch.
ANY = (
    r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=]|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""
    r"""|%[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}|\\[uU][0-9A-Fa-f{]|\\x[0-9A-Fa-f]{2}|&#[0-9xX]|[A-Za-z0-9+/_-]{16}"""
    r"""|\x{00}|\x{1f}\x{8b}|x[\x{01}^\x{9c}\x{da}]|BZh|\x{fd}7zXZ"""
)

MAX_LAYER_BYTES = 64 << 20


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of every secret in one layer."""
    found = []
    for m in ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= MIN_ASSIGN:
            found.append((m.start(), 0, m.end()))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= MIN_ACCESS:
            found.append((m.start(), 1, m.end()))
    for m in LONG_HEX.finditer(text):
        found.append((m.start(), 2, m.end()))
    return found


class Refused(Exception):
    """A compressed layer is larger than allowed."""


def _inflate(kind: int, raw: memoryview, limit: int) -> tuple[bytes, int] | None:
    """What the compressed data at the start of ``raw`` hold, members in a row as
    one, and how many bytes they take; none if they are no such data at all."""
    unpack, out, size, at, used = UNPACKERS[kind](), [], 0, 0, 0
    try:
        while at < len(raw):
            fed = bytes(raw[at : at + FED])
            at += len(fed)
            new = unpack.decompress(fed, limit + 1 - size)
            out.append(new)
            size += len(new)
            if size > limit:
                raise Refused
            if unpack.eof:
                used = at = at - len(unpack.unused_data)
                if not PACKED.match(bytes(raw[at : at + 16]).decode("latin-1")):
                    break
                unpack = UNPACKERS[kind]()
            else:
                used = at
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        pass  # broken from here on
    return (b"".join(out), used) if size else None


def printable(text: str) -> bool:
    return text.translate({9: None, 10: None, 13: None}).isprintable()


def _texts(raw: bytes) -> list[tuple[str, bool]]:
    """Every reading of the bytes that can hold a secret (all of ASCII), and whether
    it is a printable text."""
    try:
        text = raw.decode("utf-8")
        out = [(text, printable(text))]
        if len(text) < len(raw) and PACKED.search(as_bytes := raw.decode("latin-1")):
            out.append((as_bytes, False))
    except UnicodeDecodeError:
        out = [(raw.decode("latin-1"), False)]
    if b"\0" in raw:
        wide = ["utf-16-le", "utf-16-be"] + ["utf-32-le", "utf-32-be"] * (b"\0\0\0" in raw)
        out += [(raw.decode(code, "replace"), False) for code in wide]
    return out


_STANDARD = str.maketrans("-_", "+/", "= \t\r\n")


def _base64(run: str) -> bytes:
    """The bytes of a run; a last character that belongs to no byte is left out."""
    body = run.translate(_STANDARD)
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body + "=" * (-len(body) % 4))


def base64_spans(text: str) -> list[tuple[int, int]]:
    """The spans to decode: every run at its four alignments, and its parts of one
    alphabet."""
    out = []
    for m in BASE64_RUN.finditer(text):
        a, b = m.span()
        out += [(a + k, b) for k in range(4) if b - a - k >= LEAST_BASE64]
        parts = [part for cut in ("[+/]", "[-_]") for part in re.finditer(rf"(?:(?!{cut})[^=])+={{0,2}}", m[0])]
        out += [(a + x.start(), a + x.end()) for x in parts if LEAST_BASE64 <= x.end() - x.start() < b - a]
    return list(dict.fromkeys(out))


class Layer:
    """A text and, for each of its pieces, where it lies in the document.

    ``starts`` are the pieces' first offsets in this layer; ``spans`` holds for
    each piece (document start, document end, step): step 1 maps the piece code
    point by code point, 0 maps every code point to the whole document span.
    """

    __slots__ = ("text", "starts", "spans", "readable")

    def __init__(self, text, starts, spans, readable=True):
        self.text, self.starts, self.spans, self.readable = text, starts, spans, readable

    def origin(self, start: int, end: int) -> tuple[int, int]:
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, max(start, end - 1)) - 1
        a, _, step = self.spans[i]
        first = a + (start - self.starts[i]) if step else a
        a, b, step = self.spans[j]
        return first, a + (end - self.starts[j]) if step else b


def _rewritten(layer: Layer, edits: list[tuple[int, int, str]]) -> Layer:
    """The layer with (start, end, replacement) applied, in order."""
    out, starts, spans, at, size = [], [], [], 0, 0

    def keep(a: int, b: int):
        """Copy [a, b) piece by piece, so that each keeps its own origin."""
        nonlocal size
        i = bisect_right(layer.starts, a) - 1
        while a < b:
            stop = layer.starts[i + 1] if i + 1 < len(layer.starts) else b
            stop = min(stop, b)
            d, e, step = layer.spans[i]
            starts.append(size)
            spans.append((d + (a - layer.starts[i]), e, 1) if step else (d, e, 0))
            out.append(layer.text[a:stop])
            size += stop - a
            a, i = stop, i + 1

    for start, end, new in edits:
        keep(at, start)
        if new:
            starts.append(size)
            spans.append((*layer.origin(start, end), 0))
            out.append(new)
            size += len(new)
        at = end
    keep(at, len(layer.text))
    return Layer("".join(out), starts or [0], spans or [(0, 0, 0)])


def _url(run: str) -> tuple[list[tuple[int, int, str]], bool]:
    """One edit for each character, bytes that are no UTF-8 as Latin-1, and whether
    the run is a readable text."""
    raw, edits, at = bytes.fromhex(run.replace("%", "")), [], 0
    for c in raw.decode("utf-8", "surrogateescape"):
        size = len(c.encode("utf-8", "surrogateescape"))
        edits.append((3 * at, 3 * (at + size), chr(ord(c) - 0xDC00) if 0xDC80 <= ord(c) < 0xDD00 else c))
        at += size
    try:
        return edits, printable(raw.decode("utf-8"))
    except UnicodeDecodeError:
        return edits, False


def _escapes(run: str) -> list[tuple[int, int, str]]:
    """One edit for each character, so that every one keeps its own span."""
    edits, high = [], None
    for m in UNICODE_ONE.finditer(run):
        code = int(m[7]) if m[7] else int(next(x for x in m.groups() if x), 16)
        if high and 0xDC00 <= code < 0xE000:
            edits[-1] = (high[0], m.end(), chr(0x10000 + ((high[1] - 0xD800) << 10) + code - 0xDC00))
            high = None
            continue
        high = (m.start(), code) if 0xD800 <= code < 0xDC00 else None
        if code < 0x110000:
            edits.append((m.start(), m.end(), "�" if 0xD800 <= code < 0xE000 else chr(code)))
    return edits


def expand(layer: Layer, limit: int) -> tuple[list[Layer], int]:
    """The layers that one decoding step makes, and how many were refused."""
    made, refused, text = [], 0, layer.text
    if "%" in text:
        edits, readable, wide = [], False, False
        for m in URL_RUN.finditer(text):
            new, plain = _url(m[0])
            edits += [(m.start() + a, m.start() + b, c) for a, b, c in new]
            readable |= plain
            wide |= any(b - a > 3 for a, b, _ in new)
        if edits:
            made.append(_rewritten(layer, edits))
            made[-1].readable = readable
            # The same with one character a byte, and with + for a blank, for compressed data.
            each = [(m.start(), m.end(), chr(int(m[0][1:], 16))) for m in URL_ONE.finditer(text)]
            blanks = [(m.start(), m.end(), " ") for m in re.finditer(r"\+", text)]
            for other in ([each] if wide else []) + ([sorted(each + blanks)] if blanks else []):
                variant = _rewritten(layer, other)
                if PACKED.search(variant.text):
                    variant.readable = False
                    made.append(variant)
    if "\\" in text or "&#" in text or "%u" in text:
        edits = []
        for m in UNICODE_RUN.finditer(text):
            edits += [(m.start() + a, m.start() + b, c) for a, b, c in _escapes(m[0])]
        if edits:
            made.append(_rewritten(layer, edits))
    if "\0" in text:
        made.append(_rewritten(layer, [(m.start(), m.end(), "") for m in re.finditer("\0+", text)]))
        made[-1].readable = False
    for a, b in base64_spans(text):
        place = (*layer.origin(a, b), 0)
        made += [Layer(t, [0], [place], plain) for t, plain in _texts(_base64(text[a:b])) if t]
    if any(mark in text for mark in PACKED_MARKS):
        raw = memoryview(text.encode("latin-1", "replace"))  # a place for each character
        for m in PACKED.finditer(text):
            try:
                got = _inflate(m.lastindex - 1, raw[m.start() :], limit)
            except Refused:
                refused += 1
                continue
            if got:
                place = (*layer.origin(m.start(), m.start() + got[1]), 0)
                made += [Layer(t, [0], [place], plain) for t, plain in _texts(got[0]) if t]
    return made, refused


def find(text: str, max_layer_bytes: int = MAX_LAYER_BYTES) -> dict:
    """Base spans, all spans and layer counts of one text."""
    base = sorted(scan(text))
    first = Layer(text, [0], [(0, len(text), 1)])
    spans, seen, work, layers, refused = set(base), {place_of(first)}, [first], 0, 0
    while work:
        made, no = expand(work.pop(), max_layer_bytes)
        refused += no
        for layer in made:
            key = place_of(layer)
            if key in seen:  # a cycle, or the same content of the same place by another way
                continue
            seen.add(key)
            layers += layer.readable
            spans.update(_mapped(layer))
            work.append(layer)
    return {"base": base, "spans": sorted(spans), "layers": layers, "refused": refused}


def _mapped(layer: Layer) -> list[tuple[int, int, int]]:
    out = []
    for start, kind, end in scan(layer.text):
        a, b = layer.origin(start, end)
        out.append((a, kind, b))
    return out


def place_of(layer: Layer) -> tuple[bytes, int, int]:
    """A layer's content and where in the document it comes from."""
    digest = hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return digest, *layer.origin(0, len(layer.text))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(df: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 max_layer_bytes: int = MAX_LAYER_BYTES) -> DataFrame:
    """One row per input row with all its secret spans.

    Columns: the id, ``base`` and ``spans`` (arrays of kind, start, end),
    ``n_layers`` and ``n_refused``.
    """
    python_ready(df.sparkSession)
    id_type = df.schema[id_column].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    none = {"base": [], "spans": [], "layers": 0, "refused": 0}

    def run(batches):
        def as_spans(xs):
            return [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in xs]

        for batch in batches:
            texts = batch.column(1)
            maybe = pc.match_substring_regex(texts, ANY).to_numpy(zero_copy_only=False)
            found = [find(t.as_py(), max_layer_bytes) if m else none for t, m in zip(texts, maybe, strict=True)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([as_spans(x["base"]) for x in found], span),
                pa.array([as_spans(x["spans"]) for x in found], span),
                pa.array([x["layers"] for x in found], pa.int64()),
                pa.array([x["refused"] for x in found], pa.int64()),
            ], names=["id", "base", "spans", "n_layers", "n_refused"])

    kind = "array<struct<kind:string,start:bigint,end:bigint>>"
    return (
        df.select(df[id_column].alias("id"), text_of(text_column).alias("text"))
        .mapInArrow(worker_task(run), f"id {id_type}, base {kind}, spans {kind}, n_layers bigint, n_refused bigint")
        .withColumnRenamed("id", id_column)
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole document, with the digest of the base spans."""
    found = scan_secrets(table(spark, sf_dir, "documents"))
    line = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    count = "cast(size(filter(base, s -> s.kind = '{}')) as bigint) as n_{}"
    return found.selectExpr(
        "doc_id", *(count.format(k, k) for k in KINDS),
        f"sha2({line.format('base')}, 256) as base_sha256", f"{line.format('spans')} as spans",
        "n_layers", "n_refused",
    )


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLE: dict[str, str] = {}
