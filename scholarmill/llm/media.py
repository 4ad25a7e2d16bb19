"""Media columns: interleaved document sequences.

HTML becomes one ordered sequence of text and media references, each reference with its caption; payloads are kept once
by digest, losslessly, as 8-bit grey PNG images; references meet their payloads by a join on the digest, while
positions and captions stay aligned with the sequence.
"""

from __future__ import annotations

import hashlib
import html
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Samples to an image row; payloads are padded with spaces to whole rows.
WIDTH = 192
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)|<!?(/?)([A-Za-z][A-Za-z0-9]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([A-Za-z_:][\w:.\-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
# Elements whose borders part text, and elements that refer to media
_BLOCKS = frozenset("address article aside blockquote body br caption dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table tbody td tfoot th thead title tr ul".split())
_MEDIA = frozenset("img video audio source embed".split())


def sequence(page: str) -> list[tuple[str, str | None, str | None, str | None]]:
    """(kind, text, digest, caption) in the order of the page; kind is ``text`` or ``media``.

    A reference's digest is its ``data-digest`` attribute, or else the SHA-256 of its ``src``. Its caption is its
    figure's caption, or else its ``alt`` text. Scripts, styles and comments are left out; entities are decoded.
    """
    out: list[list] = []
    held: list[str] = []
    figure: int | None = None
    in_caption = False

    def close() -> None:
        nonlocal in_caption
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text and in_caption and figure is not None and any(x[0] == "media" for x in out[figure:]):
            for x in out[figure:]:
                if x[0] == "media":
                    x[3] = text
        elif text:
            out.append(["text", text, None, None])

    at = 0
    for m in _TAG.finditer(page):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if name in _BLOCKS or name in _MEDIA:
            close()
        if name == "figure":
            figure = None if m[2] else len(out)
        elif name == "figcaption":
            in_caption = not m[2]
        elif name in _MEDIA and not m[2]:
            got = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTRIBUTE.findall(m[4])}
            if got.get("data-digest") or got.get("src"):
                digest = got.get("data-digest") or hashlib.sha256(got["src"].encode("utf-8", "surrogatepass")).hexdigest()
                out.append(["media", None, digest, got.get("alt") or None])
    held.append(page[at:])
    close()
    return [tuple(x) for x in out]


ITEM = "pos int, kind string, text string, digest string, caption string"


def _interleave(with_text: bool):
    def run(batches):
        for batch in batches:
            rows, held = [], 0
            for doc, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for pos, (kind, text, digest, caption) in enumerate(sequence(page.as_py() or "")):
                    if kind == "media" or with_text:
                        rows.append((doc, pos, kind, text, digest, caption))
                        held += len(text or "")
                if held > 8 << 20:
                    yield _items(rows)
                    rows, held = [], 0
            if rows:
                yield _items(rows)

    return run


def _items(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int32(), *[pa.string()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["doc_id", "pos", "kind", "text", "digest", "caption"])


def interleave(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", with_text: bool = True) -> DataFrame:
    """(doc_id, pos, kind, text, digest, caption): the sequence of every page, positions from 0.

    Without ``with_text`` only media references are given, at the same positions. Null and empty pages, and pages
    without text or references, have no rows. Broken markup is read as text. Repeated rows are parsed each.
    """
    base = pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(html_col).cast("string").alias("html"))
    return base.mapInArrow(_interleave(with_text), f"doc_id long, {ITEM}")


def to_image(payload: bytes) -> bytes:
    """A payload of whole rows as an 8-bit grey PNG."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows

    def part(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw.tobytes(), 6)) + part(b"IEND", b"")


def from_image(media: bytes) -> np.ndarray:
    """The samples (rows x columns) of an image that ``to_image`` wrote."""
    at, data, width, height = 8, [], 0, 0
    while at < len(media):
        n, kind = struct.unpack(">I4s", media[at : at + 8])
        if kind == b"IHDR":
            width, height = struct.unpack(">II", media[at + 8 : at + 16])
        elif kind == b"IDAT":
            data.append(media[at + 8 : at + 8 + n])
        at += n + 12
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)[:, 1:]


def _store(batches):
    seen: set[bytes] = set()
    names = ["digest", "n_bytes", "media"]
    for batch in batches:
        rows, held = [], 0
        for x in batch.column(0):
            text = (x.as_py() or "").encode()
            digest = hashlib.sha256(text)
            if digest.digest() in seen:
                continue
            seen.add(digest.digest())
            media = to_image(text + b" " * (-len(text) % WIDTH or (0 if text else WIDTH)))
            rows.append((digest.hexdigest(), len(text), media))
            held += len(media)
            if held > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.binary()), strict=True)], names=names)


def store_payloads(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Writes the distinct payloads of a partition as images and gives the stored table (digest, n_bytes, media) back.

    A digest may stand in it once for each partition that held its text; null texts are empty.
    """
    return materialise(texts.select(F.col(text_col).cast("string")).mapInArrow(_store, "digest string, n_bytes long, media binary"), "media-store")


def _read(batches):
    for batch in batches:
        out: list[list] = [[] for _ in range(6)]
        for x in batch.column(2):
            media = x.as_py()
            image = from_image(media)
            payload = image.tobytes()
            histogram = np.bincount(image.ravel() >> 4, minlength=16)
            row, mean = image.sum(1, dtype=np.int64), image.mean()
            feature = f"size={image.shape[1]}x{image.shape[0]};mean={mean:.6f};std={image.std():.6f};rows={int(row.min())}-{int(row.max())};hist=" + ",".join(map(str, histogram.tolist()))
            for column, value in zip(out, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                column.append(value)
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def read_payloads(store: DataFrame) -> DataFrame:
    """(digest, n_bytes, payload and media figures, feature) of every stored payload, once for each digest."""
    rows = store.select("digest", "n_bytes", "media").mapInArrow(_read, f"digest string, n_bytes long, {FEATURES}")
    return materialise(rows.groupBy("digest").agg(*(F.min(c).alias(c) for c in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"))), "media-read")


def resolve(items: DataFrame, payloads: DataFrame) -> DataFrame:
    """The items with their payload's columns, joined on the digest; those without a stored payload get nulls."""
    return items.join(payloads, "digest", "left")


def page_of(text):
    """An HTML page (a column) that shows a text's lines as paragraphs, then the text itself as a captioned image."""
    text = F.coalesce(text, F.lit(""))
    safe = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    figure = F.concat(F.lit('<figure><img alt="" data-digest="'), F.sha2(text, 256), F.lit('"><figcaption>'), F.length(text).cast("string"), F.lit(" characters</figcaption></figure>"))
    return F.concat(F.lit("<article><p>"), F.replace(safe, F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"), figure, F.lit("</article>"))
