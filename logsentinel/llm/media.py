"""Media columns: interleaved sequences of text and media references, resolved by digest.

* ``encode`` stores a payload losslessly as one-channel 8-bit PCM samples in a WAV container; ``decode`` reads it back.
* ``store`` turns documents into a payload table, one row a document: digest, stored form, features of what is read back.
* ``interleave`` parses HTML into an ordered array of structs (position, kind, text, media, caption): text runs, and
  references ``media:<digest>`` of img, audio, video, source and embed elements with the caption of their figure.
* ``resolve`` joins the references to the payloads on the digest; positions and captions stay with their reference.

A payload is shared by all documents with the same text: the payload side is reduced to one row a digest by partial
aggregates before the join, and only its small columns are carried. Null text is the empty payload (64 zero bytes);
html that is null or has no media gives an empty or text-only sequence; an unknown digest resolves to nulls.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import bounded_batches

BLOCK = 64
RATE = 8000


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK))


def encode(payload: bytes) -> bytes:
    n = len(payload)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", n) + payload


def decode(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def features(samples: bytes) -> str:
    """Of the signal that the samples are: mean, power, zero crossings, entropy and a coarse spectrum of levels."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    total, squares = int(counts @ np.arange(256)), int(counts @ (np.arange(256) - 128) ** 2)
    high = x >= 128
    crossings = int(np.count_nonzero(high[1:] != high[:-1]))
    levels = ",".join(map(str, counts.reshape(8, 32).sum(1).tolist()))
    return f"mean={total / len(x):.4f};power={squares / len(x):.4f};crossings={crossings};entropy={max(0.0, float(-(share * np.log2(share)).sum())):.4f};levels={levels}"


STORE = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store(docs: DataFrame, with_media: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of STORE, and media (binary) if asked for, for every row of docs; all computed from the bytes read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                out: list[list] = [[] for _ in names[1:]]
                for text in part.column(1):  # one text at a time, and its sound file only if it is asked for
                    raw = (text.as_py() or "").encode()
                    media = encode(padded(raw))
                    back = decode(media)
                    row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), features(back), media)
                    for c, v in zip(out, row, strict=False):
                        c.append(v)
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
                cols = [pa.array(c, t) for c, t in zip(out, types, strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=names)

    schema = STORE + (", media binary" if with_media else "")
    names = [x.split()[0] for x in schema.split(", ")]
    bounded_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, schema)


def digest(text: Column) -> Column:
    """The digest of a text's padded payload, without leaving the JVM."""
    raw = F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")
    n = F.octet_length(raw)
    short = F.when(n == 0, BLOCK).otherwise((BLOCK - n % BLOCK) % BLOCK)
    return F.sha2(F.concat(raw, F.substring(F.lit(bytes(BLOCK)), F.lit(1), short)), 256)


#: As in ``html_extract``: no text takes longer than its length.
_INSIDE = r"(?>[^<>\"']|\"[^\"]*\"|'[^']*')*+"
_PIECE = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)({_INSIDE})>", re.S | re.I)
_SRC = re.compile(r"\bsrc\s*=\s*[\"']?media:([0-9A-Za-z]+)", re.I)
_MEDIA = frozenset("img audio video source embed".split())

SEQUENCE = "array<struct<position:int,kind:string,text:string,media:string,caption:string>>"


def sequence(source: str | None) -> list[dict]:
    """Ordered pieces of a page; the caption of a figure goes to each reference in it."""
    out: list[dict] = []
    text: list[str] = []
    caption: list[str] | None = None
    figure: list[dict] | None = None

    def flush():
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            out.append({"position": len(out), "kind": "text", "text": line, "media": None, "caption": None})

    at, source = 0, source or ""
    for m in _PIECE.finditer(source):
        (text if caption is None else caption).append(entities.unescape(source[at : m.start()]))
        at = m.end()
        tag, closing = (m[3] or "").lower(), m[2] == "/"
        if tag in _MEDIA and not closing and (ref := _SRC.search(m[4])):
            flush()
            out.append({"position": len(out), "kind": "media", "text": None, "media": ref[1].lower(), "caption": None})
            if figure is not None:
                figure.append(out[-1])
        elif tag == "figure":
            flush()
            figure = None if closing else []
        elif tag == "figcaption" and figure is not None:
            if not closing:
                flush()
                caption = []
            elif caption is not None:
                said = " ".join("".join(caption).split())
                for piece in figure:
                    piece["caption"] = said
                caption = None
        elif tag in ("p", "div", "h1", "h2", "h3", "h4", "li", "br", "article", "section"):
            (text if caption is None else caption).append(" ")
            if caption is None and tag != "br":
                flush()
    (text if caption is None else caption).append(entities.unescape(source[at:]))
    if caption is not None:
        for piece in figure or ():
            piece["caption"] = " ".join("".join(caption).split())
    flush()
    return out


def interleave(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """id, sequence (see SEQUENCE) for every row of pages."""
    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media", pa.string()), ("caption", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sequence(x) for x in b.column(1).to_pylist()], kind)], names=["id", "sequence"])

    bounded_batches(pages.sparkSession)
    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, f"id long, sequence {SEQUENCE}")


def resolve(sequences: DataFrame, payloads: DataFrame, digest_col: str = "payload_sha256") -> DataFrame:
    """id, position, caption of each media reference with the columns of its payload (nulls if none has the digest)."""
    refs = sequences.select("id", F.explode("sequence").alias("piece")).where("piece.kind = 'media'").select("id", "piece.position", "piece.caption", F.col("piece.media").alias("_media"))
    rest = [c for c in payloads.columns if c not in (digest_col, "doc_id")]
    one = payloads.groupBy(F.col(digest_col).alias("_digest")).agg(*(F.min(c).alias(c) for c in rest))
    return refs.join(one, refs["_media"] == one["_digest"], "left").drop("_digest").withColumnRenamed("_media", digest_col)
