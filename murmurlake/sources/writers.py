"""Word documents, WAV bytes and default file names as columns; writing is left to Spark's writers or the caller."""

from __future__ import annotations

import io
import wave
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def docx_bytes(paragraphs: list[str]) -> bytes:
    """A .docx with one unstyled run for each paragraph."""
    clean = ("".join(c for c in p if c in "\t\n" or ord(c) >= 32) for p in paragraphs)
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(p)}</w:t></w:r></w:p>' for p in clean)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {_NS}><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def as_docx(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, content): a .docx for each text, one paragraph for each line."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({key: p[key], "content": [docx_bytes((t or "").split("\n")) for t in p[text]]})

    return texts.select(key, text).mapInPandas(run, f"{key} {texts.schema[key].dataType.simpleString()}, content binary")


def as_docx_lists(rows: DataFrame, key: str, lines: str) -> DataFrame:
    """(key, content): a .docx for each list of paragraphs."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield pd.DataFrame({key: p[key], "content": [docx_bytes([x or "" for x in xs]) for xs in p[lines]]})

    return rows.select(key, lines).mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, content binary")


def wav_bytes(samples, rate: int = 16_000) -> bytes:
    """Mono 16-bit PCM; values are clamped to [-1, 1] and scaled by 32767."""
    import numpy as np

    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, dtype=float), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def default_name(path: Column, ending: str, suffix: str) -> Column:
    """The file's stem, an ending such as _avidentifierad, and a suffix."""
    return F.concat(F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", ""), F.lit(f"{ending}.{suffix}"))
