"""Document conversion: a registry of converters by extension, sidecar paths and their staleness."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONVERTERS: dict[str, Callable[[bytes], str]] = {}


def converter(*extensions: str) -> Callable:
    """Registers a function of a file's bytes that returns its text."""

    def wrap(f: Callable[[bytes], str]) -> Callable[[bytes], str]:
        CONVERTERS.update({e: f for e in extensions})
        return f

    return wrap


@converter(".txt", ".md")
def plain(data: bytes) -> str:
    return data.decode("utf-8", "replace")


@converter(".rtf")
def rtf(data: bytes) -> str:
    """Text of simple RTF: control words and groups that hold no text are dropped. Line ends of the file only end control words; paragraph marks are text, also the last one."""
    t = re.sub(r"[\r\n]", "", re.sub(r"(\\[a-z]+-?\d*)\r?\n", r"\1 ", data.decode("latin-1")))
    t = re.sub(r"\{\\(?:fonttbl|colortbl|stylesheet|info|\*)(?:[^{}]|\{[^{}]*\})*\}", "", t)
    t = re.sub(r"\\'([0-9a-f]{2})", lambda m: bytes([int(m[1], 16)]).decode("cp1252", "replace"), t)
    t = re.sub(r"\\(?:par|line)\b ?", "\n", t)
    return re.sub(r"[{}]", "", re.sub(r"\\[a-z]+-?\d* ?", "", t)).strip(" \t")


def _office(data: bytes, members: str, paragraph: str, run: str) -> str:
    import io
    import zipfile
    from xml.etree import ElementTree

    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = [n for n in z.namelist() if re.fullmatch(members, n)]
        for n in sorted(names, key=lambda x: [int(d) for d in re.findall(r"\d+", x)]):
            root = ElementTree.fromstring(z.read(n))
            out += ["".join(t.text or "" for t in p.iter() if t.tag.endswith(run)) for p in root.iter() if p.tag.endswith(paragraph)]
    return "\n".join(x for x in out if x.strip())


@converter(".docx")
def docx(data: bytes) -> str:
    return _office(data, r"word/document\.xml", "}p", "}t")


@converter(".pptx")
def pptx(data: bytes) -> str:
    return _office(data, r"ppt/slides/slide\d+\.xml", "}p", "}t")


@converter(".pdf")
def pdf(data: bytes) -> str:
    """Text of uncompressed or deflated streams: what stands in the show operators."""
    import zlib

    out = []
    for m in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", data, re.S):
        s = m[1]
        try:
            s = zlib.decompress(s)
        except zlib.error:
            pass
        out += [re.sub(rb"\\([()\\])", rb"\1", x).decode("latin-1") for x in re.findall(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|'|\")", s)]
    return "\n".join(out)


def html_text(html: Column) -> Column:
    """Visible text of an HTML page, JVM-side: scripts, styles and comments go, blocks end lines, tags go, common entities are resolved."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<(?:br|/p|/div|/li|/h[1-6]|/tr|/article|/section)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "")


def scan(spark, path: str, globs: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of a file tree; content is read only if it is used."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", globs).load(path)


def convert(files: DataFrame, extension: Column) -> DataFrame:
    """(path, text) of (path, content) rows with a registered extension; text is null where conversion fails."""
    known = list(CONVERTERS)
    rows = files.select("path", "content", extension.alias("ext")).filter(F.col("ext").isin(*known))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(ext: str, data: bytes) -> str | None:
            try:
                return CONVERTERS[ext](bytes(data))
            except Exception:  # a broken file is a row without text, not a failed job
                return None

        for b in batches:
            yield pd.DataFrame({"path": b["path"], "text": [one(e, d) for e, d in zip(b["ext"], b["content"], strict=True)]})

    return rows.mapInPandas(run, "path string, text string")


def sidecar(path: Column) -> Column:
    return F.concat(F.lit(".sidecar/"), path, F.lit(".md.gz"))


def stale(source_time: Column, sidecar_time: Column) -> Column:
    return sidecar_time.isNull() | (source_time > sidecar_time)
