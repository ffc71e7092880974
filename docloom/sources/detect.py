"""File types, by suffix, by leading bytes, and by what a container holds.

Suffix and leading bytes are plain expressions. Looking into a container needs
its directory, so that part is an Arrow function; it only runs where the
cheaper ones don't decide.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

SUFFIXES = {
    "excel": ("xls", "xlsx"),
    "ichitaro": ("jtd", "jtt"),
    "image": ("bmp", "gif", "jpeg", "jpg", "png", "tif", "tiff", "webp"),
    "pdf": ("pdf",),
    "powerpoint": ("ppt", "pptx"),
    "word": ("doc", "docx"),
}
SUPPORTED = tuple(sorted(x for xs in SUFFIXES.values() for x in xs))
#: Glob for Spark's file sources, either case.
GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for x in SUPPORTED) + "}"


def by_suffix(path: Column) -> Column:
    suffix = F.regexp_extract(F.lower(path), r"[^/\\]\.([^./\\]+)$", 1)
    found = F.lit("unknown")
    for kind, names in SUFFIXES.items():
        found = F.when(suffix.isin(*names), kind).otherwise(found)
    return found


def by_bytes(content: Column) -> Column:
    """The type that the first 12 bytes tell: pdf, ole, zip, image or unknown."""
    head = F.hex(F.substring(content, 1, 12))
    image = head.rlike("^(?:89504E470D0A1A0A|FFD8|47494638|424D|49492A00|4D4D002A)") | head.rlike("^52494646.{8}57454250$")
    return F.when(F.coalesce(F.octet_length(content), F.lit(0)) < 4, "unknown").when(head.startswith("25504446"), "pdf").when(head.startswith("D0CF11E0"), "ole").when(head.startswith("504B0304"), "zip").when(image, "image").otherwise("unknown")


def image_suffix(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 6))
    return F.when(F.coalesce(F.octet_length(content), F.lit(0)) < 4, ".png").when(head.startswith("FFD8"), ".jpg").when(head.rlike("^47494638(?:37|39)61"), ".gif").when(head.startswith("424D"), ".bmp").otherwise(".png")


def zip_kind(content: bytes) -> str:
    import io
    import zipfile

    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            typed = z.read("[Content_Types].xml").decode("utf-8", "replace") if "[Content_Types].xml" in names else ""
    except Exception:  # noqa: BLE001  a broken archive has no type
        return "unknown"
    for kind, mark, folder in (("excel", "spreadsheetml", "xl/"), ("word", "wordprocessingml", "word/"), ("powerpoint", "presentationml", "ppt/")):
        if typed and (mark in typed or any(folder in n for n in names)):
            return kind
    folders = {"xl": "excel", "word": "word", "ppt": "powerpoint"}
    return next((folders[n.split("/")[0]] for n in names if not typed and "/" in n and n.split("/")[0] in folders), "unknown")


def ole_kind(content: bytes) -> str:
    from docloom.sources.ole import CompoundFile

    try:
        names = [n.lower() for n in CompoundFile(content).names()]
    except Exception:  # noqa: BLE001
        return "unknown"
    for kind, marks in (("ichitaro", ("jtdocument", "jtdbody", "jsrv_segmentinformation")), ("word", ("worddocument", "1table")), ("excel", ("workbook", "book")), ("powerpoint", ("powerpoint document", "current user"))):
        if any(m in n for m in marks for n in names):
            return kind
    return "unknown"


@pandas_udf(StringType())
def container_kind(content: pd.Series) -> pd.Series:
    return content.map(lambda b: "unknown" if b is None else zip_kind(bytes(b)) if b[:2] == b"PK" else ole_kind(bytes(b)))


def file_type(path: Column, content: Column) -> Column:
    """The suffix decides where it is known; else the leading bytes, and for containers their contents."""
    suffix, head = by_suffix(path), by_bytes(content)
    return F.when(suffix != "unknown", suffix).when(head.isin("ole", "zip"), container_kind(F.when((suffix == "unknown") & head.isin("ole", "zip"), content))).otherwise(head)
