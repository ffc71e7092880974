"""Programs outside of Spark: an office suite for legacy files, engines that read images.

Looked up on the machine that runs the task; where one is missing, the file
gives an error row. A task's own temporary folder goes when the task is done
with it.
"""

from __future__ import annotations

import os
import shutil
import subprocess
import tempfile
from collections.abc import Callable
from functools import cache
from pathlib import Path

OLE = b"\xd0\xcf\x11\xe0"
#: file type -> (old suffix, new suffix, seconds allowed)
LEGACY = {"excel": ("xls", "xlsx", 60), "word": ("doc", "docx", 60), "powerpoint": ("ppt", "pptx", 180)}
OFFICE_PLACES = ("/usr/bin/soffice", "/usr/local/bin/soffice", "/opt/libreoffice/program/soffice", "/Applications/LibreOffice.app/Contents/MacOS/soffice", "C:/Program Files/LibreOffice/program/soffice.exe")


@cache
def office() -> str | None:
    """The office suite's program, or None."""
    found = shutil.which("soffice") or shutil.which("libreoffice")
    return found or next((p for p in OFFICE_PLACES if os.access(p, os.X_OK)), None)


def _convert(content: bytes, old: str, new: str, seconds: int) -> bytes:
    """A file's bytes in another format, by the office suite in a folder and with a profile of its own."""
    program = office()
    if program is None:
        raise RuntimeError("no office suite here to convert the file")
    with tempfile.TemporaryDirectory() as folder:
        source = Path(folder, f"in.{old}")
        source.write_bytes(content)
        profile = f"-env:UserInstallation=file://{folder}/profile"
        subprocess.run([program, profile, "--headless", "--convert-to", new, "--outdir", folder, str(source)], check=True, capture_output=True, timeout=seconds)
        made = Path(folder, f"in.{new}")
        if not made.exists():
            raise RuntimeError("the office suite made no file")
        return made.read_bytes()


def modern(kind: str, content: bytes) -> bytes:
    """A legacy file of a type as the new format of that type; other content as it is."""
    if kind not in LEGACY or not content.startswith(OLE):
        return content
    return _convert(content, *LEGACY[kind])


#: file type -> suffix to render it by
RENDERED = {"excel": "xlsx", "word": "docx", "powerpoint": "pptx"}


def as_pdf(kind: str, content: bytes, seconds: int = 180) -> bytes:
    """A file as PDF, a sheet on one page each; PDF as it is."""
    if kind == "pdf":
        return content
    if kind not in RENDERED:
        raise ValueError(f"{kind} can't be rendered")
    content = modern(kind, content)
    if kind == "excel":
        from docloom.sources.ooxml import fit_to_one_page

        content = fit_to_one_page(content)
    return _convert(content, RENDERED[kind], "pdf", seconds)


def page_images(pdf: bytes, dpi: int = 300, seconds: int = 300) -> list[bytes]:
    """Each page as PNG, in order."""
    program = shutil.which("pdftoppm")
    if program is None:
        raise RuntimeError("no program here that renders pages")
    with tempfile.TemporaryDirectory() as folder:
        Path(folder, "in.pdf").write_bytes(pdf)
        subprocess.run([program, "-r", str(dpi), "-png", f"{folder}/in.pdf", f"{folder}/page"], check=True, capture_output=True, timeout=seconds)
        made = sorted(Path(folder).glob("page*.png"), key=lambda p: int(p.stem.rpartition("-")[2] or 0))
        return [p.read_bytes() for p in made]


Engine = Callable[[bytes], str]


def tesseract(content: bytes, languages: str = "jpn+eng") -> str:
    program = shutil.which("tesseract")
    if program is None:
        raise RuntimeError("no engine here that reads images")
    done = subprocess.run([program, "stdin", "stdout", "-l", languages], input=content, check=True, capture_output=True, timeout=120)
    return done.stdout.decode("utf-8", "replace").strip()


#: Engines that read images, by name; each must be importable on the executors.
ENGINES: dict[str, Engine] = {"tesseract": tesseract}


def image_suffix(content: bytes) -> str:
    """By the first bytes; .png where they say nothing."""
    heads = ((b"\x89PNG\r\n\x1a\n", ".png"), (b"\xff\xd8", ".jpg"), (b"GIF87a", ".gif"), (b"GIF89a", ".gif"), (b"BM", ".bmp"))
    return next((s for head, s in heads if content.startswith(head)), ".png")
