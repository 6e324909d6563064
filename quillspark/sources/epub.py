"""EPUB files as tables, and back."""

from __future__ import annotations

import io
import os
import posixpath
import tempfile
import urllib.parse
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ENTRIES = "book string, entry string, content binary"


def local(tag: str) -> str:
    return tag.rpartition("}")[2]


def localname(tag):
    """An XML name without its namespace, as a Column."""
    return F.element_at(F.split(tag, "[}]"), -1)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """``(book, entry, content)``: every file in the archives at ``path``.

    Entries that would leave the archive's root are left out.
    """

    def rows(batches):
        for batch in batches:
            for book, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    for name in z.namelist():
                        inside = posixpath.normpath(name)
                        if not name.endswith("/") and not inside.startswith(("../", "/")):
                            yield pa.RecordBatch.from_arrays([pa.array([book]), pa.array([inside]), pa.array([z.read(name)], pa.binary())], names=["book", "entry", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, ENTRIES)


def package_path(container: bytes) -> str:
    """The first root file that ``container.xml`` names."""
    for el in ElementTree.fromstring(container).iter():
        if local(el.tag) == "rootfile" and el.get("full-path"):
            return el.get("full-path")
    raise ValueError("no package file in the container")


def package_rows(content: bytes) -> list[tuple[str, int, str, str, str]]:
    """``(what, position, id, href, media)`` of manifest items and spine references."""
    out = []
    for el in ElementTree.fromstring(content).iter():
        if local(el.tag) == "item" and el.get("id") and el.get("href"):
            out.append(("item", len(out), el.get("id"), el.get("href"), el.get("media-type", "")))
        elif local(el.tag) == "itemref" and el.get("idref"):
            out.append(("ref", len(out), el.get("idref"), "", ""))
    return out


def root_of(package: str, names: set[str], up: int = 5) -> str:
    """The nearest of the package's folder and those above it that holds META-INF.

    Of ``up`` folders at most; else the folder above the package's.
    """
    holders = {n.partition("META-INF/")[0].rstrip("/") for n in names if n.startswith("META-INF/") or "/META-INF/" in n}
    at = folder = posixpath.dirname(package)
    for _ in range(up):
        if at in holders:
            return at
        if not at:
            break
        at = posixpath.dirname(at)
    return posixpath.dirname(folder) or folder


def spine(files: DataFrame) -> DataFrame:
    """``(book, pos, entry)``: the text files of each book in reading order.

    References are joined to the manifest; links are decoded, fragments
    dropped, and only files under the package's root count, each at its first
    place.
    """

    def packages(batches):
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for book, container, listed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = package_path(container)
                root = root_of(at, {"META-INF/container.xml"})
                inside = lambda path, root=root: not root or path == root or path.startswith(f"{root}/")
                for row in package_rows({f["entry"]: f["content"] for f in listed}.get(at, b"<x/>")):
                    href = posixpath.normpath(posixpath.join(posixpath.dirname(at), urllib.parse.unquote(row[3].split("#", 1)[0]))) if row[3] else ""
                    href = href if inside(href) and not href.startswith("../") else ""
                    for col, v in zip(cols, (book, *row, href), strict=True):
                        col.append(v)
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["book", "what", "pos", "id", "href", "media", "entry"])

    opf = files.where(F.col("entry").endswith(".opf")).groupBy("book").agg(F.collect_list(F.struct("entry", "content")).alias("listed"))
    container = files.where("entry = 'META-INF/container.xml'").select("book", F.col("content").alias("container"))
    rows = container.join(opf, "book").select("book", "container", "listed").mapInArrow(packages, "book string, what string, pos int, id string, href string, media string, entry string")
    items = rows.where("what = 'item' and media like '%xhtml%'").groupBy("book", "id").agg(F.max_by("entry", "pos").alias("entry"))
    refs = rows.where("what = 'ref'").select("book", "pos", "id")
    found = refs.join(items, ["book", "id"]).join(files.select("book", "entry"), ["book", "entry"], "left_semi")
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("book", "entry").orderBy("pos"))).where("n = 1")
    return first.select("book", F.row_number().over(Window.partitionBy("book").orderBy("pos")).alias("pos"), "entry")


def pack(rows: list[tuple[str, bytes]], target: str) -> str:
    """Write one archive: ``mimetype`` first and stored, the rest sorted.

    It is written beside the target and then moved, so that a failure leaves
    an earlier file as it was.
    """
    fd, temporary = tempfile.mkstemp(dir=os.path.dirname(target) or ".")
    try:
        with os.fdopen(fd, "wb") as out, zipfile.ZipFile(out, "w") as z:
            for name, data in sorted(rows, key=lambda r: (r[0] != "mimetype", r[0])):
                z.writestr(name, data, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
        os.replace(temporary, target)
    except BaseException:
        os.unlink(temporary)
        raise
    return target


def pack_translation(rows: list[tuple[str, bytes]], target: str, add: Callable[[dict[str, bytes]], dict[str, bytes]] = dict) -> str:
    """Export a copy of a book, with what ``add`` puts into it, for instance how it was made.

    ``add`` gets the copy by entry and returns the files of the export.  If it
    fails, or the writing does, an earlier export stays as it was.
    """
    return pack(sorted(add(dict(rows)).items()), target)
