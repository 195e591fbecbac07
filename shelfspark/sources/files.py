"""Files of a library tree: listing, formats, hashes, side-cars, EPUB, CBZ and DOCX contents."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.functions.classification import file_format

DUBLIN_CORE = "{http://purl.org/dc/elements/1.1/}"
META = "titulo string, autores array<string>, editorial string, idioma string, isbn string, fecha string, paginas int, texto string, error string"


def listing(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Every file below ``root``: path, name, folder, format, bytes, modification time and content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    folder = F.regexp_replace("path", r"/[^/]*$", "")
    return files.select(F.col("path").alias("ruta"), name.alias("nombre"), folder.alias("carpeta"), file_format(name).alias("formato"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), "content")


def with_hash(files: DataFrame) -> DataFrame:
    return files.withColumn("hash_contenido", F.sha2("content", 256))


def _epub(z: zipfile.ZipFile) -> dict:
    box = ElementTree.fromstring(z.read("META-INF/container.xml"))
    opf = ElementTree.fromstring(z.read(next(e.get("full-path") for e in box.iter() if e.tag.endswith("rootfile"))))
    all_of = lambda k: [(e.text or "").strip() for e in opf.iter(DUBLIN_CORE + k) if (e.text or "").strip()]
    first = lambda k: next(iter(all_of(k)), None)
    isbn = next((re.sub(r"[^0-9Xx]", "", i) for i in all_of("identifier") if re.search(r"(?:97[89])?[0-9-]{9,}[0-9Xx]$", i)), None)
    return {"titulo": first("title"), "autores": all_of("creator"), "editorial": first("publisher"), "idioma": first("language"), "isbn": isbn, "fecha": first("date")}


def _cbz(z: zipfile.ZipFile) -> dict:
    names = z.namelist()
    out = {"paginas": sum(bool(re.search(r"\.(?:jpe?g|png|webp|gif)$", n, re.I)) for n in names)}
    info = next((n for n in names if n.lower().endswith("comicinfo.xml")), None)
    if info:
        root = ElementTree.fromstring(z.read(info))
        text = lambda k: root.findtext(k) or None
        out |= {"titulo": text("Title") or text("Series"), "autores": [a.strip() for a in (text("Writer") or "").split(",") if a.strip()], "editorial": text("Publisher"), "fecha": text("Year"), "idioma": text("LanguageISO")}
    return out


def _docx(z: zipfile.ZipFile) -> dict:
    body = ElementTree.fromstring(z.read("word/document.xml"))
    lines = ["".join(t.text or "" for t in p.iter() if t.tag.rpartition("}")[2] == "t") for p in body.iter() if p.tag.rpartition("}")[2] == "p"]
    out = {"texto": "\n".join(lines)}
    if "docProps/core.xml" in z.namelist():
        core = ElementTree.fromstring(z.read("docProps/core.xml"))
        out |= {"titulo": core.findtext(DUBLIN_CORE + "title"), "autores": [a for a in [core.findtext(DUBLIN_CORE + "creator")] if a]}
    return out


def contents(files: DataFrame) -> DataFrame:
    """Metadata of EPUB, comic and Word archives; what cannot be read keeps its row with ``error``."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {"epub": _epub, "comic": _cbz, "word": _docx}
        for batch in batches:
            rows = []
            for kind, content in zip(batch["formato"], batch["content"], strict=True):
                row = dict.fromkeys(["titulo", "autores", "editorial", "idioma", "isbn", "fecha", "paginas", "texto", "error"])
                if kind in readers:
                    try:
                        row |= readers[kind](zipfile.ZipFile(io.BytesIO(content)))
                    except Exception as e:  # noqa: BLE001  a broken file is a row of its own kind
                        row["error"] = type(e).__name__
                rows.append(row)
            out = pd.DataFrame(rows, dtype=object)
            out.insert(0, "ruta", batch["ruta"].to_numpy())
            yield out

    return files.select("ruta", "formato", "content").mapInPandas(work, f"ruta string, {META}")


def overridden(rows: DataFrame, side_cars: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with the values that a side-car ``<file>.meta.json`` (``ruta``, ``json``) states instead of their own."""
    forced = side_cars.select(F.regexp_replace("ruta", r"\.meta\.json$", "").alias("ruta"), F.from_json("json", "map<string,string>").alias("_m"))
    rows = rows.join(forced, "ruta", "left")
    value = lambda c: F.when(F.element_at("_m", f"sin_{c}").eqNullSafe("true"), None).otherwise(F.coalesce(F.element_at("_m", c), F.col(c).cast("string")))
    return rows.withColumns({c: value(c) for c in columns}).drop("_m")


def side_car(record: dict) -> str:
    """A record as its side-car's text, without absent values."""
    return json.dumps({k: v for k, v in record.items() if v not in (None, "", [])}, ensure_ascii=False, sort_keys=True)
