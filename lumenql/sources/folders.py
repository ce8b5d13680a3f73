"""Folder archives: a folder as one JSON value, with file contents in base64."""

from __future__ import annotations

import base64
import json

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from .storage import Files

LARGE = 10 * 1024 * 1024  # files from this size on keep name and size only


def load_folder(files: Files, path: str) -> bytes | None:
    """The archive of a folder, or None if there is none."""
    if not files.is_dir(path):
        return None

    def entry(name: str, at: str) -> dict:
        if files.is_dir(at):
            return {"name": name, "entries": [entry(n, f"{at}/{n}") for n in files.list(at)]}
        size = files.size(at)
        return {"name": name, "size": size, "content": base64.b64encode(files.read(at)).decode() if size < LARGE else None}

    return json.dumps(entry(path.rstrip("/").rsplit("/", 1)[-1], path.rstrip("/")), ensure_ascii=False).encode()


def export_folder(files: Files, data: bytes, path: str) -> int:
    """Write an archive's entries below ``path``; 1 if done. Names that leave the folder are refused."""

    def put(entry: dict, at: str) -> None:
        if "entries" in entry:
            files.make(at)
            for e in entry["entries"]:
                if "/" in e["name"] or "\\" in e["name"] or e["name"] in ("", ".", ".."):
                    raise ValueError(f"unsafe name {e['name']!r} in a folder archive")
                put(e, f"{at}/{e['name']}")
        elif entry.get("content") is not None:
            files.write(at, base64.b64decode(entry["content"]))

    put(json.loads(data), path.rstrip("/"))
    return 1


def listing(data: bytes | None) -> str | None:
    """One indented line an entry: [d] for folders, [f] with the size for files."""
    if data is None:
        return None
    lines: list[str] = []

    def show(entry: dict, depth: int) -> None:
        folder = "entries" in entry
        lines.append("  " * depth + (f"[d] {entry['name']}" if folder else f"[f] {entry['name']} ({entry['size']} bytes)"))
        for e in entry.get("entries", []):
            show(e, depth + 1)

    show(json.loads(data), 0)
    return "\n".join(lines)


def file_count(data: bytes | None) -> int | None:
    """Files in an archive, at any depth."""
    if data is None:
        return None

    def count(entry: dict) -> int:
        return sum(map(count, entry["entries"])) if "entries" in entry else 1

    return count(json.loads(data))


def register(spark: SparkSession) -> None:
    """LIST_FOLDER and FOLDER_FILES over columns: recursion over JSON has no built-in, so these are pandas UDFs."""

    @pandas_udf("string")
    def list_folder(data: pd.Series) -> pd.Series:
        return data.map(lambda x: listing(bytes(x)), na_action="ignore")

    @pandas_udf("long")
    def folder_files(data: pd.Series) -> pd.Series:
        return data.map(lambda x: file_count(bytes(x)), na_action="ignore").astype("Int64")

    spark.udf.register("list_folder", list_folder)
    spark.udf.register("folder_files", folder_files)


#: Functions of literal paths, answered on the driver while a statement is rewritten.
def host_functions(spark: SparkSession) -> dict:
    files = Files(spark)

    def content(path: str) -> str:
        if not files.exists(path) or files.is_dir(path):
            return "CAST(NULL AS BINARY)"
        return f"(SELECT first(content) FROM binaryFile.`{path}`)"

    def folder(path: str) -> str:
        data = load_folder(files, path)
        return "CAST(NULL AS BINARY)" if data is None else f"unhex('{data.hex()}')"

    return {
        "LOAD_FILE": content,
        "LOAD_IMAGE": content,
        "LOAD_FOLDER": folder,
        "FILE_EXISTS": lambda p: f"CAST({int(files.exists(p))} AS BIGINT)",
        "FILE_SIZE": lambda p: f"CAST({files.size(p)} AS BIGINT)" if files.exists(p) else "CAST(NULL AS BIGINT)",
    }
