"""python -m lumenql ROOT [DATABASE]: a prompt for statements and dot commands."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession

from .session import Engine
from .sources import importers
from .sources.storage import Files

HELP = """.help  .tables  .schema [TABLE]  .backup PATH  .restore PATH  .version
.import SQLITE_FILE [TABLE ...]  .import-sql FILE  .export TABLE PATH [parquet|csv|json|orc]  .vacuum  .quit"""


def command(engine: Engine, line: str) -> str | DataFrame:
    """One dot command's answer."""
    word, *rest = line.split()
    if word == ".help":
        return HELP
    if word == ".version":
        return engine.variables["version"].strip("'")
    if word == ".tables":
        return engine.execute("SHOW TABLES")
    if word == ".schema":
        return "\n".join(engine.execute(f"SHOW CREATE TABLE `{t}`").first()[1] for t in (rest or engine.catalog.tables))
    if word in (".backup", ".restore"):
        return engine.execute(f"{'BACKUP TO' if word == '.backup' else 'RESTORE FROM'} '{rest[0]}'").message
    if word == ".import":
        return str(importers.import_sqlite(engine, rest[0], rest[1:] or None))
    if word == ".import-sql":
        return str(importers.import_dump(engine, Files(engine.spark).read(rest[0]).decode()))
    if word == ".export":
        importers.export(engine.execute(f"SELECT * FROM `{rest[0]}`"), rest[1], *rest[2:3])
        return "exported"
    if word == ".vacuum":
        return f"{engine.catalog.vacuum()} folders deleted"
    return f"unknown command {word}; .help lists them"


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    engine = Engine(SparkSession.builder.appName("lumenql").getOrCreate(), *args[:2])
    for line in sys.stdin:
        line = line.strip()
        if line in (".quit", ".exit"):
            break
        if not line:
            continue
        try:
            got = command(engine, line) if line.startswith(".") else engine.execute(line)
            got.show(100, truncate=False) if isinstance(got, DataFrame) else print(getattr(got, "message", got))
        except Exception as e:  # noqa: BLE001 - a prompt shows errors and goes on
            print(f"{type(e).__name__}: {e}")
    engine.close()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
