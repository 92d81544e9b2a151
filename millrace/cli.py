"""Command line: run, check, compile or inspect scripts.

python -m millrace [-h] [-V] [-q TEXT | -s FILE | -c FILE | -cc FILE | -fb FILE | -r] [-o OUT] [-m | -d PATH] [--data FOLDER] [-v]
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from pathlib import Path

from . import __version__
from .engine import Engine
from .errors import EngineError


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="millrace", description=__doc__.splitlines()[0])
    what = p.add_mutually_exclusive_group()
    what.add_argument("-q", metavar="TEXT", help="run statements and show the last result")
    what.add_argument("-s", metavar="FILE", help="run a script file")
    what.add_argument("-c", metavar="FILE", help="check the syntax of a script file")
    what.add_argument("-cc", metavar="FILE", help="write the statement plan of a script to the -o file")
    what.add_argument("-fb", metavar="FILE", help="run the script of a written statement plan")
    what.add_argument("-r", action="store_true", help="prompt")
    p.add_argument("file", nargs="?", help="a script file to run")
    p.add_argument("-o", metavar="OUT", default="out.plan", help="where -cc writes")
    p.add_argument("-m", action="store_true", help="in memory: nothing is loaded or committed")
    p.add_argument("-d", metavar="PATH", help="database folder to open and to commit to")
    p.add_argument("--data", metavar="FOLDER", help="folder whose NAME.parquet are tables")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-V", "--version", action="version", version=__version__)
    return p


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("millrace").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None, spark=None, out=None, stdin=None) -> int:
    a, out = parser().parse_args(argv), out or sys.stdout
    logging.basicConfig(level=logging.INFO if a.verbose else logging.WARNING, format="%(asctime)s %(levelname)s %(message)s")
    if a.c or a.cc:
        text = Path(a.c or a.cc).read_text()
        errors = Engine.check(text)
        for e in errors:
            print(f"error: {e}", file=out)
        if errors:
            return 1
        if a.c:
            print("OK", file=out)
        else:
            from .plans.parser import parse_script

            Path(a.o).write_text(json.dumps({"text": text, "plan": [repr(s) for s in parse_script(text)]}, indent=1))
        return 0
    engine = Engine(spark or _session(), None if a.m else a.d)
    if a.data:
        names = sorted(p.name.removesuffix(".parquet") for p in Path(a.data).glob("*.parquet"))
        engine.register_folder(a.data, *[x for x in names if x not in engine.tables()])
    if a.r:
        return _prompt(engine, out, stdin or sys.stdin)
    if a.q:
        text = a.q
    elif a.fb:
        text = json.loads(Path(a.fb).read_text())["text"]
    elif a.s or a.file:
        text = Path(a.s or a.file).read_text()
    else:
        parser().print_help(out)
        return 0
    failed = _run(engine, text, out)
    if a.d and not a.m and not failed:
        engine.commit(a.d)
    return int(failed)


def _run(engine: Engine, text: str, out) -> bool:
    failed = False
    for s, result in engine.script(text):
        if isinstance(result, Exception):
            failed = True
            print(f"error: {result}", file=out)
        elif result is not None:
            print("\t".join(result.columns), file=out)
            for row in result.toLocalIterator():
                print("\t".join("NULL" if v is None else str(v) for v in row), file=out)
    return failed


def _prompt(engine: Engine, out, stdin) -> int:
    for line in stdin:
        if line.strip().lower() in ("exit", "quit"):
            break
        try:
            _run(engine, line, out)
        except EngineError as e:
            print(f"error: {e}", file=out)
    return 0
