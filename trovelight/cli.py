"""The command line: ``python -m trovelight.cli version | search | inspect | records | providers sync``."""

from __future__ import annotations

import argparse
import json
import sys
import time
from itertools import islice
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from trovelight import __version__
from trovelight.catalogue import Catalogue
from trovelight.output import Ndjson, envelope, known, table_text, terminal_json
from trovelight.plans.query import QueryError, explain, override, parse
from trovelight.schema import METAINFO_BYTES
from trovelight.sources.http import fetch
from trovelight.sources.metainfo import MetainfoError, inspect_magnet, inspect_metainfo
from trovelight.sources.transport import https
from trovelight.sync import SYNC_SECONDS, XmlProvider, sync

OK, FAILED, USAGE, CANCELLED = 0, 1, 2, 130


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="trovelight")
    p.add_argument("--output", choices=("table", "json", "ndjson"), default="table")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    s = commands.add_parser("search")
    how = s.add_mutually_exclusive_group(required=True)
    how.add_argument("--explain", action="store_true")
    how.add_argument("--offline", metavar="CATALOGUE")
    s.add_argument("--provider", action="append")
    s.add_argument("--sort")
    s.add_argument("--limit", type=int)
    s.add_argument("query", nargs="+")
    commands.add_parser("inspect").add_argument("source")
    commands.add_parser("records").add_argument("catalogue")
    providers = commands.add_parser("providers").add_subparsers(dest="action", required=True)
    sync = providers.add_parser("sync")
    for name in ("provider", "--origin", "--catalogue", "--snapshots"):
        sync.add_argument(name, **({"required": True} if name.startswith("--") else {}))
    return p


def _session():
    from trovelight.session import local_session

    return local_session("trovelight-cli")


def _emit(kind: str, header: list[str], rows: list[list], data, how: str, out) -> None:
    if how == "json":
        out.write(envelope(kind, data))
    elif how == "ndjson":
        stream = Ndjson(out.write)
        for d in data if isinstance(data, list) else [data]:
            stream.send(kind, d)
        stream.done()
    else:
        out.write(table_text(header, rows))


def _inspect(source: str, send) -> dict:
    if source.lower().startswith("magnet:"):
        return inspect_magnet(source)
    if source.lower().startswith("https:"):
        u = urlsplit(source)
        got = fetch(f"https://{u.netloc}", (u.path or "/") + (f"?{u.query}" if u.query else ""), send, deadline=time.monotonic() + SYNC_SECONDS, most=METAINFO_BYTES)
        return inspect_metainfo(got.body or b"")
    path = Path(source)
    if path.is_symlink() or not path.is_file():
        raise MetainfoError("no regular file")
    if path.stat().st_size > METAINFO_BYTES:
        raise MetainfoError("too large")
    return inspect_metainfo(path.read_bytes())


def _emit_inspection(got: dict, how: str, out) -> None:
    files = got["files"] or []
    if how == "json":
        out.write(envelope("torrent_inspect", got))
    elif how == "ndjson":
        stream = Ndjson(out.write)
        stream.send("torrent", got | {"files": []})
        for k, f in enumerate(files, 1):
            stream.send("file", {"index": k, **f})
        stream.send("done", {"files": len(files)} | ({"total_size": got["total_size"]} if got["total_size"] is not None else {}))
    else:
        lists = [(f"{name[:-1]}[{k}]", v) for name in ("trackers", "webseeds") for k, v in enumerate(got[name] or [], 1)]
        rows = [(k, v) for k, v in got.items() if k not in ("files", "error", "trackers", "webseeds")] + lists + [(f"file[{k}]", f"{f['path']} ({f['size']} bytes)") for k, f in enumerate(files, 1)]
        out.write(table_text(["FIELD", "VALUE"], [[k, known(v)] for k, v in rows]))


def _emit_records(records, how: str, out) -> None:
    """Every record as it arrives; a table needs widths, so it is written in parts."""
    rows = (r.asDict(recursive=True) for r in records.toLocalIterator())
    if how == "ndjson":
        stream = Ndjson(out.write)
        for row in rows:
            stream.send("record", row)
        stream.done()
    elif how == "json":
        head, tail = envelope("record", []).split("[]")
        out.write(head + "[")
        for k, row in enumerate(rows):
            out.write(("," if k else "") + terminal_json(json.dumps(row, ensure_ascii=False, separators=(",", ":"), default=str)))
        out.write("]" + tail)
    else:
        header = ["PROVIDER", "SOURCE", "TITLE"]
        while part := list(islice(rows, 1_000)):
            out.write(table_text(header, [[r["provider"], r["source_id"], r["title"]] for r in part]))


def main(arguments: list[str] | None = None, out=None, err=None, send=https) -> int:
    """Run a command; ``send`` is the transport of ``inspect`` and ``providers sync``."""
    out, err = out or sys.stdout, err or sys.stderr
    try:
        args = _parser().parse_args(arguments)
    except SystemExit as e:
        return USAGE if e.code else OK
    try:
        if args.command == "version":
            _emit("version", ["VERSION"], [[__version__]], {"version": __version__}, args.output, out)
        elif args.command == "search":
            query = override(parse(" ".join(args.query)), args.provider, args.sort, args.limit)
            if args.explain:
                _emit("explain", ["PART", "VALUE"], [list(r) for r in explain(query)], query.to_dict(), args.output, out)
            else:
                from trovelight.plans.search import search

                hits = [r.asDict(recursive=True) for r in search(Catalogue(_session(), args.offline).index(), query).orderBy("rank").collect()]
                rows = [[h["rank"], h["record"]["title"], h["providers"], known(h["record"]["size_bytes"]), known(h["record"]["published_at"])] for h in hits]
                _emit("result", ["RANK", "TITLE", "PROVIDERS", "SIZE", "DATE"], rows, hits, args.output, out)
                for w in query.warnings if args.output == "table" else []:
                    err.write(f"warning: {w.code}: {w.message}\n")
        elif args.command == "inspect":
            _emit_inspection(_inspect(args.source, send), args.output, out)
        elif args.command == "providers":
            spark = _session()
            catalogue = Catalogue(spark, args.catalogue)
            how = sync(catalogue, XmlProvider(spark, args.provider, args.origin, send, Path(args.snapshots)))
            n = catalogue.scan().where(F.col("provider") == args.provider).count()
            _emit("provider_sync", ["PROVIDER", "STATUS", "RECORDS"], [[args.provider, how, n]], {"provider": args.provider, "status": how, "records": n}, args.output, out)
        else:
            _emit_records(Catalogue(_session(), args.catalogue).records(), args.output, out)
    except QueryError as e:
        err.write(f"error: {e.code}\n")
        return USAGE
    except KeyboardInterrupt:
        return CANCELLED
    except Exception as e:
        err.write(f"error: {e}\n")
        return FAILED
    return OK


if __name__ == "__main__":
    sys.exit(main())
