"""A small HTTP/JSON service over an engine: POST /rest/create_table, drop_table, alter_table, delete_from_segment and
write_to_partition, GET /rest/list_tables, get_schema, list_segments, read_segment_column and read_segment_deletions.
Bodies are JSON objects, also of GET requests. Writes are staged; reads of segments come page by page."""

from __future__ import annotations

import base64
import datetime as dt
import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.engine import Engine
from strata.errors import Internal, InvalidRequest, NotFound, StrataError
from strata.plans.partitions import PartitionFilter
from strata.plans.schema import ROW_ID

LIMIT = 64 << 20
#: Rows of a page, unless a request asks for fewer.
PAGE = 10_000


def _need(body: dict, *names: str) -> list:
    if missing := [n for n in names if n not in body]:
        raise InvalidRequest(f"missing: {', '.join(missing)}")
    return [body[n] for n in names]


def _write(engine: Engine, body: dict) -> dict:
    table, rows = _need(body, "tableName", "rows")
    engine.write_to_partition(table, body.get("partition"), rows, stage=True)
    return {}


def _page(rows: DataFrame, body: dict) -> tuple[list, dict]:
    """Rows after the token's row id, and the token of the page behind them if there may be one."""
    size = min(PAGE, max(1, int(body.get("pageRows", PAGE))))
    found = rows.where(F.col(ROW_ID) > int(body.get("continuationToken") or -1)).orderBy(ROW_ID).limit(size).collect()
    return found, {"continuationToken": str(found[-1][ROW_ID])} if len(found) == size else {}


def _column(engine: Engine, body: dict) -> dict:
    table, segment, column, correlation = _need(body, "tableName", "segmentId", "columnName", "correlationId")
    rows, more = _page(engine.read_segment_column(table, body.get("partition"), segment, column, correlation), body)
    return {"rows": [{"rowId": r[ROW_ID], "value": r[column]} for r in rows]} | more


def _deletions(engine: Engine, body: dict) -> dict:
    table, segment, correlation = _need(body, "tableName", "segmentId", "correlationId")
    rows, more = _page(engine.read_segment_deletions(table, body.get("partition"), segment, correlation), body)
    return {"rowIds": [r[ROW_ID] for r in rows]} | more


def _filters(body: dict) -> list[PartitionFilter]:
    return [PartitionFilter(f.get("partitionName", ""), f.get("comparison", ""), f.get("value"), "value" not in f) for f in body.get("partitionFilter") or []]


ROUTES = {
    ("POST", "create_table"): lambda e, b: e.create_table(*_need(b, "tableName"), b.get("schema"), b.get("mode", "failIfExists")),
    ("POST", "alter_table"): lambda e, b: e.alter_table(*_need(b, "tableName", "newColumns")),
    ("POST", "drop_table"): lambda e, b: e.drop_table(*_need(b, "tableName")),
    ("POST", "write_to_partition"): _write,
    ("POST", "delete_from_segment"): lambda e, b: e.delete_from_segment(_need(b, "tableName")[0], b.get("partition"), *_need(b, "segmentId", "rowIds")),
    ("GET", "list_tables"): lambda e, b: e.list_tables(),
    ("GET", "get_schema"): lambda e, b: {"schema": e.get_schema(*_need(b, "tableName"))},
    ("GET", "read_segment_column"): _column,
    ("GET", "read_segment_deletions"): _deletions,
    ("GET", "list_segments"): lambda e, b: {"segments": e.list_segments(_need(b, "tableName")[0], _filters(b), bool(b.get("includeMetadata")))},
}


def answer(engine: Engine, method: str, path: str, raw: bytes) -> tuple[int, dict]:
    """Status and body of a request."""
    try:
        route = ROUTES.get((method, path.removeprefix("/rest/"))) if path.startswith("/rest/") else None
        if route is None:
            raise NotFound(f"no route {method} {path}")
        try:
            body = json.loads(raw.decode())
        except ValueError as e:
            raise InvalidRequest(f"the body is no JSON: {e}") from None
        if not isinstance(body, dict):
            raise InvalidRequest("the body must be an object")
        return 200, route(engine, body)
    except StrataError as e:
        return e.status, e.body()
    except Exception as e:  # noqa: BLE001
        return 500, Internal(str(e)).body()


def _text(value) -> str:
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    return value.isoformat().replace("+00:00", "Z") if isinstance(value, dt.datetime) else str(value)


def serve(engine: Engine, host: str = "127.0.0.1", port: int = 3841) -> ThreadingHTTPServer:
    """Starts the service in a thread of its own, and the engine's flushes and maintenance; ``shutdown()`` ends both."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, body = answer(engine, self.command, self.path, self.rfile.read(size)) if size <= LIMIT else (400, {"message": "the body is too large"})
            data = json.dumps(body, default=_text).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = _do

        def log_message(self, *_) -> None:
            pass

    class Server(ThreadingHTTPServer):
        def shutdown(self) -> None:
            super().shutdown()
            engine.stop()

    server = Server((host, port), Handler)
    engine.start()
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


def main(argv: list[str] | None = None) -> None:
    """``python -m strata.sources.rest --dir ... --port ...``: what crashes have left is mended first."""
    from pyspark.sql import SparkSession

    from strata.config import options

    o = options(argv)
    place = {k: o.pop(k) for k in ("dir", "host", "port")}
    engine = Engine(SparkSession.builder.getOrCreate(), place["dir"], **o)
    engine.recover()
    server = serve(engine, place["host"], place["port"])
    try:
        threading.Event().wait()
    except KeyboardInterrupt:
        server.shutdown()


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
