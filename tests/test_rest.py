"""The HTTP service and its configuration."""

import http.client
import json

import pytest

from strata.config import options
from strata.engine import Engine
from strata.errors import InvalidRequest
from strata.sources.rest import serve


def test_service(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    server = serve(engine, port=0)

    def call(method, route, body):
        c = http.client.HTTPConnection("127.0.0.1", server.server_port)
        c.request(method, f"/rest/{route}", body if isinstance(body, bytes) else json.dumps(body))
        r = c.getresponse()
        return r.status, json.loads(r.read())

    schema = {"columns": {"user_id": {"dtype": "string"}, "cents": {"dtype": "int64"}}, "partitioning": {"day": {"dtype": "timestampMinute"}}}
    assert call("POST", "create_table", {"tableName": "p", "schema": schema}) == (200, {"alreadyExists": False, "columnsAdded": []})
    assert call("POST", "create_table", {"tableName": "p", "schema": schema})[0] == 400
    assert call("POST", "create_table", {"tableName": "p", "schema": schema, "mode": "okIfExact"}) == (200, {"alreadyExists": True, "columnsAdded": []})
    row = {"tableName": "p", "partition": {"day": "2022-01-01T00:00:00Z"}, "rows": [{"user_id": "abc", "cents": 1}]}
    assert call("POST", "write_to_partition", row) == (200, {})
    assert call("POST", "write_to_partition", row | {"rows": [{"x": 1}]})[0] == 400
    assert call("GET", "list_tables", {}) == (200, {"tables": [{"tableName": "p"}]})
    assert call("GET", "list_tables", b"")[0] == 400 and call("GET", "list_tables", b"\xff")[0] == 400
    assert call("POST", "alter_table", {"tableName": "p", "newColumns": {"x": {"dtype": "bool"}}}) == (200, {})
    assert call("GET", "get_schema", {"tableName": "p"})[1]["schema"]["columns"]["x"]["dtype"] == "bool"
    found = call("GET", "list_segments", {"tableName": "p", "includeMetadata": True})[1]["segments"]
    assert found[0]["metadata"] == {"rowCount": 1} and found[0]["partition"] == {"day": "2022-01-01T00:00:00Z"}
    one = {"tableName": "p", "partition": found[0]["partition"], "segmentId": found[0]["segmentId"]}
    for i in range(4):
        assert call("POST", "write_to_partition", row | {"rows": [{"user_id": f"u{i}", "cents": i}]}) == (200, {})
    read = one | {"columnName": "user_id", "correlationId": "r", "pageRows": 3}
    status, page = call("GET", "read_segment_column", read)
    assert status == 200 and [x["rowId"] for x in page["rows"]] == [0, 1, 2] and page["rows"][1]["value"] == "u0"
    status, rest = call("GET", "read_segment_column", read | {"continuationToken": page["continuationToken"]})
    assert [x["value"] for x in rest["rows"]] == ["u2", "u3"] and "continuationToken" not in rest
    assert call("GET", "read_segment_column", one | {"columnName": "user_id"})[0] == 400
    assert call("POST", "delete_from_segment", one | {"rowIds": [0]}) == (200, {"nDeleted": 1})
    assert call("GET", "read_segment_deletions", one | {"correlationId": "d"}) == (200, {"rowIds": [0]})
    assert call("POST", "drop_table", {"tableName": "p"}) == (200, {}) and call("POST", "drop_table", {"tableName": "p"})[0] == 404
    assert call("POST", "nonsense", {})[0] == 404 and call("POST", "drop_table", {})[0] == 400
    server.shutdown()


def test_options(tmp_path):
    path = tmp_path / "c.toml"
    path.write_text("default_segment_target_rows = 7\nport = 1\n")
    found = options(["--port", "2"], {"STRATA_CONFIG": str(path)})
    assert (found["default_segment_target_rows"], found["port"], found["host"]) == (7, 2, "127.0.0.1")
    path.write_text("nonsense = 1\n")
    with pytest.raises(InvalidRequest):
        options([], {"STRATA_CONFIG": str(path)})
