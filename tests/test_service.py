import json
import threading
import time
import urllib.error
import urllib.request

import pytest
from conftest import SF
from millrace.service import Service, server

FILES = {
    "workflows/shop/transforms/stg.sql": "-- @view\nselect o_orderkey, o_custkey from orders",
    "workflows/shop/transforms/by.sql": "-- @table\nselect o_custkey, count(*) as n from stg group by 1",
}


@pytest.fixture
def client(spark, workspace):
    service = Service(workspace(FILES), spark, SF, token="t0k")
    http = server(service)
    threading.Thread(target=http.serve_forever, daemon=True).start()

    def call(path, body=None, token="t0k", key=None):
        headers = {"Authorization": f"Bearer {token}"} | ({"Idempotency-Key": key} if key else {})
        request = urllib.request.Request(f"http://127.0.0.1:{http.server_port}{path}", json.dumps(body).encode() if body is not None else None, headers)
        try:
            with urllib.request.urlopen(request) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    yield call
    http.shutdown()


def finished(client, key):
    for _ in range(300):
        operation = client(f"/v1/operations/{key}")[1]
        if operation["status"] not in ("pending", "running"):
            return operation
        time.sleep(0.1)
    raise AssertionError("the operation doesn't end")


def test_service(client):
    assert client("/status", token="wrong")[0] == 200 and client("/v1/check", token="wrong")[0] == 401
    assert client("/v1/check")[1]["models"] == 2
    assert [m["id"] for m in client("/v1/models?select=%2Bby")[1]] == ["shop.stg", "shop.by"]
    assert client("/v1/models/shop.by")[1]["depends"] == ["shop.stg"]
    assert client("/v1/models/none")[0] == 404 and client("/v1/nothing")[0] == 404
    assert client("/v1/plan")[1]["summary"]["build"] == 2
    status, made = client("/v1/operations", {"kind": "run"}, key="k1")
    assert status == 202
    assert client("/v1/operations", {"kind": "run"}, key="k1")[1]["id"] == made["id"]
    assert client("/v1/operations", {"kind": "test"}, key="k1")[0] == 409
    assert client("/v1/operations", {"kind": "odd"})[0] == 400
    done = finished(client, made["id"])
    assert done["status"] == "succeeded" and done["result"]["models"]["shop.by"] == "passed"
    assert client(f"/v1/state/runs/{done['result']['run']}")[1]["models"]["shop.by"]["status"] == "passed"
    assert client("/v1/state/models/shop.by")[1] and client("/v1/impact/orders.o_custkey")[1]["models"] == ["shop.by", "shop.stg"]
    assert client("/v1/diff/branch")[1]["datasets"] and client("/v1/graph")[1]["order"] == ["shop.stg", "shop.by"]
    failed = finished(client, client("/v1/operations", {"kind": "resume", "run": "none"})[1]["id"])
    assert failed["status"] == "failed" and "resumed" in failed["error"]
    assert client("/v1/reload", {})[1] == {"models": 2, "ok": True}
