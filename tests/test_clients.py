"""Clients against small servers on this machine; tasks and presets that a caller adds."""

import base64
import json
import socket
import struct
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from waymark.operators import actions, adapters, clients, episodes


@pytest.fixture
def web():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, body, self.headers.get("Authorization")))
            answer = {"choices": [{"message": {"content": "said " + body["messages"][-1]["content"]}}]} if "messages" in body else {"trajectory": [[0, 0], [1, 0]]}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield server.server_port, seen
    server.shutdown()


@pytest.fixture
def plug():
    """A server that answers each text with its length before it."""
    seen = []
    listener = socket.create_server(("127.0.0.1", 0))

    def serve():
        while True:
            try:
                s, _ = listener.accept()
            except OSError:
                return
            with s:
                n = struct.unpack("!I", s.recv(4, socket.MSG_WAITALL))[0]
                seen.append(json.loads(s.recv(n, socket.MSG_WAITALL)))
                raw = json.dumps({"text_response": "go straight on"}).encode()
                s.sendall(struct.pack("!I", len(raw)) + raw)

    threading.Thread(target=serve, daemon=True).start()
    yield listener.getsockname()[1], seen
    listener.close()


def test_chat(web):
    port, seen = web
    client = clients.ChatClient(f"http://127.0.0.1:{port}/v1/", "m", key="k")
    assert client.chat([{"role": "user", "content": "x"}]) == "said x"
    assert seen[0][0] == "/v1/chat/completions" and seen[0][1]["temperature"] == 0.2 and seen[0][2] == "Bearer k"


def test_composed_clients(spark, web, plug):
    port, seen = plug
    rows = spark.createDataFrame([("walk", [bytes([k]) for k in range(10)], 0.0)], "instruction string, images array<binary>, yaw double")
    got = clients.commands(rows, clients.model_client("navila", port=port, host="127.0.0.1")).first().command
    assert got.parsed_from == "text" and got.vx > 0 and not got.stop
    assert [base64.b64decode(x) for x in seen[0]["images"]] == [bytes([k]) for k in range(2, 10)] and seen[0]["instruction"] == "walk"
    port, seen = web
    with_depth = rows.withColumn("depths", F.col("images"))
    got = clients.commands(with_depth, clients.model_client("navdp", port=port, host="127.0.0.1")).first().command
    assert got.parsed_from == "trajectory" and [p for p, _, _ in seen] == ["/query"] and len(seen[0][1]["depths"]) == 10


def test_failures_are_stops(spark):
    rows = spark.createDataFrame([("walk", [b"x"])], "instruction string, images array<binary>")
    for factory in (clients.model_client("navdp", port=1), clients.model_client("navid", port=1, host="127.0.0.1")):
        got = clients.commands(rows, factory).first().command
        assert (got.vx, got.vy, got.yaw_rate, got.stop, got.parsed_from) == (0, 0, 0, True, "error")
    for wrong in ({"name": "other"}, {"input": "rgb"}):
        with pytest.raises(ValueError):
            clients.model_client(**wrong)
    with pytest.raises(ValueError):
        clients.model_client(input="smell", output="text", protocol="http")()
    assert clients.action_messages("go")[1]["content"].startswith("Instruction: go")


def test_tasks_can_be_added(spark):
    e = spark.createDataFrame([("1", [[0.0, 0.0, 0.5], [1.0, 2.0, 0.5]])], "episode_id string, gt_locations array<array<double>>")
    episodes.register("halfway", episodes.Task(lambda: {"half": F.element_at("gt_locations", 1)}, lambda c: c["distance"] < 10))
    try:
        assert episodes.for_task(e, "Halfway").first().half == [0.0, 0.0, 0.5]
        ask = lambda t: spark.range(1).select(episodes.reached(F.lit(t), F.lit(5.0), F.lit(None).cast("double"), F.lit(False), F.lit(0.0), F.lit(0.0)).alias("v")).first().v
        assert [ask(t) for t in ("halfway", "vln", "unknown")] == [True, False, False]
        with pytest.raises(ValueError):
            episodes.register("vln", episodes.TASKS["vln"])
    finally:
        del episodes.TASKS["halfway"]


def test_presets_from_json():
    assert actions.preset_from('{"preset": "navila_large", "turn": 20}') == actions.Preset(0.75, 20, 30)
    with pytest.raises(TypeError):
        actions.preset_from('{"speed": 1}')


def test_answers_stop_at_the_limit(spark):
    class Slow:
        def chat(self, messages):
            import time

            time.sleep(0.2)
            return "ok"

    rows = spark.range(10, numPartitions=1).withColumn("messages", F.lit("[]"))
    got = [r.answer for r in adapters.asked(rows, Slow, limit=0.5).collect()]
    assert got.count("ok") in (2, 3, 4) and got[-1] is None
