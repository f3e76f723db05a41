"""Clients of model servers, put together from an input, a protocol and an output; and a client for chat servers.

A composed client is a factory for ``commands``: it is called once in each Python
worker's partition.  Whatever fails on the way to an answer becomes a stop.
"""

from __future__ import annotations

import base64
import json
import socket
import struct
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .adapters import command

#: What is told to a model that answers with one action.
SYSTEM_PROMPT = """You are a navigation agent. Given an image and instruction, predict the next action.

RESPOND WITH ONLY ONE OF THESE ACTIONS:
- MOVE_FORWARD
- TURN_LEFT  
- TURN_RIGHT
- STOP

Rules:
1. NO explanations or descriptions
2. ONLY output the action word
3. Use STOP when task is complete
4. Choose the action that best follows the instruction"""
USER_PROMPT = "Instruction: {instruction}\n\nNext action:"
#: Camera matrix and settings that a navigator is reset with.
NAVIGATOR_RESET = {"intrinsic": [[525.0, 0.0, 320.0], [0.0, 525.0, 240.0], [0.0, 0.0, 1.0]], "stop_threshold": -0.5, "batch_size": 1}
#: Seconds to wait for a socket, for pictures with depth, and for a chat answer.
SOCKET_WAIT, HTTP_WAIT, CHAT_WAIT = 60, 30, 60


@dataclass(frozen=True)
class Config:
    """input: rgb or rgbd; output: trajectory or text; protocol: http or socket; the last history_frames pictures are sent."""

    input: str
    output: str
    protocol: str
    port: int = 8888
    host: str = "localhost"
    history_frames: int | None = None


#: The predefined clients.
CONFIGS = {
    "navdp": Config("rgbd", "trajectory", "http", 8888),
    "navila": Config("rgb", "text", "socket", 54321, history_frames=8),
    "navid": Config("rgb", "trajectory", "socket", 54321, history_frames=8),
    "example_rgb_trajectory": Config("rgb", "trajectory", "http", 9999),
    "example_rgbd_text": Config("rgbd", "text", "socket", 10000),
}


def rgb(config: Config, row: dict) -> dict:
    """The last pictures as base64 texts."""
    pictures = list(row.get("images") or [])
    if config.history_frames is not None:
        pictures = pictures[-config.history_frames :]
    return {"images": [base64.b64encode(p).decode() for p in pictures]}


def rgbd(config: Config, row: dict) -> dict:
    """The same with as many depth pictures; fails without any."""
    sent, depths = rgb(config, row), list(row.get("depths") or [])
    if not depths:
        raise ValueError("depth pictures are missing")
    return sent | {"depths": [base64.b64encode(p).decode() for p in depths[-len(sent["images"]) :]]}


def over_http(config: Config, path: str, body: dict, wait: float = HTTP_WAIT) -> str:
    request = urllib.request.Request(f"http://{config.host}:{config.port}{path}", json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=wait) as answer:
        return answer.read().decode()


def over_socket(config: Config, path: str, body: dict, wait: float = SOCKET_WAIT) -> str:
    """A JSON text with its length before it, as four bytes, both ways."""
    raw = json.dumps(body).encode()
    with socket.create_connection((config.host, config.port), timeout=wait) as s:
        s.sendall(struct.pack("!I", len(raw)) + raw)

        def take(n: int) -> bytes:
            got = b""
            while len(got) < n:
                part = s.recv(n - len(got))
                if not part:
                    raise ConnectionError("the server closed early")
                got += part
            return got

        return take(struct.unpack("!I", take(4))[0]).decode()


#: Inputs and protocols by name; more can be added.
INPUTS: dict[str, Callable[[Config, dict], dict]] = {"rgb": rgb, "rgbd": rgbd}
PROTOCOLS: dict[str, Callable[[Config, str, dict], str]] = {"http": over_http, "socket": over_socket}
OUTPUTS = ("trajectory", "text")


class ModelClient:
    """input, then protocol; the output is parsed by commands()."""

    def __init__(self, config: Config):
        for name, known in ((config.input, INPUTS), (config.protocol, PROTOCOLS), (config.output, OUTPUTS)):
            if name not in known:
                raise ValueError(f"there is no {name}; there are {', '.join(known)}")
        self.config, self.ready = config, not (config.output == "trajectory" and config.protocol == "http" and config.port == 8888)

    def ask(self, row: dict) -> str:
        """The server's answer to a row with instruction, images and depths."""
        send = PROTOCOLS[self.config.protocol]
        body = INPUTS[self.config.input](self.config, row) | {"instruction": row.get("instruction") or ""}
        if not self.ready:  # a navigator is reset once; without success it may still answer
            self.ready = True
            try:
                send(self.config, "/navigator_reset", NAVIGATOR_RESET)
            except OSError:
                pass
        return send(self.config, "/query", body)


def model_client(name: str | None = None, **changes) -> Callable[[], ModelClient]:
    """The factory of a predefined client, with some of its values changed, or of one of input, output and protocol."""
    if name is not None and name not in CONFIGS:
        raise ValueError(f"no client {name}; there are {', '.join(CONFIGS)}")
    if name is None and not {"input", "output", "protocol"} <= set(changes):
        raise ValueError("give a name, or input, output and protocol")
    config = replace(CONFIGS[name], **changes) if name else Config(**changes)
    return lambda: ModelClient(config)


def commands(rows: DataFrame, factory: Callable[[], object], angle: str = "yaw") -> DataFrame:
    """rows(instruction, images, yaw, ...) with command, a struct as of adapters.command(); a stop marked "error" where asking fails."""
    asked_of = [c for c in ("instruction", "images", "depths") if c in rows.columns]
    at = [rows.columns.index(c) for c in asked_of]

    def run(batches):
        client = factory()

        def ask(row: dict) -> str | None:
            try:
                return client.ask(row)
            except Exception:  # any failure is a stop
                return None

        for batch in batches:
            given = [batch.column(k).to_pylist() for k in at]
            answers = [ask(dict(zip(asked_of, values, strict=True))) for values in zip(*given, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string())], names=[*batch.schema.names, "answer"])

    got = rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("answer", StringType())]))
    kind = F.when(F.col("answer").isNotNull(), F.lit("any"))
    return got.withColumn("command", command(F.col("answer"), kind, F.coalesce(F.col(angle).cast("double"), F.lit(0.0)) if angle in rows.columns else F.lit(0.0))).drop("answer")


@dataclass
class ChatClient:
    """A server that answers a list of messages at /chat/completions."""

    url: str
    model: str
    key: str = ""
    temperature: float = 0.2
    wait: float = CHAT_WAIT
    headers: dict = field(default_factory=dict)

    def chat(self, messages: list[dict]) -> str:
        body = json.dumps({"model": self.model, "messages": messages, "temperature": self.temperature}).encode()
        head = {"Content-Type": "application/json", **({"Authorization": f"Bearer {self.key}"} if self.key else {}), **self.headers}
        with urllib.request.urlopen(urllib.request.Request(f"{self.url.rstrip('/')}/chat/completions", body, head), timeout=self.wait) as answer:
            return json.loads(answer.read())["choices"][0]["message"]["content"]


def action_messages(instruction: str) -> list[dict]:
    """What a model that answers with one action is asked."""
    return [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": USER_PROMPT.format(instruction=instruction)}]
