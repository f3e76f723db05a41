"""Tables in the shared folder and what the driver holds after them."""

import re
from pathlib import Path

import pytest

from waymark import scratch
from waymark.llm import shared


def held(pid):
    """MB of a process without mapped files."""
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text()))) / 1024


def test_driver_gives_freed_native_memory_back(spark):
    """Every other one of many compressors is ended; without a trim the C library keeps the holes."""
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    if not Path(f"/proc/{pid}/smaps_rollup").exists():
        pytest.skip("no smaps_rollup")
    scratch.native_given_back(spark)
    data = bytearray(b"0123456789abcdef" * 4096)
    out = spark.sparkContext._gateway.new_array(spark._jvm.byte, 1 << 16)
    made = [spark._jvm.java.util.zip.Deflater() for _ in range(1000)]
    try:
        for x in made:
            x.setInput(data)
            x.finish()
            x.deflate(out)
        for x in made[::2]:
            x.end()
        full = held(pid)
        scratch.native_given_back(spark)
        assert held(pid) < full - 50
    finally:
        for x in made[1::2]:
            x.end()


def test_memory_goes_back_after_each_table_and_before_each_stage(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(scratch, "native_given_back", calls.append)
    monkeypatch.setattr(shared, "native_given_back", calls.append)
    assert scratch.written(spark.range(10), "small").count() == 10 and len(calls) == 1
    shared.heap_given_back(spark)
    assert len(calls) == 2
