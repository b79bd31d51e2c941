"""Memory that the driver gives back."""

from __future__ import annotations

import re
from pathlib import Path

import pytest

from siltstone.llm.common import freed

BLOCK, BLOCKS = 1 << 16, 3000


def _resident(pid: int) -> int:
    return int(re.search(r"VmRSS:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) << 10


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="reads memory as Linux tells it")
def test_freed_gives_back_what_the_drivers_jvm_has_freed_outside_its_heap(spark):
    """Freed blocks below one that is still in use stay with the C library until it is told to return them."""
    jvm = spark.sparkContext._jvm
    if not re.match(r"17\.0\.(9|\d\d)|1[89]|[2-9]\d", jvm.System.getProperty("java.version")):
        pytest.skip("this Java has no such command")
    field = jvm.java.lang.Class.forName("sun.misc.Unsafe").getDeclaredField("theUnsafe")
    field.setAccessible(True)
    unsafe, pid = field.get(None), jvm.java.lang.ProcessHandle.current().pid()
    freed(spark)
    before = _resident(pid)
    blocks = [unsafe.allocateMemory(BLOCK) for _ in range(BLOCKS)]
    for b in blocks:
        unsafe.setMemory(b, BLOCK, 1)
    for b in sorted(blocks)[:-1]:
        unsafe.freeMemory(b)
    held = _resident(pid) - before
    freed(spark)
    left = _resident(pid) - before
    unsafe.freeMemory(max(blocks))
    assert held > BLOCK * BLOCKS // 2  # else the test shows nothing
    assert left < held // 2
