"""Objects that a Python worker keeps from task to task."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable

import pyarrow as pa


def trim() -> None:
    """Give freed memory back to the system: a worker outlives its task, and what it holds counts against the next one."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; others have no such call
    if give_back is not None:
        give_back(0)


def release() -> None:
    """Drop the objects that earlier jobs left in this worker; called by functions that need their memory and no kept object."""
    box = sys.modules.get("_quire_worker")
    if box is not None and box.__dict__.get("kept"):
        box.kept.clear()
        trim()


def kept(key: str, make: Callable[[], object], most: int = 1):
    """The worker's object of that key, made at first use.

    Functions of this library reach the workers by value, and their module variables with them, so
    what should outlive a task hangs on a module entry of the process. The oldest of more than
    ``most`` objects goes: a job that needs another one seldom needs the first again.
    """
    box = sys.modules.setdefault("_quire_worker", types.ModuleType("_quire_worker")).__dict__.setdefault("kept", {})
    if key not in box:
        if len(box) >= most:
            while len(box) >= most:
                del box[next(iter(box))]
            trim()
        box[key] = make()
    return box[key]
