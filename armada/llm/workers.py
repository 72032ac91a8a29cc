"""What Python workers keep from task to task.

Spark hands a worker on from job to job, whatever the next one runs; models and
caches of an operator would stay beside those of the next.
"""

from __future__ import annotations

_HELD: list[dict] = []


def holds(*kept: dict) -> None:
    """``kept`` are module dicts that may be emptied between tasks; their operator fills them again."""
    _HELD.extend(kept)


def release() -> None:
    """Called by a task of an operator that keeps nothing: empties what others left in its worker."""
    for kept in _HELD:
        kept.clear()
