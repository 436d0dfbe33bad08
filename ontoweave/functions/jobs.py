"""Jobs that do not read each other's results, run at once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

AT_ONCE = 4


def together(calls: Sequence[Callable[[], object]]) -> list:
    """The results of independent calls, in their order. The tasks of one fill the cores that the
    last tasks of another leave idle; where calls fail, the first one's error is raised at the end."""
    session = SparkSession.getActiveSession()
    carried = inheritable_thread_target(session) if session else lambda call: call
    with ThreadPoolExecutor(AT_ONCE) as pool:
        running = [pool.submit(carried(call)) for call in calls]
    return [r.result() for r in running]
