"""Records which of a project's functions call which, in order, while tests run: the source of runtime traces.

As a plug-in of the test runner: python -m pytest -p graphlens.recorder --record-calls trace.json. The
file is what sources.reports.read_traces reads.
"""

from __future__ import annotations

import json
import os
import sys
import threading
from types import CodeType, FrameType

import pytest


class Recorder:
    """Calls of functions whose file lies under root, outside installed packages; made-up code (<...>) is passed through."""

    def __init__(self, root: str = "."):
        self.root = os.path.realpath(root) + os.sep
        self.traces: dict[str, list[list]] = {}
        self._own: dict[CodeType, str | None] = {}
        self._events: list[list] | None = None

    def _path(self, code: CodeType) -> str | None:
        if code not in self._own:
            path = code.co_filename
            real = os.path.realpath(path)
            own = not path.startswith("<") and real.startswith(self.root) and "site-packages" not in real and not code.co_name.startswith("<")
            self._own[code] = real[len(self.root):].replace(os.sep, "/") if own else None
        return self._own[code]

    def _seen(self, frame: FrameType, event: str, _arg: object) -> None:
        if event != "call" or (path := self._path(frame.f_code)) is None:
            return
        depth, caller, up = 0, None, frame.f_back
        while up is not None:
            if (at := self._path(up.f_code)) is not None:
                depth += 1
                caller = caller or (at, up.f_lineno, up.f_code.co_name)
            up = up.f_back
        self._events.append([len(self._events), depth, *(caller or (None, None, None)), path, frame.f_code.co_firstlineno, frame.f_code.co_name])

    def start(self, test: str) -> None:
        self._events = self.traces[test] = []
        threading.setprofile(self._seen)
        sys.setprofile(self._seen)

    def stop(self) -> None:
        sys.setprofile(None)
        threading.setprofile(None)

    def write(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({t: e for t, e in self.traces.items() if e}, f)


def pytest_addoption(parser) -> None:
    parser.addoption("--record-calls", metavar="FILE", help="write the calls of each test to FILE")


def pytest_configure(config) -> None:
    if config.getoption("--record-calls"):
        config.call_recorder = Recorder(str(config.rootpath))


@pytest.hookimpl(wrapper=True)
def pytest_runtest_call(item):
    recorder = getattr(item.config, "call_recorder", None)
    if recorder is None:
        return (yield)
    recorder.start(item.nodeid)
    try:
        return (yield)
    finally:
        recorder.stop()


def pytest_sessionfinish(session) -> None:
    recorder = getattr(session.config, "call_recorder", None)
    if recorder is not None:
        recorder.write(session.config.getoption("--record-calls"))
