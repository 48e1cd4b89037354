"""Several addresses of one document asked at once, under one deadline; the losers are cut off."""

from __future__ import annotations

import http.client
import queue
import socket
import threading
import time
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field

PIECE = 1 << 16


@dataclass
class Outcome:
    name: str | None = None
    body: str | None = None
    errors: list[str] = field(default_factory=list)


class _Lines:
    """The connections of a race. Once it is over none can be opened, and those open are shut down, which
    ends any read on them at once."""

    def __init__(self, deadline: float) -> None:
        self.deadline, self._over, self._open, self._lock = deadline, False, [], threading.Lock()

    def left(self) -> float:
        seconds = self.deadline - time.monotonic()
        if self._over or seconds <= 0:
            raise TimeoutError("timed out")
        return seconds

    def add(self, line: socket.socket) -> None:
        with self._lock:
            self.left()
            self._open.append(line)

    def end(self) -> None:
        with self._lock:
            self._over = True
            for line in self._open:
                try:
                    line.shutdown(socket.SHUT_RDWR)
                except OSError:  # it has ended by itself
                    pass

    def opener(self) -> urllib.request.OpenerDirector:
        lines = self

        class Plain(http.client.HTTPConnection):
            def connect(self) -> None:
                super().connect()
                lines.add(self.sock)

        class Secure(http.client.HTTPSConnection):
            def connect(self) -> None:
                super().connect()
                lines.add(self.sock)

        class Http(urllib.request.HTTPHandler):
            def http_open(self, request):
                return self.do_open(Plain, request)

        class Https(urllib.request.HTTPSHandler):
            def https_open(self, request):
                return self.do_open(Secure, request)

        return urllib.request.build_opener(Http, Https)

    def get(self, url: str) -> str:
        with self.opener().open(url, timeout=self.left()) as answer:
            pieces = []
            while piece := answer.read(PIECE):
                pieces.append(piece)
                self.left()
        return b"".join(pieces).decode(errors="replace")


def race(urls: dict[str, str], timeout: float, valid: Callable[[str], bool]) -> Outcome:
    """The first valid body, and the name of its address, or the errors of all in the order of ``urls``. What has
    not answered when the time is up counts as timed out."""
    lines = _Lines(time.monotonic() + timeout)
    answers: queue.SimpleQueue = queue.SimpleQueue()

    def ask(name: str, url: str) -> None:
        try:
            body = lines.get(url)
            answers.put((name, body, None) if valid(body) else (name, None, "Invalid content"))
        except Exception as e:  # any failure of one address leaves the others
            answers.put((name, None, str(e) or type(e).__name__))

    for name, url in urls.items():
        threading.Thread(target=ask, args=(name, url), daemon=True).start()
    errors: dict[str, str] = {}
    try:
        while len(errors) < len(urls):
            name, body, error = answers.get(timeout=max(0.0, lines.deadline - time.monotonic()))
            if error is None:
                return Outcome(name, body)
            errors[name] = error
    except queue.Empty:
        pass
    finally:
        lines.end()
    return Outcome(errors=[f"{name}: {errors.get(name, 'timed out')}" for name in urls])
