"""A small HTTP server of byte ranges, to serve an archive folder to readers or tests."""

from __future__ import annotations

import os
import re
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from functools import partial
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote, urlsplit


class RangeHandler(BaseHTTPRequestHandler):
    """Answers 200, 206, 400, 403, 404 and 416."""

    protocol_version = "HTTP/1.1"
    #: Answers leave in one piece and at once, as a kept connection would wait for each small one; idle ones end.
    wbufsize, disable_nagle_algorithm, timeout = 1 << 16, True, 300

    def __init__(self, *args, root: str, **more):
        self.root = os.path.realpath(root)
        super().__init__(*args, **more)

    def _fail(self, code: int, **headers: str) -> None:
        self.send_response(code)
        for name, value in headers.items():
            self.send_header(name.replace("_", "-"), value)
        self.send_header("Content-Length", "0")
        self.end_headers()

    def do_HEAD(self) -> None:  # noqa: N802
        self.do_GET(body=False)

    def do_GET(self, body: bool = True) -> None:  # noqa: N802
        path = os.path.realpath(os.path.join(self.root, unquote(urlsplit(self.path).path).lstrip("/")))
        if os.path.commonpath([path, self.root]) != self.root:
            return self._fail(403)
        if not os.path.isfile(path):
            return self._fail(404)
        size = os.path.getsize(path)
        first, last, code = 0, size - 1, 200
        if (asked := self.headers.get("Range")) is not None:
            found = re.fullmatch(r"bytes=(\d*)-(\d*)", asked.strip())
            if not found or asked.strip() == "bytes=-":
                return self._fail(400)
            if found[1]:
                first, last = int(found[1]), min(int(found[2]), size - 1) if found[2] else size - 1
            else:
                first = max(0, size - int(found[2]))
            if first >= size or (found[2] and found[1] and int(found[2]) < first):
                return self._fail(416, Content_Range=f"bytes */{size}")
            code = 206
        self.send_response(code)
        self.send_header("Accept-Ranges", "bytes")
        self.send_header("Content-Type", "application/octet-stream")
        self.send_header("Content-Length", str(last - first + 1))
        if code == 206:
            self.send_header("Content-Range", f"bytes {first}-{last}/{size}")
        self.end_headers()
        if body:
            with open(path, "rb", buffering=0) as file:
                if last - first < self.wbufsize:
                    file.seek(first)
                    self.wfile.write(file.read(last - first + 1))
                elif last >= first:
                    self.wfile.flush()
                    self.connection.sendfile(file, first, last - first + 1)

    def log_message(self, *_) -> None:
        pass


class _Server(ThreadingHTTPServer):
    #: Connections that wait to be taken; with too few, those of many tasks are dropped and try again after seconds.
    request_queue_size = 1024


def server(archive_dir: str = "./", port: int = 0, host: str = "127.0.0.1") -> ThreadingHTTPServer:
    """A server that is not running yet; its port is server_address[1]."""
    return _Server((host, port), partial(RangeHandler, root=archive_dir))


@contextmanager
def served(folder: str, host: str = "127.0.0.1") -> Iterator[str]:
    """The URL of a server of a folder, on this machine."""
    running = server(folder, 0, host)
    threading.Thread(target=running.serve_forever, args=(0.05,), daemon=True).start()
    try:
        yield f"http://{host}:{running.server_address[1]}"
    finally:
        running.shutdown()
        running.server_close()


def serve(port: int, archive_dir: str = "./", host: str = "127.0.0.1") -> None:
    """Serve until interrupted."""
    with server(archive_dir, port, host) as running:
        running.serve_forever()
