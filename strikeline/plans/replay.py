"""A service on the driver that plays the far side of the live sources: it serves frames that have landed, breaking the line as
often as it is told to, and answers SQL over the shipped tables through DuckDB."""

from __future__ import annotations

import json
import shutil
import tempfile
import threading
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse


BLOCK = 1 << 16


class Frames:
    """Lines of a folder's text files, in the order of their names, by number. Kept is how many lines end before each block of
    a file, so that a range is read from the block it begins in, wherever it lies."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.files, root = fs.FileSystem.from_uri(path)
        found = self.files.get_file_info(fs.FileSelector(root))
        self.paths = sorted(f.path for f in found if f.base_name.startswith("part-") and f.size)
        self.read = 0  # bytes that were read to serve ranges
        self.ends: list[int] = []
        self.blocks: list[array] = []
        for p in self.paths:
            ended = array("q", [0])
            with self.files.open_input_stream(p) as stored:
                while block := stored.read(BLOCK):
                    ended.append(ended[-1] + block.count(b"\n"))
            self.blocks.append(ended)
            self.ends.append((self.ends[-1] if self.ends else 0) + ended[-1])

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def _begun(self, stored, block: int) -> bytes:
        """What the blocks before this one hold of its first line."""
        rest = b""
        while block and b"\n" not in rest:
            block -= 1
            stored.seek(block * BLOCK)
            rest = stored.read(BLOCK) + rest
            self.read += BLOCK
        return rest[rest.rfind(b"\n") + 1 :]

    def chunks(self, start: int, end: int) -> Iterator[list[bytes]]:
        """The lines from start to end, some at a time."""
        k = bisect_right(self.ends, start)
        while start < end and k < len(self.paths):
            first = self.ends[k - 1] if k else 0
            at = bisect_right(self.blocks[k], start - first) - 1  # the block in which the line ends
            skip = start - first - self.blocks[k][at]
            with self.files.open_input_file(self.paths[k]) as stored:
                rest = b"" if skip else self._begun(stored, at)
                stored.seek(at * BLOCK)
                while start < min(end, self.ends[k]):
                    *whole, rest = (rest + stored.read(BLOCK)).split(b"\n")
                    self.read += BLOCK
                    lines = whole[skip : skip + end - start]
                    skip = max(0, skip - len(whole))
                    if lines:
                        start += len(lines)
                        yield lines
            k += 1

    def between(self, start: int, end: int) -> Iterator[bytes]:
        for lines in self.chunks(start, end):
            yield from lines


class Service:
    """`with Service(...) as s: s.url`. The line breaks after every `breaks` frames that were sent, inside the next one; the
    first requests, `refuse` in number, are answered with 503. Tables are read where they lie, or first stored by `order`."""

    def __init__(self, host: str = "127.0.0.1", frames: Frames | None = None, sf_dir: str | None = None, tables: tuple[str, ...] = (), breaks: int = 0, refuse: int = 0, order: str | None = None):
        self.frames, self.breaks, self.refuse = frames, breaks, refuse
        self.sent, self.broken, self.asked, self.lock = 0, 0, [], threading.Lock()
        self.folder: str | None = None
        self.held: int | None = None  # how many frames are shown, if not all
        if tables:
            import duckdb

            if order:
                # Stored on disk in the order that is asked for, so that a page costs no more in a larger table.
                self.folder = tempfile.mkdtemp(prefix="spark-")
                self.db = duckdb.connect(f"{self.folder}/tables.db", config={"memory_limit": "1GB", "preserve_insertion_order": "false"})
            else:
                self.db = duckdb.connect()
            for t in tables:
                rows = f"SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')"
                self.db.execute(f"CREATE TABLE {t} AS {rows} ORDER BY {order}" if order else f"CREATE VIEW {t} AS {rows}")
        self.server = ThreadingHTTPServer((host, 0), self._handler())

    @property
    def url(self) -> str:
        host, port = self.server.server_address[:2]
        return f"http://{host}:{port}"

    def __enter__(self) -> Service:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        self.server.shutdown()
        self.server.server_close()
        if self.folder:
            self.db.close()
            shutil.rmtree(self.folder, ignore_errors=True)

    def answer(self, sql: str) -> dict | bytes:
        """Rows as objects of texts, put together by the database."""
        try:
            found = self.db.cursor().execute(f"SELECT to_json(r) FROM (SELECT CAST(COLUMNS(*) AS VARCHAR) FROM ({sql})) AS r").fetchall()
            return f'{{"query_execution_status": "Success", "rows": [{",".join(r[0] for r in found)}]}}'.encode()
        except Exception as e:  # whatever the database refuses is told to the caller
            return {"query_execution_status": "Error", "query_execution_message": str(e)}

    def _handler(service) -> type[BaseHTTPRequestHandler]:  # noqa: N805
        class Handler(BaseHTTPRequestHandler):
            def log_message(self, *_) -> None:
                pass

            def reply(self, body: bytes, status: int = 200) -> None:
                self.send_response(status)
                self.end_headers()
                self.wfile.write(body)

            def do_GET(self) -> None:
                asked = urlparse(self.path)
                wanted = {k: v[0] for k, v in parse_qs(asked.query).items()}
                with service.lock:
                    service.asked.append((asked.path, wanted, self.headers.get("Authorization")))
                    if service.refuse > 0:
                        service.refuse -= 1
                        return self.reply(b"busy", 503)
                if "q" in wanted:
                    answer = service.answer(wanted["q"])
                    return self.reply(answer if isinstance(answer, bytes) else json.dumps(answer).encode())
                held = len(service.frames) if service.held is None else service.held
                if asked.path == "/latest":
                    return self.reply(json.dumps({"offset": held}).encode())
                if asked.path != "/frames":
                    return self.reply(b"unknown", 404)
                self.send_response(200)
                self.end_headers()
                for lines in service.frames.chunks(int(wanted["from"]), min(held, int(wanted["to"]))):
                    while lines:
                        with service.lock:
                            n = min(len(lines), service.breaks - service.sent % service.breaks) if service.breaks else len(lines)
                            service.sent += n
                            breaking = service.breaks and service.sent % service.breaks == 0
                            service.broken += bool(breaking)
                        if breaking:
                            last = lines[n - 1]
                            self.wfile.write(b"".join(x + b"\n" for x in lines[: n - 1]) + last[: len(last) // 2])
                            return None
                        self.wfile.write(b"\n".join(lines[:n]) + b"\n")
                        lines = lines[n:]
                return None

        return Handler


def host(spark) -> str:
    """The address at which tasks find the driver."""
    return spark.sparkContext.getConf().get("spark.driver.host", "127.0.0.1")
