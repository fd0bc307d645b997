"""A project's operations over HTTP, with the standard library: one table of routes, one function that answers, and a server around it.

Requests are answered one after the other, as one Spark session does the work; a long ingest holds its request.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import asdict, dataclass
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import unquote

from sillage.plans.config import Config
from sillage.plans.ingest import status
from sillage.plans.runtime import Runtime
from sillage.sources.tables import Chats, Projects

_PROJECT = r"/v1/projects/(?P<project>[^/]+)"
#: Methods and paths, and what answers them.
ROUTES = (
    ("GET", "/healthz", "health"),
    ("GET", "/v1/projects", "projects"), ("POST", "/v1/projects", "create"),
    ("GET", _PROJECT, "project"), ("PATCH", _PROJECT, "update"), ("DELETE", _PROJECT, "delete"),
    ("GET", f"{_PROJECT}/status", "status"), ("POST", f"{_PROJECT}/query", "query"), ("POST", f"{_PROJECT}/ingest", "ingest"),
    ("GET", f"{_PROJECT}/chats", "chats"), ("GET", f"{_PROJECT}/chats/(?P<chat>[^/]+)", "chat"),
    ("PUT", f"{_PROJECT}/chats/(?P<chat>[^/]+)", "save_chat"), ("DELETE", f"{_PROJECT}/chats/(?P<chat>[^/]+)", "delete_chat"),
)
#: The first that fits an error gives the status; any other error is a 500.
STATUSES = ((FileNotFoundError, 404), (FileExistsError, 409), (KeyError, 400), (ValueError, 400), (RuntimeError, 503), (ImportError, 503))


@dataclass
class Service:
    """Projects under a root folder; build puts a project's runtime together from its checked settings."""

    root: str
    build: Callable[[Config], Runtime]
    has_key: bool = True

    def __post_init__(self) -> None:
        self.store = Projects(self.root)

    def handle(self, method: str, path: str, body: dict | None = None) -> tuple[int, dict | None]:
        """Status and reply of a request; errors are replies with a detail."""
        path = path.split("?", 1)[0].rstrip("/") or "/"
        found = [(m, name, fit) for m, pattern, name in ROUTES if (fit := re.fullmatch(pattern, path))]
        if not found:
            return 404, {"detail": f"nothing at {path}"}
        for m, name, fit in found:
            if m == method:
                try:
                    return getattr(self, f"_{name}")(body or {}, **{k: unquote(v) for k, v in fit.groupdict().items()})
                except Exception as error:  # noqa: BLE001
                    code = next((c for kind, c in STATUSES if isinstance(error, kind)), 500)
                    return code, {"detail": str(error.args[0] if error.args else error)}
        return 405, {"detail": f"{method} isn't for {path}"}

    def _config(self, project: str) -> Config:
        return Config.of(self.store.load(project))

    def _shown(self, project: str) -> dict:
        c = self._config(project)
        return {"name": project, "config": asdict(c), "paths": {"output_dir": c.output_dir, "index_dir": c.index_dir}}

    def _chats_of(self, project: str) -> Chats:
        self.store.load(project)
        return Chats(f"{self.store.folder(project)}/chats")

    def _health(self, body: dict) -> tuple[int, dict]:
        return 200, {"status": "ok"}

    def _projects(self, body: dict) -> tuple[int, dict]:
        return 200, {"items": self.store.names()}

    def _save(self, project: str, settings: dict) -> None:
        folder = str(self.store.folder(project))
        self.store.save(project, Config.of(settings, output_dir=folder, index_dir=f"{folder}/index").stored())

    def _create(self, body: dict) -> tuple[int, dict]:
        name = body["name"]
        if self.store.exists(name):
            raise FileExistsError(f"there is a project {name!r}")
        self._save(name, body.get("config") or {})
        return 201, self._shown(name)

    def _project(self, body: dict, project: str) -> tuple[int, dict]:
        return 200, self._shown(project)

    def _update(self, body: dict, project: str) -> tuple[int, dict]:
        self._save(project, self.store.load(project) | {k: v for k, v in (body.get("config") or {}).items() if v is not None})
        return 200, self._shown(project)

    def _delete(self, body: dict, project: str) -> tuple[int, None]:
        self.store.load(project)
        self.store.delete(project)
        return 204, None

    def _status(self, body: dict, project: str) -> tuple[int, dict]:
        c = self._config(project)
        return 200, {"project": project, **status(self.build(c).spark, c.output_dir, self.has_key)}

    def _query(self, body: dict, project: str) -> tuple[int, dict]:
        question = body["question"]
        if not isinstance(question, str) or not question.strip():
            raise ValueError("question: give a text that isn't blank")
        work = self.build(self._config(project))
        ready = status(work.spark, work.config.output_dir, self.has_key)
        if not ready["query_ready"]:
            raise RuntimeError("; ".join(ready["blockers"]))
        return 200, asdict(work.query_result(question, body.get("memory_context") or "", bool(body.get("retry_on_empty"))))

    def _ingest(self, body: dict, project: str) -> tuple[int, dict]:
        return 200, {"status": "completed", "result": self.build(self._config(project)).run_ingest(body.get("mode") or "both", bool(body.get("force_crawl")))}

    def _chats(self, body: dict, project: str) -> tuple[int, dict]:
        return 200, {"items": self._chats_of(project).names()}

    def _chat(self, body: dict, project: str, chat: str) -> tuple[int, dict]:
        chats = self._chats_of(project)
        if chat not in chats.names():
            raise FileNotFoundError(f"no chat {chat!r}")
        return 200, chats.load(chat)

    def _save_chat(self, body: dict, project: str, chat: str) -> tuple[int, dict]:
        chats = self._chats_of(project)
        chats.save(chat, {**(chats.load(chat) if chat in chats.names() else {}), **{k: v for k, v in body.items() if v is not None}})
        return 200, chats.load(chat)

    def _delete_chat(self, body: dict, project: str, chat: str) -> tuple[int, None]:
        chats = self._chats_of(project)
        if chat not in chats.names():
            raise FileNotFoundError(f"no chat {chat!r}")
        chats.delete(chat)
        return 204, None


def server(service: Service, host: str = "127.0.0.1", port: int = 8000) -> HTTPServer:
    """A server that answers by the service; call its serve_forever()."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            try:
                body = json.loads(self.rfile.read(size)) if size else {}
                code, reply = service.handle(self.command, self.path, body) if isinstance(body, dict) else (400, {"detail": "the body is no JSON object"})
            except ValueError:
                code, reply = 400, {"detail": "the body is no JSON"}
            data = b"" if reply is None else json.dumps(reply).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_PUT = do_PATCH = do_DELETE = _answer

        def log_message(self, *args: object) -> None:
            pass

    return HTTPServer((host, port), Handler)
