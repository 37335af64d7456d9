"""The HTTP routes over ``Api``, on the standard library's server. Run: ``python -m cadenza.serve [port]``.

Sessions of Spark take calls from several threads; one request is one small job.
"""

from __future__ import annotations

import json
import sys
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from cadenza.api import MAX_MATCHES, Api, BadRequest, NotFound

# Limits of a request body, of a line in it (both in bytes), and of matches unless asked for.
MAX_BODY, MAX_LINE, MATCHES = 64 * 1024, 500, 200


def _word(q: dict) -> str:
    if not q.get("word"):
        raise BadRequest("Give word.")
    return q["word"]


def _limit(q: dict) -> int:
    if not q.get("limit", str(MATCHES)).isdigit():
        raise BadRequest("limit is a number.")
    return min(int(q.get("limit", MATCHES)), MAX_MATCHES)


def _lines(body: dict, cut: bool = True) -> list[str]:
    lines = body.get("lines")
    if not isinstance(lines, list) or not all(isinstance(x, str) for x in lines):
        raise BadRequest("Give lines, a list of strings.")
    return [x.encode()[:MAX_LINE].decode(errors="ignore") for x in lines] if cut else lines


#: (method, path) of every route; the function takes the Api and the query's or body's values.
ROUTES = {
    ("GET", "/health"): lambda api, q: api.health(),
    ("GET", "/compare"): lambda api, q: api.compare(q.get("word1", ""), q.get("word2", "")),
    ("GET", "/scan"): lambda api, q: api.scan(q.get("line1", ""), q.get("line2") or None),
    ("GET", "/syllables"): lambda api, q: api.lookup(_word(q)),
    ("POST", "/syllable-counts"): lambda api, b: {"lines": api.syllable_counts(_lines(b, cut=False))},
    ("GET", "/rhymes"): lambda api, q: api.rhymes(_word(q), _limit(q)),
    ("GET", "/rhymes/perfect"): lambda api, q: api.perfect_rhymes(_word(q)),
    ("GET", "/rhymes/slant"): lambda api, q: api.slant_rhymes(_word(q), _limit(q)),
    ("GET", "/rhymes/near"): lambda api, q: api.near_rhymes(_word(q), _limit(q)),
    ("POST", "/rhymemap"): lambda api, b: api.rhyme_map(_lines(b)),
    ("POST", "/document"): lambda api, b: api.document(_lines(b), b.get("stressMode") or "spoken", b.get("includeRhymeMap") is True),
}


def respond(api: Api, method: str, target: str, body: bytes = b"") -> tuple[int, object]:
    """Status and JSON value of a request."""
    at = urlsplit(target)
    run = ROUTES.get((method, at.path))
    if run is None:
        return (405 if any(p == at.path for _, p in ROUTES) else 404), {"error": f"no route {method} {at.path}"}
    if len(body) > MAX_BODY:
        return 413, {"error": f"a body has at most {MAX_BODY} bytes"}
    try:
        given = {k: v[-1] for k, v in parse_qs(at.query, keep_blank_values=True).items()} if method == "GET" else json.loads(body)
        if not isinstance(given, dict):
            raise BadRequest("Give a JSON object.")
        return 200, run(api, given)
    except (BadRequest, ValueError) as e:
        return 400, {"error": str(e)}
    except NotFound as e:
        return 404, {"error": str(e)}


def server(api: Api, host: str = "127.0.0.1", port: int = 8080) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            status, value = respond(api, self.command, self.path, self.rfile.read(min(size, MAX_BODY + 1)))
            raw = json.dumps(value).encode()
            self.send_response(status)
            for name, text in (("Content-Type", "application/json"), ("Content-Length", str(len(raw))), ("Access-Control-Allow-Origin", "*")):
                self.send_header(name, text)
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _answer

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)


def main() -> None:
    from pyspark.sql import SparkSession

    from cadenza.engine import Engine

    server(Api(Engine(SparkSession.builder.getOrCreate())), port=int(sys.argv[1]) if len(sys.argv) > 1 else 8080).serve_forever()


if __name__ == "__main__":
    main()
