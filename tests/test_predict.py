"""The seam for models: batches over rows, failures of single rows, the HTTP client."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from plumbline.operators import predict


def test_rounds_over_rows(monkeypatch):
    monkeypatch.setattr(predict, "BATCH", 3)
    sizes = []

    def model(questions, passages):
        sizes.append(len(questions))
        if any("bad" in p for p in passages):
            raise ValueError("bad passage")
        return [f"[{q}]" for q in questions]

    rows = [(["a", "b", "sum of #1 and #2"], "p"), (["x"], "bad"), (["y", "z of #1"], "p"), (["a of #2", "b of #1"], "p"), ([], "p"), (["unused", "last"], "p")]
    got = predict.answered_rows(rows, model)
    assert got[0] == (["[what is the a?]", "[what is the b?]", "[what is the sum of [what is the a?] and [what is the b?]?]"], None)
    assert got[1][0] is None and "bad passage" in got[1][1]
    assert got[2][0][1] == "[what is the z of [what is the y?]?]"
    assert [g[1] for g in got[3:5]] == ["cyclic or too long", "no steps"] and got[5][0] == [None, "[what is the last?]"]
    assert max(sizes) == 3


def test_http(spark, monkeypatch):
    seen, lines = [], set()

    class Service(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            said = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append(said["question"])
            lines.add(self.client_address)
            status = 500 if seen.count(said["question"]) == 1 and "flaky" in said["question"] else 404 if "never" in said["question"] else 200
            body = json.dumps({"best_span_str": said["passage"][:3]}).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        monkeypatch.setenv("PREDICTOR_URL", f"http://127.0.0.1:{server.server_port}/")
        model = predict.http()
        assert model(["one?", "flaky?"] * 20, ["Ann ran", "Rex sat"] * 20) == ["Ann", "Rex"] * 20
        assert len(lines) <= predict.AT_ONCE < len(seen)
        got = predict.answered_rows([(["the dog"], "Ann"), (["never"], "Rex")], model)
        assert got[0] == (["Ann"], None) and "404" in got[1][1]
    finally:
        server.shutdown()
