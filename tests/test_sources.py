"""Addresses that answer late, wrongly or not at all; filters that reach the HTTP source; the store of parsed documents."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from specloom import api
from specloom.sources import scan
from specloom.sources.race import race
from specloom.sources.store import ParseStore

from .test_parsing import MARKUP, TEXT


@pytest.fixture(scope="module")
def server():
    cut, asked = [], []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            kind, _, n = self.path.strip("/").partition("/")
            asked.append((kind, int(n)))
            if kind == "broken":
                return self.send_error(500)
            if kind == "moved":
                self.send_response(302)
                self.send_header("Location", f"/good/{n}")
                return self.end_headers()
            self.send_response(200)
            self.end_headers()
            if kind == "late":
                time.sleep(0.6)
            try:
                for _ in range(200 if kind == "slow" else 0):  # a drop now and then, 20 s in all
                    self.wfile.write(b" ")
                    self.wfile.flush()
                    time.sleep(0.1)
                self.wfile.write(b"nothing" if kind == "invalid" else f"RFC {n} from {kind}".encode())
            except OSError:
                cut.append(kind)

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.daemon_threads = True
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}", cut, asked
    s.shutdown()


def ask(url, *kinds, timeout=10.0):
    return race({k: f"{url}/{k}/7" for k in kinds}, timeout, lambda b: "RFC" in b)


def test_first_valid_wins_and_losers_are_cut_off(server):
    url, cut, _ = server
    began = time.monotonic()
    got = ask(url, "slow", "broken", "late", "invalid")
    assert (got.name, got.body) == ("late", "RFC 7 from late") and time.monotonic() - began < 3
    for _ in range(50):
        if "slow" in cut:
            break
        time.sleep(0.1)
    assert "slow" in cut and time.monotonic() - began < 9  # its 20 s weren't waited for, by the server either
    assert ask(url, "moved").body == "RFC 7 from good"


def test_one_deadline_for_all(server):
    url, _, _ = server
    began = time.monotonic()
    got = ask(url, "slow", "broken", "invalid", timeout=0.8)
    assert got.name is None and 0.7 < time.monotonic() - began < 3
    assert [e.split(":")[0] for e in got.errors] == ["slow", "broken", "invalid"] and "timed out" in got.errors[0] and "500" in got.errors[1] and got.errors[2] == "invalid: Invalid content"
    assert ask(url, "broken").errors[0].startswith("broken: ") and race({}, 1, bool).errors == []


def test_filters_reach_the_source(spark, server):
    url, _, asked = server
    scan.register(spark)
    found = spark.read.format("spec_http").option("kind", "text").option("timeout", "5").option("sources", json.dumps({"broken": url + "/broken/{n}", "good": url + "/good/{n}"}))
    asked.clear()
    rows = found.load().where("doc_id IN (11, 12, 13) AND body LIKE '%1%'").collect()
    assert {r.doc_id: (r.source_name, r.body, r.error) for r in rows} == {n: ("good", f"RFC {n} from good", None) for n in (11, 12, 13)}
    assert {n for _, n in asked} == {11, 12, 13}
    assert [r.doc_id for r in found.option("numbers", "12,14").load().where("doc_id IN (11, 12)").collect()] == [12]
    assert found.option("numbers", "12").load().where("doc_id = 99").collect() == []
    assert sorted(r.doc_id for r in found.option("numbers", "12,14").load().collect()) == [12, 14]
    reader = scan._HttpReader({"kind": "text"})
    with pytest.raises(ValueError, match="needs numbers"):
        reader.partitions()


def test_store_parses_only_what_changed(spark, tmp_path):
    parsed_rows = []

    def parse(raw):
        parsed_rows.append(sorted(r.doc_id for r in raw.select("doc_id").collect()))
        return api.parse(raw)

    def raw(*rows):
        return spark.createDataFrame(list(rows), "doc_id int, source string, body string, extra int")

    store = ParseStore(spark, f"file://{tmp_path}/store", parse)
    first = [(1, "text", TEXT, 0), (2, "xml", MARKUP, 0), (3, "text", None, 0), (4, "text", "4.  Introduction\n\nIt MAY.\n", 0)]
    store.update(raw(*first))
    assert parsed_rows.pop() == [1, 2, 3, 4]
    assert store.update(raw(*first, first[0], (None, "text", "x", 0))).count() == 0 and parsed_rows.pop() == []
    second = [first[0], first[1], (4, "text", "5.  Introduction\n\nIt MUST.\n", 0), (5, "text", TEXT, 0)]
    assert {r.doc_id: r.change for r in store.update(raw(*second)).collect()} == {3: "gone", 4: "changed", 5: "new"}
    assert parsed_rows.pop() == [4, 5]
    whole = api.parse(raw(*second))
    for name in ("docs", "sections", "blocks", "refs", "definitions"):
        want, got = getattr(whole, name), getattr(store.parsed(), name)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())), name
    # a generation that broke off before its list doesn't count, and is written anew
    before = sorted(map(str, store.parsed().sections.collect()))
    api.parse(raw((1, "text", "9.  Overview\n\nIt is.\n", 0))).sections.write.parquet(f"file://{tmp_path}/store/sections/generation=4")
    assert sorted(map(str, store.parsed().sections.collect())) == before
    assert store.update(raw(*second[:3], first[2])).count() == 2 and store.current().where("doc_id = 3").count() == 1
    assert store.parsed().sections.where("number = '9'").count() == 0
    store.update(raw(*second).limit(0))
    assert store.parsed().docs.count() == 0


def test_digest_tells_null_from_text(spark):
    from specloom.sources.store import digest

    rows = spark.createDataFrame([(None, None), (None, ""), ("", None), ("", ""), ("a", "b"), ("ab", "")], "s string, b string")
    assert rows.select(digest(F.col("s"), F.col("b")).alias("d")).distinct().count() == 6
