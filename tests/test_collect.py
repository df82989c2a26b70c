"""Collection against a transport that answers from memory."""

import json

import pytest

from hindcast.sources import collect as C
from hindcast.sources import schemas


class Clock:
    def __init__(self):
        self.now = 1000.0

    def __call__(self):
        self.now += 1
        return self.now


def client(answers, **kw):
    """A client whose transport gives the answers in turn: (status, body) or an error."""
    left = list(answers)

    def transport(url, parameters):
        x = left.pop(0) if len(left) > 1 else left[0]
        if isinstance(x, Exception):
            raise x
        return x[0], {"X-Y": "1"}, x[1] if isinstance(x[1], bytes) else json.dumps(x[1]).encode()

    return C.Client(C.Ledger("trades", Clock()), transport, "http://x", sleep=kw.pop("sleep", lambda s: None), **kw)


def test_every_attempt_is_kept_and_pauses_grow():
    pauses = []
    c = client([OSError("down"), (500, "no"), (200, [1])], sleep=pauses.append)
    assert c.get("trades", {"b": 1, "a": 2})[1] == [1] and pauses == [0.5, 1.0]
    assert [r["http_status"] for r in c.ledger.responses] == [None, 500, 200] and c.ledger.responses[0]["error_text"] == "down"
    assert c.ledger.responses[2]["canonical_params_json"] == '{"a":2,"b":1}' and c.ledger.responses[2]["response_headers_json"] == '{"x-y":"1"}'
    assert client([(404, "x")]).get("trades")[1] is None and client([(200, b"broken")]).get("x")[1] is None


def test_offset_walks_end_go_round_or_run_out():
    data = list(range(25))
    fetch = lambda p: (1, data[p["offset"] : p["offset"] + p["limit"]])
    w = C.by_offset(fetch, size=10)
    assert w.records == data and w.status == "complete" and [p["offset"] for _, _, p in w.pages] == [0, 10, 20]
    assert C.by_offset(fetch, size=10, enough=lambda page: 12 in page).records == data[:20]
    again = C.by_offset(lambda p: (1, data[:10]), size=10)
    assert again.status == "incomplete" and again.resume == {"offset": 10} and len(again.pages) == 1
    assert C.by_offset(fetch, size=5, most=2).resume == {"offset": 10}
    assert C.by_offset(lambda p: (1, None)).status == "failed"


def test_cursor_walks():
    pages = {None: (["a"], "1"), "1": (["b"], "2"), "2": (["c"], None)}
    fetch = lambda p: (1, pages[p.get("next_cursor")][0])
    follow = lambda page: {"a": "1", "b": "2", "c": None}[page[0]]
    assert C.by_cursor(fetch, follow).records == ["a", "b", "c"]
    assert C.by_cursor(fetch, lambda page: "1").status == "incomplete"


def test_backfill_marks_only_windows_whose_times_are_inside(spark, tmp_path):
    ledger = C.Ledger("trades", Clock())
    windows = list(C.plan_windows(0, 250, 100, 10))
    assert windows == [(140, 250), (40, 150), (0, 50)]
    walks = {(140, 250): C.Walk([(1, [{"timestamp": 150}], {})]), (40, 150): C.Walk([(1, [{"timestamp": 150}], {})]), (0, 50): C.Walk(status="failed", note="no")}
    got = C.run_backfill(ledger, "m", windows, lambda a, b: walks[a, b])
    assert list(got.values()) == ["complete", "incomplete", "incomplete"] and len(ledger.gaps) == 2
    ledger.finish()
    for _ in range(2):  # written twice, kept once
        ledger.windows = ledger.windows or {}
        ledger.flush(spark, str(tmp_path))
    assert schemas.read(spark, str(tmp_path), "collector_runs").count() == 1
    stored = schemas.read(spark, str(tmp_path), "backfill_windows")
    left = C.pending_windows(stored, spark.createDataFrame([("m", float(a), float(b)) for a, b in windows], "object_id string, window_start double, window_end double"))
    assert left.count() == 2


def test_a_failing_surface_leaves_a_gap_and_the_cycle_goes_on():
    ledger = C.Ledger("loop", Clock())

    def fails(a, b):
        raise ValueError("broken")

    loop = C.Loop(ledger, {"trades": (fails, "trades"), "books": (lambda a, b: "ok", None)}, ["m1", "m2"], every=10)
    loop.run(most=2, sleep=lambda s: None, seen=0.0)
    assert loop.failures == {"trades": 2} and loop.cycles == 2
    assert {g["surface"] for g in ledger.gaps.values()} == {"loop", "trades"} and len(ledger.gaps) == 6


def test_canonical_text():
    assert C.canonical({"b": float("nan"), "a": [1, float("inf"), "é"]}) == '{"a":[1,null,"é"],"b":null}'


def test_feed_items(spark, tmp_path):
    (tmp_path / "f.xml").write_text("""<rss><channel><item><title>One</title><link>http://a</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><description>&lt;b&gt;x&lt;/b&gt; y</description></item>
        <item><title>No date</title></item><item><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item></channel></rss>""")
    got = C.feed_items(spark, str(tmp_path / "f.xml")).collect()
    assert [(r.headline, r.url, r.published_at) for r in got] == [("One", "http://a", 1704164645.0)] and got[0].body == "x y"


@pytest.mark.parametrize("surface", ["trades", "books"])
def test_surfaces(surface):
    c = client([(200, {"data": [{"timestamp": 5}]})])
    w = C.collect(c, surface, "m", since=1.0)
    assert w.status == "complete" and w.records == [{"timestamp": 5}]
