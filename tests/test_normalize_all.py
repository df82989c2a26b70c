"""Raw responses of all surfaces through the normalizer, twice."""

import json

from hindcast import cli
from hindcast.plans import pipeline
from hindcast.sources import schemas
from hindcast.sources.collect import Ledger


def test_normalize_all_fills_the_tables_once(spark, tmp_path, capsys):
    base, now = str(tmp_path), iter(range(1000, 2000))
    ledger = Ledger("x", lambda: float(next(now)))

    def land(collector, endpoint, body, status=200, parameters=None):
        ledger.collector = collector
        ledger.response("http://x", endpoint, parameters or {}, 0.0, status, {}, body if isinstance(body, bytes) else json.dumps(body).encode(), None)

    market = {"conditionId": "c1", "id": "m1", "question": "Will it?", "rules": "r", "createdAt": 10, "tokens": [{"token_id": "y", "outcome": "Yes"}, {"token_id": "n", "outcome": "No"}]}
    land("markets", "markets", [market, {"question": "no ids"}])
    land("markets", "markets", {"data": [market | {"closed": True, "resolved": True, "winningAsset": "y"}]})
    trade = {"conditionId": "c1", "asset": "n", "side": "buy", "size": 2, "price": 0.25, "timestamp": 500, "transactionHash": "t", "logIndex": 1, "proxyWallet": "w"}
    land("trades_taker", "trades", [trade, trade | {"price": 2}, trade | {"timestamp": 5}, {"asset": "n"}])
    land("trades", "trades", [trade], parameters={"takerOnly": "false"})
    land("trades", "trades", b"{broken")
    land("trades", "trades", [trade], status=500)
    land("books", "book", {"asset_id": "y", "bids": [{"price": "0.4", "size": "3"}, {"price": "x", "size": "1"}], "asks": [{"price": "0.5", "size": "1"}]})
    land("positions", "positions", [{"proxyWallet": "w", "asset": "n", "size": 2}, {"asset": "n"}])
    land("news:feed", "news", [{"headline": "H", "body": "B", "publishedAt": "2024-01-02T03:04:05Z"}])
    land("activity", "activity", [{"proxyWallet": "w", "conditionId": "c1", "timestamp": 5000, "type": "redeem", "asset": "y", "size": 2}, {"type": "TRADE"}])
    ledger.flush(spark, base)
    for _ in range(2):
        assert pipeline.normalize_all(spark, base, 1.0) == {"markets": 1, "tokens": 0, "executions": 3, "legs": 0, "books": 0, "positions": 1, "activity": 1}
    n = {r.table_name: (r.n, r.without_raw) for r in pipeline.audit(spark, base).collect()}
    for name, want in {"markets": 1, "outcome_tokens": 2, "contract_versions": 1, "market_status_versions": 2, "canonical_executions": 1, "actor_trade_legs": 1, "order_book_snapshots": 1, "position_snapshots": 1, "news_articles": 1, "position_events": 1}.items():
        assert n[name][0] == want, name
    e = schemas.read(spark, base, "canonical_executions").first()
    assert (e.positive_price, e.positive_side, e.notional, e.reconciliation_status) == (0.75, "SELL", 1.5, "complemented")
    p = schemas.read(spark, base, "position_events").first()
    assert (p.signed_token_change, p.collateral_change, p.accounting_confidence) == (-2.0, 2.0, "exact")
    assert cli.run(spark, ["init", base]) == 0 and cli.run(spark, ["queries"]) == 0 and "bars_grid" in capsys.readouterr().out
