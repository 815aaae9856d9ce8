"""Property checks: any well-formed trade page decodes to exactly the trades it holds."""

import datetime as dt
import json
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quayside.operators.decode import decode_agg_trades
from quayside.schemas import RESPONSE_DDL

price = st.decimals(min_value=Decimal("0.00000001"), max_value=Decimal("9999999999.99999999"), places=8,
                    allow_nan=False, allow_infinity=False)
trade = st.fixed_dictionaries({
    "a": st.integers(0, 2**62), "p": price, "q": price, "f": st.integers(0, 2**62), "l": st.integers(0, 2**62),
    "T": st.integers(0, 4102444800000), "m": st.booleans(), "M": st.booleans()})
pages = st.lists(st.tuples(st.sampled_from(["BTC", "ETH", "SOL"]), st.lists(trade, max_size=30)), min_size=1,
                 max_size=8)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(pages)
def test_trade_pages_round_trip(spark, pages):
    rows, want = [], []
    for i, (sym, items) in enumerate(pages):
        body = [dict(t, p=format(t["p"], "f"), q=format(t["q"], "f")) for t in items]
        rows.append(("aggTrades", sym, None, 200, None, None, json.dumps(body), dt.datetime(2024, 1, 1, 0, 0, i)))
        for t in items:
            want.append((sym, t["a"], t["p"], t["q"], t["f"], t["l"],
                         dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=t["T"]), t["m"], t["M"]))
    d = decode_agg_trades(spark.createDataFrame(rows, RESPONSE_DDL))
    got = [tuple(r) for r in d.good.select("symbol", "agg_trade_id", "price", "quantity", "first_trade_id",
                                          "last_trade_id", "trade_time", "is_buyer_maker", "is_best_match").collect()]
    assert sorted(got) == sorted(want)
    assert d.rejects.count() == 0
