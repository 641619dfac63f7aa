"""Every bar query against its SQL, or for its shape."""

import pytest
from conftest import rows

from tickloom.functions.storage import stored
from tickloom.plans import queries as q
from tickloom.plans import series_queries  # noqa: F401  registers its queries


@pytest.fixture(scope="module", autouse=True)
def shared_steps(spark, data):
    """Factors, signals, votes and back-tests are computed once and read by all queries of this module."""
    kept = {}

    def once(name):
        make = getattr(q, name)

        def get(s, d, **options):
            if options:
                return make(s, d, **options)
            if name not in kept:
                kept[name] = stored(make(s, d), name.strip("_"))
            return kept[name]

        return get

    with pytest.MonkeyPatch.context() as patch:
        for name in ("_factors", "_signals", "_strategies", "_results"):
            patch.setattr(q, name, once(name))
        yield


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_matches_sql(spark, data, duck, name):
    got, want = q.QUERIES[name](spark, data).toPandas(), duck.execute(q.ORACLES[name]).df()
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_runs(spark, data, name):
    df = q.QUERIES[name](spark, data)
    assert df.columns and df.count() > 0


def test_trade_log_has_the_position_open_at_the_end(spark, data):
    log, trades = (q.QUERIES[n](spark, data).toPandas() for n in ("backtest_trade_log", "backtest_trades"))
    forced = log[log.reason == "force_close"]
    assert len(log) == len(trades) and len(forced) and not forced.duplicated(["ticker", "strategy"]).any()


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())
