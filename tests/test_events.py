"""Decoding of hand-written transactions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidebook.functions.wide import wide_text
from tidebook.operators import dimensions, events, liquidity
from tidebook.plans import warehouse
from tidebook.schemas import RAW_SEARCH_RESULT, TABLES, TX_LOG
from tidebook.sources import tx_log


def event(kind, **attributes):
    return {"type": kind, "attributes": [{"key": k, "value": v} for k, v in attributes.items()]}


def tick(t0="A", t1="B", tin="A", index="3", fee="1", reserves="5", **more):
    return event(
        "TickUpdate", module="dex", action="TickUpdate", TokenZero=t0, TokenOne=t1, TokenIn=tin, TickIndex=index,
        Fee=fee, Reserves=reserves, **more,
    )


def tx(position, height, found, code=0, time="2024-01-01T00:00:01.5Z"):
    return {
        "position": position, "height": height, "txhash": f"h{position}", "timestamp": time, "code": code, "info": "",
        "codespace": "", "gas_wanted": "1", "gas_used": "1", "events": found,
    }


LOG = [
    tx(0, 1, [event("message", action="/neutron.dex.MsgDeposit"), tick()]),
    tx(1, 1, [tick(reserves="9")], code=5),
    tx(
        2,
        1,
        [
            tick(tin="B", index="-2", fee="-1", reserves=""),
            event("message", action="/neutron.dex.MsgPlaceLimitOrder"),
            event(
                "message", module="dex", action="PlaceLimitOrder", Creator="c", Receiver="r", TokenZero="A",
                TokenOne="B", TokenIn="B", AmountIn="7", LimitTick="1", OrderType="t", Shares="2", TrancheKey="k",
            ),
            event("message", action="/else.MsgOther"),
            tick(t0="B", t1="C", tin="C", fee="abc", reserves="1" + "0" * 38),
        ],
    ),
    tx(3, 4, [event("transfer", module="bank", action="send")], time="2024-01-01T00:00:09Z"),
    tx(4, 5, [tick(t0="B", t1="A", tin="B"), event("other", Token="Z")], time="2024-01-01T00:00:10Z"),
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([tuple(r[f] for f in TX_LOG.names) for r in LOG], TX_LOG)


@pytest.fixture(scope="module")
def loaded(log):
    return events.load_events(events.tx_index_in_block(events.valid_txs(log)))


def test_tx_index_skips_failed_transactions(log):
    rows = events.load_txs(log).collect()
    assert sorted((r["height"], r["tx_index"], r["hash"]) for r in rows) == [
        (1, 0, "h0"), (1, 1, "h2"), (4, 0, "h3"), (5, 0, "h4"),
    ]
    assert {r["data"] for r in rows} == {None}


def test_messages(loaded):
    rows = {(r["height"], r["tx_index"], r["event_index"]): r for r in loaded.collect()}
    assert rows[(1, 0, 1)]["msg_type"] == 1
    assert rows[(1, 0, 1)]["msg_seq"] == rows[(1, 0, 0)]["seq"]
    assert rows[(1, 1, 0)]["msg_seq"] is None
    assert rows[(1, 1, 2)]["msg_type"] == 3
    assert rows[(1, 1, 4)]["msg_type"] is None
    assert rows[(1, 1, 4)]["msg_seq"] == rows[(1, 1, 3)]["seq"]


def test_more_events_than_any_index_bits(spark):
    many = [tick(index=str(i), reserves=str(i + 1)) for i in range(5000)]
    log = [
        tx(0, 7, [event("message", action="/neutron.dex.MsgDeposit"), *many]),
        tx(1, 7, []),
        tx(2, 7, [tick(index="9", reserves="9")]),
        tx(3, 8, None),
    ]
    frame = spark.createDataFrame([tuple(r[f] for f in TX_LOG.names) for r in log], TX_LOG)
    rows = sorted(events.load_events(events.valid_txs(frame)).collect(), key=lambda r: r["seq"])
    assert [r["seq"] - 7 * 2**32 for r in rows] == list(range(5002))
    assert [(r["tx_index"], r["event_index"]) for r in rows] == [(0, i) for i in range(5001)] + [(2, 0)]
    assert [r["msg_seq"] for r in rows] == [7 * 2**32] * 5001 + [None]
    assert sorted((r["tx_index"], r["height"]) for r in events.load_txs(frame).collect()) == [(0, 7), (0, 8), (1, 7), (2, 7)]


def test_tick_updates(loaded):
    rows = sorted(events.event_tick_update(loaded).collect(), key=lambda r: r["seq"])
    assert [(r["token0"], r["tick"], r["fee"], r["reserves"]) for r in rows] == [
        ("A", 3, 1, 5), ("A", -2, None, 0), ("B", 3, 1, 5),
    ]
    assert events.rejected_tick_updates(loaded).count() == 0
    large = events.wide_tick_updates(loaded).select("fee", wide_text(F.col("reserves")).alias("text")).collect()
    assert [(r["fee"], len(r["text"])) for r in large] == [(None, 39)]


def test_place_order_derives_the_other_token(loaded):
    row = events.event_place_order(loaded).first()
    assert (row["token_in"], row["token_out"], row["amount_in"], row["msg_type"]) == ("B", "A", 7, 3)
    assert events.event_deposit(loaded).count() == 0
    assert events.event_withdraw(loaded).count() == 0


def test_routes(loaded):
    routed = events.route_by_action(events.dex_events(loaded))
    assert {k: v.count() for k, v in routed.items()} == {
        "DepositLP": 0, "WithdrawLP": 0, "PlaceLimitOrder": 1, "TickUpdate": 4,
    }


def test_dictionaries(spark, loaded):
    tokens = sorted((r["id"], r["token"]) for r in dimensions.first_seen_tokens(loaded, 2).collect())
    assert tokens == [(1, "A"), (2, "B"), (3, "C"), (4, "Z")]
    pairs = sorted((r["id"], r["token0"], r["token1"]) for r in dimensions.first_seen_pairs(loaded, 2).collect())
    assert pairs == [(1, "A", "B"), (2, "B", "C")]
    assert {r["token"] for r in dimensions.distinct_tokens(loaded).collect()} == {"A", "B", "C", "Z"}
    known = spark.createDataFrame([(1, "A"), (2, "B")], "id long, token string")
    seen = spark.createDataFrame(
        [("B", 5, 1), ("D", 9, 3), ("C", 7, 2)], "token string, first_seq long, height long"
    )
    grown = dimensions.add_new_entries(known, seen, ["token"])
    assert sorted((r["id"], r["token"]) for r in grown.collect()) == [(1, "A"), (2, "B"), (3, "C"), (4, "D")]


def test_pair_flags_match_either_order(spark, loaded):
    pairs = spark.createDataFrame([(9, "B", "A")], "id long, token0 string, token1 string")
    flagged = events.pair_action_flags(loaded, pairs)
    assert flagged.count() == loaded.count()
    rows = [r for r in flagged.collect() if r["pair_swap"]]
    assert [(r["pair_swap"], r["pair_deposit"], r["pair_withdraw"]) for r in rows] == [(9, 0, 0)]


def test_orientation(spark):
    pairs = spark.createDataFrame([(1, "A", "B")], "id long, token0 string, token1 string")
    asked = spark.createDataFrame([("A", "B"), ("B", "A"), ("A", "C")], "token_a string, token_b string")
    found = {(r["token_a"], r["token_b"]): r["inverted"] for r in dimensions.pair_orientation(asked, pairs).collect()}
    assert found == {("A", "B"): False, ("B", "A"): True, ("A", "C"): None}
    assert dimensions.resolve_pair_unsorted(asked, pairs).count() == 2


def test_blocks(log):
    rows = {r["height"]: r["time_unix"] % 60 for r in events.load_blocks(events.valid_txs(log)).collect()}
    assert rows == {1: 2, 4: 9, 5: 10}


def test_read_json_log(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text("\n".join(json.dumps(r) for r in LOG))
    found = tx_log.read_tx_log(spark, str(path), from_height=1, format="json")
    # only transactions with a message event of the module
    assert [r["txhash"] for r in found.collect()] == ["h2"]
    assert tx_log.read_tx_log(spark, str(path), 4, module=None, format="json").count() == 2


def test_normalise(spark):
    raw = spark.createDataFrame(
        [(0, "h", "12", (0, "i", "c", "1", "2", [("message", [("a", "b")])]))], RAW_SEARCH_RESULT
    )
    headers = spark.createDataFrame([(12, "t")], "height long, time string")
    row = tx_log.read_headers_join(tx_log.normalise_tx(raw), headers).first()
    assert (row["height"], row["txhash"], row["timestamp"], row["gas_used"]) == (12, "h", "t", "2")


def test_appending_blocks_gives_the_warehouse_of_the_whole_log(spark, tmp_path):
    rnd = random.Random(8)
    rows = []
    for position in range(60):
        kinds = [event("message", action=f"/neutron.dex.Msg{rnd.choice(['Deposit', 'PlaceLimitOrder'])}")]
        for _ in range(rnd.randint(0, 4)):
            pair = rnd.choice([("A", "B"), ("B", "A"), ("C", "D"), (f"T{position // 9}", "A")])
            kinds.append(tick(*pair, tin=rnd.choice(pair), index=str(rnd.randint(-2, 2)), fee=rnd.choice(["1", "5"]),
                              reserves=str(rnd.choice([0, 0, 3, 7, 10**30, 10**45 + 1]))))
        kinds.append(event("message", module="dex", action="PlaceLimitOrder", TokenZero=pair[0] if len(kinds) > 1 else "A",
                           TokenOne=pair[1] if len(kinds) > 1 else "B", TokenIn="A", AmountIn="7"))
        rows.append(tx(position, 1 + position // 3, kinds, code=5 * (position % 7 == 0), time=f"2024-01-01T00:{position // 3:02d}:00Z"))
    log = spark.createDataFrame([tuple(r[f] for f in TX_LOG.names) for r in rows], TX_LOG)
    whole = warehouse.store(log, str(tmp_path / "whole"), span=4, blocks=3)
    folder = str(tmp_path / "parts")
    warehouse.store(log.where("height <= 6"), folder, span=4, blocks=3)
    warehouse.append(log.where("height <= 13"), folder, span=4)
    opened = warehouse.load(spark, folder)
    before = {name: table.count() for name, table in opened.tables().items()}

    def ends_at(last):
        def wrote(name):
            if name == last:
                raise KeyboardInterrupt(name)

        with pytest.raises(KeyboardInterrupt):
            warehouse.append(log, folder, span=4, wrote=wrote)

    for last in ("reserves", "carried_reserves"):
        ends_at(last)
    assert {name: table.count() for name, table in warehouse.load(spark, folder).tables().items()} == before
    parts = warehouse.append(log, folder, span=4)
    assert {name: table.count() for name, table in opened.tables().items()} == before
    parts = warehouse.compact(spark, folder)
    for to, since in ((2, 0), (11, 4), (99, 0)):
        plain, quick = whole.tick_state.drop("height_range"), parts.tick_state_at(to, since)
        assert sorted(map(str, liquidity.tick_liquidity(quick, since, to).collect())) == sorted(
            map(str, liquidity.tick_liquidity(plain, since, to).collect())
        )
        plain, quick = whole.reserves.drop("height_range"), parts.reserves_at(to)
        assert sorted(map(str, liquidity.latest_reserves_per_pair(quick, 0, to).collect())) == sorted(
            map(str, liquidity.latest_reserves_per_pair(plain, 0, to).collect())
        )
    for name, table in whole.tables().items():
        found = getattr(parts, name).select(table.columns)
        assert sorted(map(str, found.collect())) == sorted(map(str, table.collect())), name
    assert whole.price.count() > 20 and whole.events.where("pair_swap > 0").count() > 10


def test_store_and_load_the_warehouse(spark, log, tmp_path):
    stored = warehouse.store(log, str(tmp_path / "house"))
    for name, table in stored.tables().items():
        stored_columns = [c.split()[0] for c in TABLES[name].split(", ")]
        assert [c for c in table.columns if c != "height_range" or c in stored_columns] == stored_columns, name
    assert warehouse.load(spark, str(tmp_path / "house"), from_height=4).block.count() == 1
    assert stored.tx_msg.count() == 3
    assert stored.tx_msg_type.count() == 3
    # the oversized update is counted like all others
    assert stored.rejected.count() == 0
    assert stored.tick_update.where("reserves is null and length(reserves_wide) = 39").count() == 1


def test_amounts_of_any_size_go_through_all_state(spark, tmp_path):
    rnd = random.Random(4)
    sizes = [0, 3, 10**29, 10**38 - 1, 10**38, 10**45 + 1, 2**256 - 1]
    last, changes, totals, rows = {}, [], {}, []
    for height in range(1, 25):
        found = [event("message", module="dex", action="DepositLP", TokenZero="A", TokenOne="B", TickIndex="1", Fee="1",
                       ReservesZeroDeposited=str(10**50 + height), ReservesOneDeposited="5", SharesMinted="x")]
        for _ in range(3):
            pair = rnd.choice([("A", "B"), ("C", "D")])  # one pair never has a large amount
            value = rnd.choice(sizes if pair == ("A", "B") else sizes[:3])
            index = rnd.randint(0, 2)
            found.append(tick(*pair, tin=pair[0], index=str(index), reserves=str(value)))
            before = last.get((*pair, index), 0)
            if value != before:
                changes.append((height, *pair, index, value, value - before))
            last[*pair, index] = value
            totals[pair] = sum(v for k, v in last.items() if k[:2] == pair)
        rows.append(tx(height, height, found))
    log = spark.createDataFrame([tuple(r[f] for f in TX_LOG.names) for r in rows], TX_LOG)
    folder = str(tmp_path / "house")
    warehouse.store(log.where("height <= 9"), folder, span=4, blocks=3)
    house = warehouse.append(log, folder, span=4)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.col(f"{c}_wide"))
    found = house.tick_update.select("height", "token0", "token1", "tick", text("reserves"), text("reserves_diff"))
    assert sorted(map(tuple, found.collect())) == sorted((h, a, b, i, str(v), str(d)) for h, a, b, i, v, d in changes)
    newest = house.reserves.groupBy("token0", "token1").agg(F.max_by("reserves0", "seq")).collect()
    assert {(r[0], r[1]): r[2] for r in newest} == {k: float(v) for k, v in totals.items()}
    carried = warehouse.carried(spark, folder, warehouse.versions.newest_version(spark, folder))["carried_totals"]
    assert {(r[0], r[1]): r[2] for r in carried.select("token0", "token1", text("reserves0")).collect()} == {
        k: str(v) for k, v in totals.items()
    }
    live = {k: v for k, v in last.items() if v}
    best = house.price.groupBy("token0", "token1").agg(F.max_by("best0", "seq")).collect()
    assert {(r[0], r[1]): r[2] for r in best} == {p: -min((k[2] for k in live if k[:2] == p), default=0) for p in totals}
    shown = liquidity.tick_liquidity(house.tick_state_at(99), 0, 99).collect()
    assert {(r["token0"], r["token1"], -r["tick"]): r["reserves"] for r in shown} == {
        k: pytest.approx(v, rel=0.01) for k, v in live.items()
    }
    deposits = house.deposit.select("height", "deposited0", "deposited0_wide", "deposited1", "shares_wide").collect()
    assert sorted(map(tuple, deposits)) == [(h, None, str(10**50 + h), 5, None) for h in range(1, 25)]
    assert house.rejected.count() == 0
