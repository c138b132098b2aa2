import json
import math
import random

from pyspark.sql import functions as F

from evalmill.operators import actions, battles, conversation, relational, retrieval, scoring, synthesis
from evalmill.operators.simulated import SERVICES
from evalmill.sources.tables import rating_file


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_percentage_weighted(spark):
    full = spark.createDataFrame([("m", c, w, a, 1) for c, w, a in zip("abcde", (10, 10, 10, 30, 40), (1.0, 0.0, 0.0, 0.0, 0.0), strict=True)], "model string, category string, weight int, accuracy double, total_count long")
    assert math.isclose(scoring.percentage_weighted(full, "model").first()["accuracy"], 0.1)


def test_missing_member_counts_as_zero_and_shows_null(spark):
    scores = spark.createDataFrame([("m", "a", 1.0, 4)], "model string, category string, accuracy double, total_count long")
    members = spark.createDataFrame([("a",), ("b",)], "category string")
    r = scoring.unweighted(scoring.with_members(scores, members, "model", "category"), "model").first()
    assert r["accuracy"] == 0.5 and r["display_accuracy"] is None and r["total_count"] == 4


def test_upsert_and_multiset(spark):
    old = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string")
    new = spark.createDataFrame([(2, "n"), (3, "n")], "k int, v string")
    assert rows(relational.upsert(old, new, "k"), "k", "v") == [(1, "o"), (2, "n"), (3, "n")]
    have = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "k int, i string")
    need = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "a")], "k int, i string")
    assert rows(relational.multiset_contains(have, need, "k", "i"), "k", "contained") == [(1, True), (2, False)]


def test_global_position(spark):
    x = list(range(500))
    random.Random(1).shuffle(x)
    df = spark.createDataFrame([(i,) for i in x], "i int").repartition(5)
    assert rows(relational.global_position(df, ["i"], "p", 7), "i", "p") == [(i, i + 1) for i in range(500)]


def test_dag_levels(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("x",), ("y",)], "id string")
    edges = spark.createDataFrame([("b", "a"), ("c", "b"), ("c", "a"), ("x", "y"), ("y", "x")], "id string, depends_on string")
    assert rows(relational.dag_levels(nodes, edges), "id", "level") == [("a", 0), ("b", 1), ("c", 2)]


def test_dag_levels_of_long_chains(spark):
    edges = [(i, i - 1) for i in range(1, 200)] + [(200, 199), (200, 3), (201, 200), (301, 300), (300, 301), (302, 300), (202, 302)]
    nodes = [*range(202), 300, 301, 302, 202]
    random.Random(3).shuffle(edges)
    got = relational.dag_levels(spark.createDataFrame([(i,) for i in nodes], "id long"), spark.createDataFrame(edges, "id long, depends_on long"))
    assert rows(got, "id", "level") == [(i, i) for i in range(202)]


def test_elo(spark):
    assert battles.elo_fold([("a", "b", battles.A)]) == {"a": 1002.0, "b": 998.0}
    rng = random.Random(2)
    b = spark.createDataFrame([(i, *rng.sample("abcd", 2), rng.choice([battles.A, battles.B, battles.TIE]), "c") for i in range(200)], "ord long, a string, b string, rating string, category string")
    r = {x["name"]: x["rating"] for x in battles.online_elo(b, "category").collect()}
    assert math.isclose(sum(r.values()), 4000)
    want = battles.elo_fold([(x["a"], x["b"], x["rating"]) for x in b.orderBy("ord").collect()])
    assert all(math.isclose(r[k], want[k]) for k in want)


def test_bradley_terry_of_two(spark):
    w = spark.createDataFrame([("a", "b", 30), ("b", "a", 10)], "a string, b string, points long")
    r = {x["name"]: x["rating"] for x in battles.bradley_terry(w, None).collect()}
    assert math.isclose(r["a"] - r["b"], 400 * math.log(3), rel_tol=1e-6)


def test_bm25_does_not_depend_on_partitions(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30)))) for i in range(60)], "doc_id int, text string")
    q = spark.createDataFrame([(1, "a b b"), (2, "h c")], "item_id int, text string")
    t = lambda c: F.split(c, " ")
    a, b = (rows(retrieval.bm25(d, q, "doc_id", "item_id", t), "query", "rank", "doc", "score") for d in (docs.repartition(1), docs.repartition(7)))
    assert a == b and len(a) == 20


def test_conversation_folds(spark):
    c = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d")], "conv_id int, turn int, role string, text string")
    assert rows(conversation.merge_runs(c), "turn", "text") == [(0, "a\n\nb"), (2, "c"), (3, "d")]
    assert rows(conversation.last_of(c, "system", "none"), "text") == [("none",)]
    assert rows(conversation.reply_pairs(c), "text", "reply") == [("b", "c")]


def test_replay(spark):
    calls = spark.createDataFrame([("s", "trading", "trading_login", '{"username": "u", "password": "p"}', 0), ("s", "trading", "place_order", '{"order_type": "Buy", "symbol": "AAPL", "price": 10, "amount": 2}', 1), ("s", "trading", "cancel_order", '{"order_id": 12446}', 2), ("s", "trading", "__init__", "{}", 3), ("t", "tickets", "create_ticket", '{"title": "a", "priority": 9}', 1)], "session string, service string, method string, args string, ord int")
    got = actions.replay(calls).collect()
    last = {r["session"]: r for r in got if r["state"]}
    results = {(r["session"], r["ord"]): r["result"] for r in got}
    assert '"Cancelled"' in last["s"]["state"] and "no operation __init__" in results["s", 3] and "not logged in" in results["t", 1]


def test_rating_file(spark):
    lines = spark.createDataFrame(list(enumerate(["Search:", "x: 1200.5", "y z: 900.25", "", "Math:", "x: 1.5"])), "line_no int, value string")
    assert rows(rating_file(lines), "category", "name", "rating") == [("Math", "x", 1.5), ("Search", "x", 1200.5), ("Search", "y z", 900.25)]


def test_services(spark):
    from evalmill.operators import services

    got = spark.range(1).select(services.greedy_match(F.expr("array(array(true, true), array(true, false), array(false, true))")).alias("m"), services.greedy_match(F.expr("cast(array() as array<array<boolean>>)")).alias("e")).first()
    assert got.m == [0, -1, 1] and got.e == []
    got = spark.sql("SELECT array('a', 'b', 'c') AS x, array('a', 'z') AS y, cast(array() AS array<string>) AS n").select(services.line_differences(F.col("x"), F.col("y")).alias("d"), services.line_differences(F.col("x"), F.col("n")).alias("none")).first()
    assert [tuple(r) for r in got.d] == [(1, "b", "z")] and got.none == []
    rows = spark.createDataFrame([(None,), ("a_b1",), ("a__b",), ("ab\n",), ("1a",)], "k string").select(services.is_memory_key(F.col("k"))).collect()
    assert [r[0] for r in rows] == [False, True, False, False, False]
    d = spark.createDataFrame([(1, None, ["Red"]), (2, "reddish", None), (3, "blue", [])], "id int, t string, tags array<string>")
    assert sorted(r.id for r in services.search(d, "RED", "t", "tags").collect()) == [1, 2]
    assert spark.range(1).select(services.success_share(F.lit(0), F.lit(None).cast("int"))).first()[0] == "N/A"


def sessions(spark, rows_):
    return spark.createDataFrame(rows_, "session string, turn long, side string, ord long, service string, method string, args string")


def run_all(service, calls, **scenario):
    s = SERVICES[service].start(scenario)
    return s, [SERVICES[service].call(s, m, a) for m, a in calls]


def test_file_system_service():
    tree = {"root": {"john": {"type": "directory", "contents": {"a.txt": {"type": "file", "content": "b x\na y\n"}, "d": {"type": "directory", "contents": {}}}}}}
    s, out = run_all("files", [("pwd", {}), ("sort", {"file_name": "a.txt"}), ("mv", {"source": "a.txt", "destination": "d"}), ("rmdir", {"dir_name": "d"}), ("cd", {"folder": "d"}), ("grep", {"file_name": "a.txt", "pattern": "y"}), ("echo", {"content": "z", "file_name": "new"}), ("touch", {"file_name": "a/b"}), ("wc", {"file_name": "a.txt", "mode": "w"}), ("cd", {"folder": ".."}), ("find", {"name": "a"}), ("cd", {"folder": ".."}), ("du", {}), ("cp", {"source": "d", "destination": "e"}), ("rm", {"file_name": "d"}), ("nothing", {}), ("ls", {"b": 1})], **tree)
    assert out[0] == {"current_working_directory": "/john"} and out[1] == {"sorted_content": "a y\nb x"}
    assert out[2] == {"result": "'a.txt' moved to 'd/a.txt'"} and out[4] == {"current_working_directory": "d"} and out[5] == {"matching_lines": ["a y"]}
    assert out[8] == {"count": 4, "type": "words"} and out[9] == {} and out[10] == {"matches": ["./d/a.txt"]} and out[12] == {"disk_usage": "8 bytes"}
    assert all("error" in out[i] for i in (3, 6, 7, 11, 15, 16))
    assert list(s["root"]["contents"]) == ["e"] and list(s["root"]["contents"]["e"]["contents"]) == ["a.txt"]


def test_trading_travel_and_vehicle_services():
    buy = {"order_type": "Buy", "symbol": "AAPL", "price": 10.0, "amount": 3}
    s, out = run_all("trading", [("place_order", buy), ("trading_login", {"username": "u", "password": "p"}), ("place_order", buy), ("place_order", {**buy, "amount": 10**6}), ("cancel_order", {"order_id": 12345}), ("cancel_order", {"order_id": 12446}), ("withdraw_funds", {"amount": 1}), ("fund_account", {"amount": 5}), ("add_to_watchlist", {"stock": "ZETA"}), ("filter_stocks_by_price", {"stocks": ["ZETA", "QUAS", "X"], "min_price": 0, "max_price": 100})])
    assert [("error" in o) for o in out] == [True, False, False, True, True, False, True, False, False, False]
    assert out[2]["status"] == "Pending" and s["orders"][12446]["status"] == "Cancelled" and s["account_info"]["balance"] == 10005.0
    assert out[8] == {"watchlist": ["NVDA", "ZETA"]} and out[9] == {"filtered_stocks": ["ZETA", "X"]}
    s, out = run_all("travel", [("get_flight_cost", {"travel_from": "SFO", "travel_to": "LAX", "travel_date": "2024-11-15", "travel_class": "first"}), ("get_flight_cost", {"travel_from": "LAX", "travel_to": "CDG", "travel_date": "2024-11-15", "travel_class": "first"}), ("compute_exchange_rate", {"base_currency": "EUR", "target_currency": "USD", "value": 8}), ("get_nearest_airport_by_city", {"location": "Rome"})])
    assert out[0] == {"travel_cost_list": [2000.0]} and "error" in out[1] and out[2] == {"exchanged_value": 10.0} and out[3] == {"nearest_airport": "CIA"}
    card = {"credit_card_list": {"1": {"balance": 1000}}, "access_token": "t", "token_expires_in": 2}
    s, out = run_all("travel", [("book_flight", {"access_token": "t", "card_id": "1", "travel_date": "2024-11-16", "travel_from": "SFO", "travel_to": "LAX", "travel_class": "economy"})], **card)
    assert s["credit_card_list"]["1"]["balance"] == 800 and out[0]["booking_status"]
    _, again = run_all("travel", [("cancel_booking", {"access_token": "t", "booking_id": out[0]["booking_id"]})], **{**card, "booking_record": s["booking_record"]})
    assert again == [{"cancel_status": True}]
    s, out = run_all("vehicle", [("startEngine", {"ignitionMode": "START"}), ("lockDoors", {"unlock": False, "door": ["driver", "passenger", "rear_left", "rear_right"]}), ("pressBrakePedal", {"pedalPosition": 1}), ("startEngine", {"ignitionMode": "START"}), ("setCruiseControl", {"speed": 63, "activate": True, "distanceToNextVehicle": 9}), ("estimate_distance", {"cityA": "74532", "cityB": "83214"}), ("startEngine", {"ignitionMode": "STOP"})])
    assert "error" in out[0] and out[1]["remainingUnlockedDoors"] == 0 and out[3]["engineState"] == "running" and "error" in out[4] and out[5] == {"distance": 750.0} and "error" in out[6] and s["engineState"] == "stopped"


def test_message_post_ticket_memory_and_maths_services():
    s, out = run_all("messages", [("send_message", {"receiver_id": "USR002", "message": "x"}), ("message_login", {"user_id": "USR001"}), ("send_message", {"receiver_id": "USR002", "message": "x"}), ("delete_message", {"receiver_id": "USR002"}), ("add_contact", {"user_name": "Eve"}), ("get_message_stats", {})])
    assert "error" in out[0] and out[2]["sent_status"] and out[4]["user_id"] == "USR005" and out[5] == {"stats": {"received_count": 3, "total_contacts": 3}}
    s, out = run_all("posts", [("authenticate_twitter", {"username": "john", "password": "john123"}), ("post_tweet", {"content": "Hi", "tags": ["#a"]}), ("retweet", {"tweet_id": 0}), ("retweet", {"tweet_id": 0}), ("search_tweets", {"keyword": "#A"}), ("follow_user", {"username_to_follow": "bob"})])
    assert out[2] != out[3] and len(out[4]) == 1 and out[5] == {"follow_status": False}
    s, out = run_all("tickets", [("ticket_login", {"username": "u", "password": "p"}), ("create_ticket", {"title": "t", "priority": 6}), ("create_ticket", {"title": "t"}), ("edit_ticket", {"ticket_id": 1, "updates": {"title": None, "priority": 3}}), ("close_ticket", {"ticket_id": 1}), ("close_ticket", {"ticket_id": 1}), ("get_user_tickets", {"status": "closed"})])
    assert "error" in out[1] and "error" in out[5] and out[6] == [{"id": 1, "title": "t", "description": "", "status": "Closed", "priority": 3, "created_by": "u"}]
    s, out = run_all("memory_kv", [("core_memory_add", {"key": f"key_{i}", "value": "v"}) for i in range(8)] + [("core_memory_key_search", {"query": "key 3", "k": 1}), ("archival_memory_add", {"key": "Bad", "value": ""})])
    assert "error" in out[7] and out[8]["ranked_results"][0][1] == "key_3" and "error" in out[9]
    s, out = run_all("memory_vector", [("core_memory_add", {"text": "red fox"}), ("core_memory_add", {"text": "blue sky"}), ("core_memory_retrieve", {"query": "sky", "top_k": 1})])
    assert out[2][0]["id"] == 1
    _, out = run_all("maths", [("square_root", {"number": 2, "precision": 5}), ("divide", {"a": 1, "b": 0}), ("imperial_si_conversion", {"value": 100, "unit_in": "celsius", "unit_out": "fahrenheit"}), ("logarithm", {"value": 8, "base": 2, "precision": 20}), ("mean", {"numbers": []})])
    assert str(out[0]["result"]) == "1.4142" and "error" in out[1] and out[2] == {"result": 212.0} and float(out[3]["result"]) == 3.0 and "error" in out[4]


def test_turn_checks(spark):
    touch = lambda n: json.dumps({"file_name": n})
    scenario = json.dumps({"root": {"r": {"type": "directory", "contents": {}}}})

    def session(key, *turns):
        yield key, None, None, 0, "files", "load", scenario
        for t, (model, truth) in enumerate(turns):
            for side, calls in (("model", model), ("truth", truth)):
                if calls == []:
                    yield key, t, side, 0, "files", None, None
                for i, (m, a) in enumerate(calls or []):
                    yield key, t, side, i, "files", m, a

    a, b, ls = ("touch", touch("a")), ("touch", touch("b")), ("ls", None)
    data = [*session("same", ([a, b, ls], [b, a, ls]), ([ls], [])), *session("good", ([a, ls, ls], [a]), ([ls], [ls])), *session("state", ([a], [b])), *session("results", ([a], [a, ls])), *session("silent", ([], [a])), *session("cut", ([a], [a]), (None, [a])), *session("junk", ([("touch", "[")], [a]))]
    assert rows(actions.check_turns(sessions(spark, data).repartition(5)), "session", "error_type", "turn") == [("cut", "multi_turn:force_terminated", None), ("good", None, None), ("junk", "multi_turn:instance_state_mismatch", 0), ("results", "multi_turn:execution_response_mismatch", 0), ("same", "multi_turn:execution_response_mismatch", 0), ("silent", "multi_turn:empty_turn_model_response", 0), ("state", "multi_turn:instance_state_mismatch", 0)]
    assert actions.check_turns(sessions(spark, [])).count() == 0


def test_replay_rows_nulls_and_unknown_names(spark):
    data = [("s", None, None, 1, "maths", "add", '{"a": 1, "b": 2}'), ("s", None, None, 2, "maths", None, None), (None, None, None, None, "nowhere", "x", None), ("s", None, None, 0, "maths", "add", "nonsense")]
    got = actions.replay(sessions(spark, data)).collect()
    assert sorted((r.session or "", r.ord, r.result, r.state) for r in got) == [("", -1, '{"error": "no service nowhere"}', None), ("s", 0, '{"error": "arguments aren\'t a JSON object"}', None), ("s", 1, '{"result": 3}', None), ("s", 2, '{"error": "no operation "}', "{}")]


def test_undo_log(spark):
    log = spark.createDataFrame([("s", "a", 0, "u0", False), ("s", "a", 1, "u1", True), ("s", "a", 2, "u2", True), ("s", "b", 3, "v", None)], "s string, call string, at int, undo string, ok boolean")
    got = actions.first_true(log, "s", "call", F.col("ok"), "at").collect()
    assert sorted((r.call, r.success or "", tuple(r.failures)) for r in got) == [("a", "u1", ("u0",)), ("b", "", ("v",))]


def test_every_question_gets_its_passages(spark):
    q = spark.createDataFrame([(i, i) for i in range(60)], "qid long, oracle long")
    for n in (2, 5, 200):
        pool = spark.createDataFrame([(i, f"p{i}") for i in range(n)], "cid long, passage string")
        got = rows(synthesis.distractors(q, pool, 4, "s"), "qid", "pos", "cid")
        for i in range(60):
            mine = [(p, c) for j, p, c in got if j == i]
            others = set(range(n)) - {i}
            assert [p for p, _ in mine] == list(range(min(4, len(others)))) and {c for _, c in mine} <= others and len({c for _, c in mine}) == len(mine)
    made = {r["qid"]: r["passages"] for r in synthesis.contexts(q, pool, 2, "s").collect()}
    assert len(made) == 60 and all(len(set(p)) == 3 for p in made.values())
    at = [p.index(f"p{i}") for i, p in made.items() if f"p{i}" in p]
    assert 36 <= len(at) < 60 and set(at) == {0, 1, 2}
    assert all(f"p{i}" in p for i, p in ((r["qid"], r["passages"]) for r in synthesis.contexts(q, pool, 2, "s", p=1.0).collect()))
