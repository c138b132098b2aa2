"""Registered queries that replay a session of each simulated service for every customer.

A script is a list of (method, arguments, result) as JSON; ``{k}`` stands for
the customer's key, and a result of None isn't compared, as it holds random
numbers.  The SQL has the results as they are stated here.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from evalmill.operators import actions
from evalmill.plans.registry import query
from evalmill.sources.tables import table

_TICKET = '"description": "", "id": 1, "priority": 3'
_POST = '{"content": "Post {k}", "id": 0, "mentions": [], "tags": ["#A"], "username": "john"}'

SCRIPTS: dict[str, list[tuple[str, str, str | None]]] = {
    "maths": [
        ("add", '{"a": {k}, "b": 0}', '{"result": {k}}'), ("subtract", '{"a": {k}, "b": 0}', '{"result": {k}}'), ("multiply", '{"a": 1, "b": {k}}', '{"result": {k}}'), ("divide", '{"a": {k}, "b": 1}', '{"result": {k}.0}'),
        ("divide", '{"a": {k}, "b": 0}', '{"error": "division by zero"}'), ("add", '{"a": "x", "b": 0}', '{"error": "numbers only"}'), ("power", '{"base": 2, "exponent": 10}', '{"result": 1024}'), ("percentage", '{"part": 50, "whole": 200}', '{"result": 25.0}'),
        ("percentage", '{"part": 1, "whole": 0}', '{"error": "the whole is zero"}'), ("absolute_value", '{"number": -7}', '{"result": 7}'), ("round_number", '{"number": 2.567, "decimal_places": 2}', '{"result": 2.57}'),
        ("mean", '{"numbers": [{k}, {k}]}', '{"result": {k}.0}'), ("standard_deviation", '{"numbers": [1, 3]}', '{"result": 1.0}'), ("min_value", '{"numbers": [{k}, 100000000]}', '{"result": {k}}'), ("max_value", '{"numbers": [{k}, -1]}', '{"result": {k}}'),
        ("sum_values", '{"numbers": [{k}, 5, -5]}', '{"result": {k}}'), ("mean", '{"numbers": []}', '{"error": "the list is empty"}'), ("square_root", '{"number": 2, "precision": 5}', '{"result": "1.4142"}'), ("square_root", '{"number": -2, "precision": 5}', '{"error": "the number is negative"}'),
        ("si_unit_conversion", '{"value": 5, "unit_in": "km", "unit_out": "m"}', '{"result": 5000.0}'), ("imperial_si_conversion", '{"value": 10, "unit_in": "celsius", "unit_out": "fahrenheit"}', '{"result": 50.0}'), ("imperial_si_conversion", '{"value": 2, "unit_in": "kg", "unit_out": "lb"}', '{"result": 4.40924}'),
        ("none", "{}", '{"error": "no operation none"}'),
    ],
    "tickets": [
        ("create_ticket", '{"title": "T"}', '{"error": "not logged in"}'), ("ticket_login", '{"username": "", "password": "p"}', '{"success": false}'), ("ticket_login", '{"username": "u{k}", "password": "p"}', '{"success": true}'), ("ticket_get_login_status", "{}", '{"login_status": true}'),
        ("create_ticket", '{"title": "T{k}", "priority": 3}', '{"created_by": "u{k}", ' + _TICKET + ', "status": "Open", "title": "T{k}"}'), ("create_ticket", '{"title": "T", "priority": 9}', '{"error": "priority is 1 to 5"}'),
        ("edit_ticket", '{"ticket_id": 1, "updates": {"title": "N{k}", "status": null}}', '{"status": "Ticket 1 has been updated successfully."}'), ("edit_ticket", '{"ticket_id": 1, "updates": {"id": 2}}', '{"error": "no such fields: id"}'), ("get_ticket", '{"ticket_id": 1}', '{"created_by": "u{k}", ' + _TICKET + ', "status": "Open", "title": "N{k}"}'),
        ("get_ticket", '{"ticket_id": 1{k}}', '{"error": "no ticket 1{k}"}'), ("resolve_ticket", '{"ticket_id": 1, "resolution": "r"}', '{"status": "Ticket 1 has been resolved successfully."}'), ("resolve_ticket", '{"ticket_id": 1, "resolution": "r"}', '{"error": "ticket 1 is resolved already"}'),
        ("close_ticket", '{"ticket_id": 1}', '{"status": "Ticket 1 has been closed successfully."}'), ("get_user_tickets", '{"status": "closed"}', '[{"created_by": "u{k}", ' + _TICKET + ', "resolution": "r", "status": "Closed", "title": "N{k}"}]'), ("get_user_tickets", '{"status": "open"}', "[]"), ("logout", "{}", '{"success": true}'), ("logout", "{}", '{"success": false}'),
    ],
    "posts": [
        ("authenticate_twitter", '{"username": "john", "password": "x"}', '{"authentication_status": false}'), ("post_tweet", '{"content": "c"}', '{"error": "not logged in"}'), ("authenticate_twitter", '{"username": "john", "password": "john123"}', '{"authentication_status": true}'), ("posting_get_login_status", "{}", '{"login_status": true}'),
        ("post_tweet", '{"content": "Post {k}", "tags": ["#A"]}', _POST), ("retweet", '{"tweet_id": 0}', '{"retweet_status": "Successfully retweeted"}'), ("retweet", '{"tweet_id": 0}', '{"retweet_status": "Already retweeted"}'), ("retweet", '{"tweet_id": 5}', '{"error": "no post 5"}'),
        ("comment", '{"tweet_id": 0, "comment_content": "c{k}"}', '{"comment_status": "Comment added successfully"}'), ("get_tweet_comments", '{"tweet_id": 0}', '[{"content": "c{k}", "username": "john"}]'), ("search_tweets", '{"keyword": "#a"}', f"[{_POST}]"), ("search_tweets", '{"keyword": "POST {k}"}', f"[{_POST}]"),
        ("mention", '{"tweet_id": 0, "mentioned_usernames": ["m"]}', '{"mention_status": "Users mentioned successfully"}'), ("get_tweet", '{"tweet_id": 0}', _POST.replace("[]", '["m"]')), ("follow_user", '{"username_to_follow": "alice"}', '{"follow_status": false}'), ("follow_user", '{"username_to_follow": "u{k}"}', '{"follow_status": true}'),
        ("unfollow_user", '{"username_to_unfollow": "bob"}', '{"unfollow_status": true}'), ("unfollow_user", '{"username_to_unfollow": "bob"}', '{"unfollow_status": false}'), ("list_all_following", "{}", '{"following_list": ["alice", "u{k}"]}'), ("get_user_stats", '{"username": "john"}', '{"following_count": 2, "retweet_count": 1, "tweet_count": 1}'), ("get_user_tweets", '{"username": "none"}', "[]"),
    ],
    "messages": [
        ("view_messages_sent", "{}", '{"error": "not logged in"}'), ("message_login", '{"user_id": "USR009"}', '{"login_status": false, "message": "no user id \'USR009\'"}'), ("message_login", '{"user_id": "USR001"}', '{"login_status": true, "message": "User \'USR001\' logged in successfully."}'), ("message_get_login_status", "{}", '{"login_status": true}'),
        ("add_contact", '{"user_name": "P{k}"}', '{"added_status": true, "message": "Contact \'P{k}\' added successfully.", "user_id": "USR005"}'), ("add_contact", '{"user_name": "P{k}"}', '{"error": "user \'P{k}\' exists"}'), ("get_user_id", '{"user": "P{k}"}', '{"user_id": "USR005"}'),
        ("list_users", "{}", '{"user_list": ["Alice", "Bob", "Catherine", "Daniel", "P{k}"]}'), ("send_message", '{"receiver_id": "USR005", "message": "Hello {k}"}', None), ("send_message", '{"receiver_id": "USR006", "message": "m"}', '{"error": "no receiver \'USR006\'"}'), ("search_messages", '{"keyword": "HELLO"}', '{"results": [{"message": "Hello {k}", "receiver_id": "USR005"}]}'),
        ("get_message_stats", "{}", '{"stats": {"received_count": 4, "total_contacts": 4}}'), ("delete_message", '{"receiver_id": "USR005"}', '{"deleted_status": true, "message": "Receiver USR005\'s latest message deleted successfully.", "receiver_id": "USR005"}'), ("delete_message", '{"receiver_id": "USR005"}', '{"error": "no message to \'USR005\'"}'),
    ],
    "files": [
        ("pwd", "{}", '{"current_working_directory": "/workspace"}'), ("mkdir", '{"dir_name": "d{k}"}', "null"), ("mkdir", '{"dir_name": "d{k}"}', '{"error": "\'d{k}\': exists"}'), ("touch", '{"file_name": "f.txt"}', "null"), ("echo", '{"content": "b {k}\\nab", "file_name": "f.txt"}', "null"), ("echo", '{"content": "x{k}"}', '{"terminal_output": "x{k}"}'),
        ("cat", '{"file_name": "f.txt"}', '{"file_content": "b {k}\\nab"}'), ("cat", '{"file_name": "none"}', '{"error": "\'none\': no such file or directory"}'), ("cat", '{"file_name": "d{k}"}', '{"error": "\'d{k}\': is a directory"}'), ("wc", '{"file_name": "f.txt", "mode": "w"}', '{"count": 3, "type": "words"}'), ("wc", '{"file_name": "f.txt"}', '{"count": 2, "type": "lines"}'),
        ("sort", '{"file_name": "f.txt"}', '{"sorted_content": "ab\\nb {k}"}'), ("grep", '{"file_name": "f.txt", "pattern": "a"}', '{"matching_lines": ["ab"]}'), ("tail", '{"file_name": "f.txt", "lines": 1}', '{"last_lines": "ab"}'), ("cp", '{"source": "f.txt", "destination": "d{k}"}', '{"result": "\'f.txt\' copied to \'d{k}/f.txt\'"}'),
        ("mv", '{"source": "f.txt", "destination": "g.txt"}', '{"result": "\'f.txt\' moved to \'g.txt\'"}'), ("ls", "{}", '{"current_directory_content": ["d{k}", "g.txt"]}'), ("find", '{"name": "txt"}', '{"matches": ["./d{k}/f.txt", "./g.txt"]}'), ("rmdir", '{"dir_name": "d{k}"}', '{"error": "\'d{k}\': not empty"}'),
        ("cd", '{"folder": "d{k}"}', '{"current_working_directory": "d{k}"}'), ("rm", '{"file_name": "f.txt"}', '{"result": "\'f.txt\' removed"}'), ("cd", '{"folder": ".."}', "{}"), ("rmdir", '{"dir_name": "d{k}"}', '{"result": "\'d{k}\' removed"}'), ("cd", '{"folder": ".."}', '{"error": "the working directory is the root"}'),
        ("touch", '{"file_name": "h"}', "null"), ("diff", '{"file_name1": "g.txt", "file_name2": "g.txt"}', '{"diff_lines": ""}'), ("du", '{"human_readable": false}', None),
    ],
    "vehicle": [
        ("startEngine", '{"ignitionMode": "START"}', '{"error": "doors must be locked: driver, passenger, rear_left, rear_right"}'), ("fillFuelTank", '{"fuelAmount": 10}', '{"fuelLevel": 10.0}'), ("fillFuelTank", '{"fuelAmount": 41}', '{"error": "above the tank\'s size"}'), ("fillFuelTank", '{"fuelAmount": -1}', '{"error": "amount must not be negative"}'),
        ("lockDoors", '{"unlock": false, "door": ["driver", "passenger", "rear_left", "rear_right"]}', '{"lockStatus": "locked", "remainingUnlockedDoors": 0}'), ("startEngine", '{"ignitionMode": "START"}', '{"error": "the brake pedal must be pressed"}'), ("pressBrakePedal", '{"pedalPosition": 1}', '{"brakePedalForce": 1000.0, "brakePedalStatus": "pressed"}'),
        ("startEngine", '{"ignitionMode": "START"}', '{"batteryVoltage": 12.6, "engineState": "running", "fuelLevel": 10.0}'), ("setCruiseControl", '{"speed": 65, "activate": true, "distanceToNextVehicle": 100}', '{"cruiseStatus": "active", "currentSpeed": 65, "distanceToNextVehicle": 100}'), ("setCruiseControl", '{"speed": 66, "activate": true, "distanceToNextVehicle": 100}', '{"error": "speed is a multiple of 5 from 0 to 120"}'),
        ("releaseBrakePedal", "{}", '{"brakePedalForce": 0.0, "brakePedalStatus": "released"}'), ("activateParkingBrake", '{"mode": "engage"}', '{"_parkingBrakeForce": 500.0, "_slopeAngle": 10.0, "parkingBrakeStatus": "engaged"}'), ("estimate_drive_feasibility_by_mileage", '{"distance": 200}', '{"canDrive": true}'), ("estimate_drive_feasibility_by_mileage", '{"distance": 201}', '{"canDrive": false}'),
        ("estimate_distance", '{"cityA": "74532", "cityB": "83214"}', '{"distance": 750.0}'), ("estimate_distance", '{"cityA": "74532", "cityB": "{k}"}', '{"error": "no such distance"}'), ("get_zipcode_based_on_city", '{"city": "Rivermist"}', '{"zipcode": "83214"}'), ("get_zipcode_based_on_city", '{"city": "c{k}"}', '{"zipcode": "00000"}'),
        ("set_navigation", '{"destination": "Street {k}"}', '{"status": "Navigating to Street {k}"}'), ("setHeadlights", '{"mode": "auto"}', '{"headlightStatus": "off"}'), ("displayCarStatus", '{"option": "engine"}', '{"engineState": "running"}'), ("liter_to_gallon", '{"liter": 1}', '{"gallon": 0.264172}'), ("display_log", '{"messages": ["m{k}"]}', '{"log": ["m{k}"]}'),
        ("adjustClimateControl", '{"temperature": 50, "unit": "fahrenheit", "fanSpeed": 20, "mode": "cool"}', '{"climateMode": "cool", "currentACTemperature": 50, "humidityLevel": 50.0}'), ("displayCarStatus", '{"option": "climate"}', '{"climateMode": "cool", "currentACTemperature": 10.0, "fanSpeed": 20, "humidityLevel": 50.0}'), ("startEngine", '{"ignitionMode": "STOP"}', '{"error": "the brake pedal must be pressed"}'), ("displayCarStatus", '{"option": "engine"}', '{"engineState": "stopped"}'),
    ],
    "travel": [
        ("load", '{"access_token": "t", "token_type": "Bearer", "token_expires_in": 2, "credit_card_list": {"c{k}": {"card_number": "1", "balance": 1000}}}', "null"), ("travel_get_login_status", "{}", '{"status": true}'), ("get_flight_cost", '{"travel_from": "SFO", "travel_to": "LAX", "travel_date": "2024-11-11", "travel_class": "economy"}', '{"travel_cost_list": [400.0]}'),
        ("get_flight_cost", '{"travel_from": "SFO", "travel_to": "LAX", "travel_date": "2024-11-10", "travel_class": "business"}', '{"travel_cost_list": [400.0]}'), ("get_flight_cost", '{"travel_from": "SFO", "travel_to": "X{k}", "travel_date": "2024-11-10", "travel_class": "business"}', '{"error": "no route"}'), ("get_credit_card_balance", '{"access_token": "t", "card_id": "c{k}"}', '{"card_balance": 1000}'),
        ("get_credit_card_balance", '{"access_token": "u", "card_id": "c{k}"}', '{"error": "the token isn\'t valid"}'), ("book_flight", '{"access_token": "t", "card_id": "c{k}", "travel_date": "2024-11-10", "travel_from": "SFO", "travel_to": "LAX", "travel_class": "economy"}', None), ("get_credit_card_balance", '{"access_token": "t", "card_id": "c{k}"}', '{"card_balance": 800.0}'),
        ("book_flight", '{"access_token": "t", "card_id": "c{k}", "travel_date": "2024-11-11", "travel_from": "SFO", "travel_to": "LAX", "travel_class": "first"}', '{"booking_status": false, "error": "not enough funds"}'), ("book_flight", '{"access_token": "t", "card_id": "no{k}", "travel_date": "2024-11-11", "travel_from": "SFO", "travel_to": "LAX", "travel_class": "first"}', '{"booking_status": false, "error": "no card no{k}"}'),
        ("cancel_booking", '{"access_token": "t", "booking_id": "b{k}"}', '{"cancel_status": false, "error": "no such booking"}'), ("compute_exchange_rate", '{"base_currency": "USD", "target_currency": "JPY", "value": {k}}', None), ("compute_exchange_rate", '{"base_currency": "JPY", "target_currency": "USD", "value": 220}', '{"exchanged_value": 2.0}'), ("compute_exchange_rate", '{"base_currency": "JPY", "target_currency": "EUR", "value": 1}', '{"error": "no rate of these currencies"}'),
        ("get_budget_fiscal_year", "{}", '{"budget_fiscal_year": "2018"}'), ("register_credit_card", '{"access_token": "t", "card_number": "{k}", "expiration_date": "12/30", "cardholder_name": "n", "card_verification_number": 1}', None), ("register_credit_card", '{"access_token": "t", "card_number": "c{k}", "expiration_date": "12/30", "cardholder_name": "n", "card_verification_number": 1}', '{"error": "the card is registered"}'),
    ],
    "memory_kv": [
        ("core_memory_add", '{"key": "user_name", "value": "n{k}"}', '{"status": "Key-value pair added."}'), ("core_memory_add", '{"key": "user_name", "value": "x"}', '{"error": "the key exists"}'), ("core_memory_add", '{"key": "User", "value": "x"}', '{"error": "keys are snake case"}'), ("core_memory_retrieve", '{"key": "user_name"}', '{"value": "n{k}"}'),
        ("core_memory_replace", '{"key": "user_name", "value": "m{k}"}', '{"status": "Key replaced."}'), ("core_memory_retrieve_all", "{}", '{"user_name": "m{k}"}'), ("core_memory_list_keys", "{}", '{"keys": ["user_name"]}'), ("core_memory_remove", '{"key": "none"}', '{"error": "no such key"}'), ("core_memory_remove", '{"key": "user_name"}', '{"status": "Key removed."}'),
        ("archival_memory_add", '{"key": "a", "value": "{k}"}', '{"status": "Key added."}'), ("archival_memory_retrieve", '{"key": "a"}', '{"value": "{k}"}'), ("archival_memory_clear", "{}", '{"status": "Long term memory cleared."}'), ("archival_memory_list_keys", "{}", '{"keys": []}'),
    ],
    "memory_vector": [
        ("core_memory_add", '{"text": "likes tea {k}"}', '{"id": 0}'), ("core_memory_add", '{"text": "plays chess"}', '{"id": 1}'), ("core_memory_update", '{"vec_id": 1, "new_text": "plays go"}', '{"status": "ID 1 updated."}'), ("core_memory_update", '{"vec_id": 7, "new_text": "x"}', '{"error": "no entry 7"}'), ("core_memory_retrieve", '{"query": "plays go", "top_k": 1}', '[{"id": 1, "similarity_score": 1.0, "text": "plays go"}]'),
        ("core_memory_remove", '{"vec_id": 0}', '{"status": "ID 0 removed from store."}'), ("core_memory_retrieve_all", "{}", '[{"id": 1, "text": "plays go"}]'), ("archival_memory_clear", "{}", '{"status": "Memory cleared."}'),
    ],
    "memory_text": [
        ("memory_retrieve", "{}", '{"error": "the memory is empty"}'), ("memory_append", '{"text": "one {k}"}', '{"status": "Memory appended."}'), ("memory_append", '{"text": " two"}', '{"status": "Memory appended."}'), ("memory_replace", '{"old_text": "two", "new_text": "2"}', '{"status": "Memory updated."}'), ("memory_replace", '{"old_text": "three", "new_text": "3"}', '{"error": "no such text"}'),
        ("memory_retrieve", "{}", '{"memory_content": "one {k} 2"}'), ("memory_update", '{"text": "n"}', '{"status": "Memory updated."}'), ("memory_clear", "{}", '{"status": "Short term memory cleared."}'),
    ],
}


def _stated(service: str) -> str:
    quoted = lambda s: "NULL" if s is None else "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({i}, {quoted(m)}, {quoted(result)})" for i, (m, _, result) in enumerate(SCRIPTS[service]))
    return f"SELECT CAST(c_custkey AS VARCHAR) AS session, CAST(i AS BIGINT) AS ord, method, replace(result, '{{k}}', CAST(c_custkey AS VARCHAR)) AS result FROM customer, (VALUES {rows}) v(i, method, result)"


def _register(service: str) -> None:
    def run(spark, d):
        script = spark.createDataFrame([(i, m, a, r is None) for i, (m, a, r) in enumerate(SCRIPTS[service])], "ord long, method string, args string, random boolean")
        keys = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("session"))
        calls = keys.crossJoin(F.broadcast(script)).withColumns({"args": F.replace("args", F.lit("{k}"), F.col("session")), "service": F.lit(service)})
        done = actions.replay(calls.select("session", "service", "method", "args", "ord"))
        return done.join(F.broadcast(script.select("ord", "method", "random")), "ord").select("session", "ord", "method", F.when(~F.col("random"), F.col("result")).alias("result"))

    run.__name__ = f"sessions_{service}"
    run.__doc__ = f"Results of a session of the {service} service for each customer."
    query(_stated(service))(run)


for _service in SCRIPTS:
    _register(_service)
