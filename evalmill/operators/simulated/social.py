"""Messages, posts and tickets.

Names of operations and of fields, and the sentences of results, are fixed values,
as sessions are compared by them; error texts are our own.
"""

from __future__ import annotations

from evalmill.operators.simulated.core import Refused, Service, digits, require, whole_keys


def signed_in(key: str):
    """A guard: ``key`` of the state is set."""

    def guard(s: dict) -> None:
        require(s[key], "not logged in")

    return guard


# People and messages of a fresh workspace.
USERS = {"Alice": "USR001", "Bob": "USR002", "Catherine": "USR003", "Daniel": "USR004"}
INBOX = [{"USR002": "My name is Alice. I want to connect."}, {"USR003": "Could you upload the file?"}, {"USR004": "Could you upload the file?"}]

messages = Service(seed=200191, generated_ids=[], user_count=4, user_map=USERS, inbox=INBOX, message_count=3, current_user=None)
_in = signed_in("current_user")


def _sent(s: dict) -> list[tuple[str, str]]:
    return [next(iter(m.items())) for m in s["inbox"]]


@messages.operation()
def list_users(s):
    return {"user_list": list(s["user_map"])}


@messages.operation()
def get_user_id(s, user):
    require(user in s["user_map"], f"no user '{user}'")
    return {"user_id": s["user_map"][user]}


@messages.operation()
def message_login(s, user_id):
    if user_id not in s["user_map"].values():
        return {"login_status": False, "message": f"no user id '{user_id}'"}
    s["current_user"] = user_id
    return {"login_status": True, "message": f"User '{user_id}' logged in successfully."}


@messages.operation()
def message_get_login_status(s):
    return {"login_status": bool(s["current_user"])}


@messages.operation(_in)
def send_message(s, receiver_id, message):
    require(receiver_id in s["user_map"].values(), f"no receiver '{receiver_id}'")
    new = digits(s, 5)
    while new in s["generated_ids"]:
        new = digits(s, 5)
    s["generated_ids"].append(new)
    s["inbox"].append({receiver_id: message})
    s["message_count"] += 1
    return {"sent_status": True, "message_id": {"new_id": new}, "message": f"Message sent to '{receiver_id}' successfully."}


@messages.operation(_in)
def delete_message(s, receiver_id):
    """Picks the newest to the receiver, then deletes the oldest that equals it."""
    to = [m for m in s["inbox"] if receiver_id in m]
    require(to, f"no message to '{receiver_id}'")
    s["inbox"].remove(to[-1])
    return {"deleted_status": True, "receiver_id": receiver_id, "message": f"Receiver {receiver_id}'s latest message deleted successfully."}


@messages.operation(_in)
def view_messages_sent(s):
    out: dict[str, list[str]] = {}
    for to, text in _sent(s):
        out.setdefault(to, []).append(text)
    return {"messages": out}


@messages.operation(_in)
def add_contact(s, user_name):
    require(user_name not in s["user_map"], f"user '{user_name}' exists")
    s["user_count"] += 1
    new = f"USR{s['user_count']:03d}"
    require(new not in s["user_map"].values(), f"user id '{new}' exists")
    s["user_map"][user_name] = new
    return {"added_status": True, "user_id": new, "message": f"Contact '{user_name}' added successfully."}


@messages.operation(_in)
def search_messages(s, keyword):
    return {"results": [{"receiver_id": to, "message": text} for to, text in _sent(s) if keyword.lower() in text.lower()]}


@messages.operation(_in)
def get_message_stats(s):
    return {"stats": {"received_count": len(s["inbox"]), "total_contacts": len({to for to, _ in _sent(s)})}}


def _numbered(s: dict) -> None:
    s["tweets"], s["comments"] = whole_keys(s["tweets"]), whole_keys(s["comments"])


posts = Service(prepare=_numbered, username="john", password="john123", authenticated=False, tweets={}, comments={}, retweets={}, following_list=["alice", "bob"], tweet_counter=0)
_author = signed_in("authenticated")


def _post(s: dict, tweet_id: int) -> dict:
    require(tweet_id in s["tweets"], f"no post {tweet_id}")
    return s["tweets"][tweet_id]


@posts.operation()
def authenticate_twitter(s, username, password):
    s["authenticated"] = s["authenticated"] or (username, password) == (s["username"], s["password"])
    return {"authentication_status": (username, password) == (s["username"], s["password"])}


@posts.operation()
def posting_get_login_status(s):
    return {"login_status": bool(s["authenticated"])}


@posts.operation(_author)
def post_tweet(s, content, tags=(), mentions=()):
    new = {"id": s["tweet_counter"], "username": s["username"], "content": content, "tags": list(tags), "mentions": list(mentions)}
    s["tweets"][new["id"]] = new
    s["tweet_counter"] += 1
    return dict(new)


@posts.operation(_author)
def retweet(s, tweet_id):
    _post(s, tweet_id)
    mine = s["retweets"].setdefault(s["username"], [])
    if tweet_id in mine:
        return {"retweet_status": "Already retweeted"}
    mine.append(tweet_id)
    return {"retweet_status": "Successfully retweeted"}


@posts.operation(_author)
def comment(s, tweet_id, comment_content):
    _post(s, tweet_id)
    s["comments"].setdefault(tweet_id, []).append({"username": s["username"], "content": comment_content})
    return {"comment_status": "Comment added successfully"}


@posts.operation()
def mention(s, tweet_id, mentioned_usernames):
    _post(s, tweet_id)["mentions"].extend(mentioned_usernames)
    return {"mention_status": "Users mentioned successfully"}


@posts.operation(_author)
def follow_user(s, username_to_follow):
    new = username_to_follow not in s["following_list"]
    s["following_list"] += [username_to_follow] * new
    return {"follow_status": new}


@posts.operation(_author)
def unfollow_user(s, username_to_unfollow):
    known = username_to_unfollow in s["following_list"]
    if known:
        s["following_list"].remove(username_to_unfollow)
    return {"unfollow_status": known}


@posts.operation(_author)
def list_all_following(s):
    return {"following_list": list(s["following_list"])}


@posts.operation()
def get_tweet(s, tweet_id):
    return dict(_post(s, tweet_id))


@posts.operation()
def get_user_tweets(s, username):
    return [dict(p) for p in s["tweets"].values() if p["username"] == username]


@posts.operation()
def search_tweets(s, keyword):
    k = keyword.lower()
    return [dict(p) for p in s["tweets"].values() if k in p["content"].lower() or k in (t.lower() for t in p["tags"])]


@posts.operation()
def get_tweet_comments(s, tweet_id):
    _post(s, tweet_id)
    return list(s["comments"].get(tweet_id, []))


@posts.operation()
def get_user_stats(s, username):
    return {"tweet_count": sum(p["username"] == username for p in s["tweets"].values()), "following_count": len(s["following_list"]) if username == s["username"] else 0, "retweet_count": len(s["retweets"].get(username, []))}


tickets = Service(ticket_queue=[], ticket_counter=1, current_user=None)
EDITABLE = ("title", "description", "status", "priority")


def _ticket(s: dict, ticket_id: int) -> dict:
    for t in s["ticket_queue"]:
        if t["id"] == ticket_id:
            return t
    raise Refused(f"no ticket {ticket_id}")


@tickets.operation(_in)
def create_ticket(s, title, description="", priority=1):
    require(1 <= priority <= 5, "priority is 1 to 5")
    new = {"id": s["ticket_counter"], "title": title, "description": description, "status": "Open", "priority": priority, "created_by": s["current_user"]}
    s["ticket_queue"].append(new)
    s["ticket_counter"] += 1
    return dict(new)


@tickets.operation()
def get_ticket(s, ticket_id):
    return dict(_ticket(s, ticket_id))


def _end(s: dict, ticket_id: int, status: str, **more: str) -> dict:
    t = _ticket(s, ticket_id)
    require(t["status"] != status, f"ticket {ticket_id} is {status.lower()} already")
    t.update(more, status=status)
    return {"status": f"Ticket {ticket_id} has been {status.lower()} successfully."}


@tickets.operation()
def close_ticket(s, ticket_id):
    return _end(s, ticket_id, "Closed")


@tickets.operation()
def resolve_ticket(s, ticket_id, resolution):
    return _end(s, ticket_id, "Resolved", resolution=resolution)


@tickets.operation()
def edit_ticket(s, ticket_id, updates):
    t = _ticket(s, ticket_id)
    wrong = sorted(set(updates) - set(EDITABLE))
    require(not wrong, f"no such fields: {', '.join(wrong)}")
    t.update({k: v for k, v in updates.items() if v is not None})
    return {"status": f"Ticket {ticket_id} has been updated successfully."}


@tickets.operation()
def ticket_login(s, username, password):
    if username and password:
        s["current_user"] = username
    return {"success": bool(username and password)}


@tickets.operation()
def ticket_get_login_status(s):
    return {"login_status": bool(s["current_user"])}


@tickets.operation()
def logout(s):
    was, s["current_user"] = s["current_user"], None
    return {"success": bool(was)}


@tickets.operation(_in)
def get_user_tickets(s, status=None):
    return [dict(t) for t in s["ticket_queue"] if t["created_by"] == s["current_user"] and (not status or t["status"].lower() == status.lower())]
