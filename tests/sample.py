"""Posts with planted cases, and what a plain reading of them gives."""

import json
from collections import defaultdict
from datetime import datetime, timedelta

START = datetime(2025, 11, 3, 14)
MINUTE = timedelta(minutes=1)


def post(kind, post_id, seconds, author, mentions, likes=0, shares=0, replies=0, weight=1.0, tags=None, **more):
    """One post: ``seconds`` after START (None: an unreadable time) and the symbols it mentions."""
    return locals()


POSTS = [
    post("B", "n-30", 15, "reader_a", ["NEAR"], 6, 1, 2, target="$NEAR"),
    post("A", "n-31", 20, "w1", ["ADA"], 3, 0, 1, tags=["ADA"], lang="PT"),
    post("A", "n-32", 45, "w2", ["ADA", "DOT"], 12, 4, 0),
    post("A", "n-33", None, "w3", ["UNI"], 2, tags=["UNI"]),
    post("B", "n-34", 70, "elonmusk", ["ADA"], "31", "9", "5", 5.0, target="WHALE_SIGNAL"),
    post("A", "n-32", 130, "w2", ["ADA", "DOT"], 17, 6, 3, tags=["ada", "dot"]),
    post("A", "n-35", 150, "w4", []),
    post("B", "n-36", 165, "reader_b", ["DOT"], "8", "0", "x", target="$DOT", silent=True),
    post("A", "n-37", 200, "w5", ["ATOM"], "25", "5", "6", tags=["ATOM"]),
    post("A", "n-38", 215, "w1", ["ADA"], 1, 1, 1, 2.0, tags=["Ada"], author_type="kol", author_weight="2.0"),
    post("B", "n-30", 320, "reader_a", ["NEAR"], 11, 2, 2, target="$NEAR"),
    post("B", "n-39", 340, "Whale_Alert", ["NEAR"], 70, 20, 4, 5.0, target="WHALE_SIGNAL"),
    post("A", "n-40", 360, "w6", ["ALGO"], 4, 2, 0, lower=True),
    post("B", "n-41", 380, "reader_c", [], "3"),
    post("B", "n-42", 400, "reader_d", [], "3"),
    post("A", "n-43", 430, "w7", ["DOT"], 9, 0, 0, tags=["DOT"]),
]


def message(p):
    symbols = " ".join("$" + (s.lower() if p["more"].get("lower") else s) for s in p["mentions"])
    words = "thoughts" if p["more"].get("silent") else f"thoughts  on {symbols}".strip()
    at = "yesterday" if p["seconds"] is None else (START + timedelta(seconds=p["seconds"])).isoformat() + "Z"
    body = {"created_at": at, "like_count": p["likes"], "retweet_count": p["shares"], "reply_count": p["replies"]}
    if p["kind"] == "A":
        body |= {"tweet_id": p["post_id"], "user_id": p["author"], "username": "user " + p["author"], "content": words}
        body |= {"cashtags": p["tags"] or [], "hashtags": []}
    else:
        body |= {"id": p["post_id"], "author": p["author"], "text": words}
    named = {"target": "target_coin", "lang": "lang", "author_type": "author_type", "author_weight": "author_weight"}
    return body | {named[k]: v for k, v in p["more"].items() if k in named}


LINES = [json.dumps(message(p)) for p in POSTS]


def _number(value):
    return int(value) if str(value).isdigit() else 0


def _engagement(p):
    return sum(_number(p[n]) for n in ("likes", "shares", "replies"))


def _first(posts):
    """The first post of each id."""
    seen = {}
    for p in posts:
        seen.setdefault(p["post_id"], p)
    return list(seen.values())


def _totals(posts):
    """symbol: mentions, authors, influencers, engagement, influence, weight, trend, last seen."""
    by_symbol = defaultdict(list)
    for p in posts:
        for symbol in p["mentions"]:
            by_symbol[symbol].append(p)
    out = {}
    for symbol, own in by_symbol.items():
        authors, strong = {p["author"] for p in own}, {p["author"] for p in own if p["weight"] > 1}
        engaged = sum(map(_engagement, own))
        influence = sum(p["weight"] * _engagement(p) for p in own)
        trend = 2 * len(own) + len(authors) + engaged / 10 + influence / 20 + 3 * len(strong)
        last = START + timedelta(seconds=max(p["seconds"] for p in own))
        weight = max(p["weight"] for p in own)
        out[symbol] = (len(own), len(authors), len(strong), engaged, influence, weight, round(trend, 2), f"{last:%H:%M:%S}")
    return out


def _short(posts):
    """symbol: mentions, authors, engagement, short trend."""
    return {s: (m, a, e, round(2 * m + a + e / 10, 2)) for s, (m, a, _, e, *_) in _totals(posts).items()}


CLEAN = [p for p in POSTS if p["seconds"] is not None and p["mentions"]]
STRICT = [p for p in CLEAN if p["kind"] == "A" and p["tags"]]
LATEST_TOTALS = _totals(_first(CLEAN[::-1]))
FIRST_WINDOW = _totals(p for p in _first(CLEAN) if p["seconds"] < 300)
ALL_WINDOW_ROWS = len(
    {(p["seconds"] // 60 - back, s) for p in _first(CLEAN) for s in p["mentions"] for back in range(5)}
)
STRICT_TOTALS = _short(STRICT)
# A reader with whole-number columns reads quoted counts as 0.
STRICT_TYPED = _short([p | dict.fromkeys(("likes", "shares", "replies"), 0) if isinstance(p["likes"], str) else p for p in STRICT])
FUNNEL = (len(POSTS), len(POSTS), len(CLEAN), len(_first(CLEAN)))
REJECTED = {
    "missing_symbol": sum(not p["mentions"] for p in POSTS),
    "bad_timestamp": sum(p["seconds"] is None for p in POSTS),
}


def write_lines(path, lines=LINES):
    path.mkdir(parents=True, exist_ok=True)
    (path / "part.jsonl").write_text("\n".join(lines) + "\n\n", encoding="utf-8")
    return str(path)


def metrics(row):
    return (
        row.mention_count, row.unique_authors, row.influencer_authors, row.engagement_score,
        row.influence_score, row.max_author_weight, row.trend_score,
        row.last_seen.strftime("%H:%M:%S"),
    )
