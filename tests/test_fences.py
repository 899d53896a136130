"""Fences that are sent again, inside another message or as a message of their own."""


from palimpsest.functions import fixed
from palimpsest.functions.config import Settings
from palimpsest.plans import encode, replay

from .test_tables import conversation


def replayed_by_hand(turns, keep, summaries=()):
    """The folded texts of all requests, by a session that reads them one after another. Fences hold no other fence here."""
    import hashlib
    import re

    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()[:16]
    noted, out, req_no = {}, {}, 0
    for last, (role, _) in enumerate(turns):
        if role != "user":
            continue
        req_no += 1
        for idx, (who, t) in enumerate(turns[: last + 1]):
            if not 0 < idx < last + 1 - keep:
                continue
            if who == "tool":
                if len(t) > fixed.LEAST_TOOL_RESULT:
                    noted.setdefault(digest(t), ("tool", req_no))
                continue
            if len(t) >= fixed.LEAST_BLOB and digest(t) in noted:
                kind, turn = noted[digest(t)]
                out[req_no, idx] = f"[ref:{digest(t)} {kind} unchanged from turn {turn}]"
                continue
            if (req_no, idx) in summaries:
                out[req_no, idx] = "summary"
                continue

            def one(m, turn=req_no):
                body = m[0]
                seen = " seen" if digest(body) in noted else ""
                noted.setdefault(digest(body), ("code", turn))
                return f"[code:{digest(body)} {body.count(chr(10))}L{seen}]"

            out[req_no, idx] = re.sub(r"(?s)```[^\n]*\n(.*?)```", one, t)
    return out


def test_fences_over_messages(spark):
    long = "```py\n" + "value = compute(1, 2)\n" * 30 + "```"
    short = "```sh\n" + "ls -l /a/folder\n" * 8 + "```"  # longer than its reference: a fold that saves nothing is not sent
    tool = "row\n" * 120
    around = "```py\n" + tool + "```"
    turns = [
        ("system", "s"), ("user", f"look at {long}"), ("assistant", f"and {short} then {short}"), ("user", long), ("tool", tool), ("assistant", short), ("tool", around), ("user", f"{long} {short}"),
        ("assistant", around), ("user", tool), ("assistant", f"{around} {long}"), ("user", long), ("assistant", "done"), ("user", "bye"),
    ]
    messages = conversation(spark, turns)
    settings = Settings(history_style="folds", mode="MAX")
    made = spark.createDataFrame([(1, 2, 2, 1, "summary")], "conv_id int, start int, end int, since int, summary string")
    covered = {(r, 2) for r in range(2, 9)}
    for summaries, hand in ((None, replayed_by_hand(turns, settings.keep)), (made, replayed_by_hand(turns, settings.keep, covered))):
        rows, _ = encode.encode(replay.replayed(messages, replay.requests(messages)).drop("last_idx"), settings, summaries=summaries)
        got = {(r["req_no"], r["idx"]): r["plain"] for r in rows.filter("route = 'fold'").collect()}
        assert got == hand
    assert any("code unchanged" in t for t in hand.values()) and any("tool unchanged" in t for t in hand.values()) and any(" seen]" in t for t in hand.values())
