import hashlib
import heapq
import random
import re
import zlib

from orbweave.llm.conversations import damaged, repair

KIND = "conv_id long, turn long, role string, text string"


def damage(rows):
    """Rows after damage in their order; a key's rows share their fate."""
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """All edits by uniform cost search over (row, role initials so far), insertions anywhere and as often as wanted."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, roles, lines = heapq.heappop(heap)
        if (k, roles[-1:]) in done and not (k == len(rows)):
            continue
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, lines
        if (k, roles[-1:]) in done:
            continue
        done.add((k, roles[-1:]))
        fits = lambda r: re.fullmatch("s?(ua)*u?", r) is not None
        for name in ("user", "assistant"):
            if fits(roles + name[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", k, roles + name[0], (*lines, f"{name}:")))
        if k < len(rows):
            _, role, text = rows[k]
            heapq.heappush(heap, (cost + 2, audit + "D", k + 1, roles, lines))
            if found[k] not in ("blank", "duplicate"):
                more = 5 if found[k] == "truncated" else 0
                if role[:1] in ("s", "u", "a") and fits(roles + role[0]):
                    heapq.heappush(heap, (cost + more, audit + "K", k + 1, roles + role[0], (*lines, f"{role}:{text}")))
                for name in ("user", "assistant"):
                    if fits(roles + name[0]):
                        heapq.heappush(heap, (cost + 1 + more, audit + "R", k + 1, roles + name[0], (*lines, f"{name}:{text}")))
    raise AssertionError


def brute(rows):
    rows = damage(rows)
    found = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(1 for a, b in zip(rows, rows[1:]) if a[1][:1] + b[1][:1] not in ("su", "ua", "au"))
    cost, audit, lines = cheapest(rows, found)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def check(spark, rows):
    got = {}
    for r in repair(damaged(spark.createDataFrame(rows, KIND))).collect():
        assert r.conv_id not in got
        got[r.conv_id] = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashlib.sha256("\n".join(r.lines).encode()).hexdigest())
    want = {c: brute([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


def test_repairs_match_a_search_over_all_edits(spark):
    rng = random.Random(3)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]
    rows = []
    for conv in range(400):
        turns = [rng.choice([k, k, k, k + 1, None if rng.random() < 0.1 else k]) for k in range(rng.randint(1, 9))]
        rows += [(conv, t, roles[k % 2] if rng.random() < 0.6 else rng.choice(roles), rng.choice(["Yes.", "No?", "cut", "ü.", " \n", None, "", "A. b!\n", "same."])) for k, t in enumerate(turns)]
    check(spark, rows)


def test_null_and_hot_conversations(spark):
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, 1, "user", "a."), (7, None, "user", "x."), (7, None, "assistant", "y.")]
    rows += [(8, k, "user" if k % 2 else "assistant", f"{k}.") for k in range(700)]
    check(spark, rows)


def test_dropped_conversations_and_empty_tables(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    check(spark, [(gone, 0, "user", "x.")])
    assert repair(damaged(spark.createDataFrame([], KIND))).count() == 0


def test_extra_columns_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi.", 5, "x", True), (1, 1, "assistant", "Yes.", 6, "y", False)], KIND + ", at int, blank string, duplicate boolean")
    r = repair(rows).collect()[0]
    assert (r.cost, r.audit, r.lines) == (0, "KK", ["user:Hi.", "assistant:Yes."])


def test_system_opens_and_edits_cost_what_they_should(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (2, 0, "user", "U."), (3, 0, "user", "cut"), (3, 1, "assistant", "A."), (4, 0, "system", "S."), (4, 1, "user", "U."), (4, 2, "assistant", "A.")]
    got = {r.conv_id: (r.cost, r.audit) for r in repair(spark.createDataFrame(rows, KIND)).collect()}
    assert got == {1: (1, "RK"), 2: (2, "D"), 3: (4, "DD"), 4: (0, "KKK")}
