import random
import re
from collections import defaultdict
from hashlib import md5, sha256
from itertools import product

import pytest
from pyspark.sql import functions as F

from helixframe.llm import turnrepair

SPACE = " \t\n\x0b\x0c\r"
GOOD = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, place string, edit int"
SYMBOL = lambda initial, fault: chr(ord("A") + "sua-".index(initial) * 4 + fault)


def cheapest(rows, most_inserts=4):
    """(cost, audit) by trying all edits: ``rows`` are (initial, fault)."""
    best = None

    def walk(i, initials, cost, audit, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and GOOD.fullmatch(initials) and (best is None or (cost, audit) < best):
            best = (cost, audit)
        if inserts < most_inserts:
            for r in "ua":
                walk(i, initials + r, cost + 2, audit + "I", inserts + 1)
        if i < len(rows):
            initial, fault = rows[i]
            walk(i + 1, initials, cost + 3, audit + "D", inserts)
            if fault < 2:
                walk(i + 1, initials + initial, cost + fault, audit + "K", inserts)
                for r in "ua":
                    walk(i + 1, initials + r, cost + 2 + fault, audit + "R", inserts)

    walk(0, "", 0, "", 0)
    return best


def test_search_finds_the_cheapest_and_least_audit():
    rng = random.Random(3)
    cases = [rows for n in range(3) for rows in product(product("sua-", (0, 1, 2)), repeat=n)]
    cases += [[(rng.choice("suuaaa-"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randint(3, 5))] for _ in range(120)]
    for rows in cases:
        found = turnrepair.ways("".join(SYMBOL(*r) for r in rows), 0)
        assert min(found[s] for s in turnrepair.ENDS if s in found) == cheapest(rows), rows


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_segments_give_what_the_whole_gives(size):
    rng = random.Random(size)
    for _ in range(60):
        symbols = "".join(SYMBOL(rng.choice("suuaa-"), rng.choice((0, 0, 1, 2))) for _ in range(rng.randint(1, 40)))
        whole = turnrepair.ways(symbols, 0)
        want = min(whole[s] for s in turnrepair.ENDS if s in whole)
        follower = turnrepair.Follower()
        pairs = sum(follower.add(symbols[i : i + size]) for i in range(0, len(symbols), size))
        follower.close()
        assert (sum(s[2] for s in follower.settled), "".join(s[3] for s in follower.settled)) == want
        assert [s[0] for s in follower.settled] == list(range(-(-len(symbols) // size)))
        assert pairs == turnrepair.illegal(turnrepair._initials(symbols))


def test_ways_are_settled_early():
    follower = turnrepair.Follower()
    for k in range(200):
        follower.add(SYMBOL("u", 0) + SYMBOL("a", 0))
        assert len(follower.settled) >= k - 2


def plain(rows):
    """Reports of conversations by plain Python, with a shortest path over prefixes that keeps least audits."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(SPACE)
            faults.append(2 if not bare else 3 if (role, text) in seen else 0 if bare[-1] in ".!?" else 1)
            seen.add((role, text))
        best = {"": (0, "")}  # by initials: empty, s, ..u, ..a
        after = lambda state, r: {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, r))
        for k in range(len(own) + 1):
            for _ in range(3):
                for state, (cost, audit) in list(best.items()):
                    for r in "ua":
                        to = after(state, r)
                        if to and (to not in best or (cost + 2, audit + "I") < best[to]):
                            best[to] = (cost + 2, audit + "I")
            if k == len(own):
                break
            moved = {}
            for state, (cost, audit) in best.items():
                ways = [(state, cost + 3, audit + "D")]
                if faults[k] < 2:
                    ways.append((after(state, own[k][1][:1]), cost + faults[k], audit + "K"))
                    ways += [(after(state, r), cost + 2 + faults[k], audit + "R") for r in "ua"]
                for to, c, a in ways:
                    if to is not None and (to not in moved or (c, a) < moved[to]):
                        moved[to] = (c, a)
            best = moved
        cost, audit = min(best[s] for s in ("", "a") if s in best)
        lines, row, n = [], 0, len(audit.replace("D", ""))
        for letter in audit:
            role = "user" if (len(lines) + n) % 2 == 0 else "assistant"
            if letter == "I":
                lines.append(role + ":")
                continue
            if letter != "D":
                lines.append((own[row][1] if letter == "K" else role) + ":" + own[row][2])
            row += 1
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(2), faults.count(3), faults.count(1),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, sha256("\n".join(lines).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def conversations():
    rng = random.Random(8)
    texts = ["Fine.", "Cut off", "", " \t\r\n", None, "Yes!", "Ça va?", "a  \x0b.", " ", "long " * 5000]
    rows = [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "Union", "sys"]), rng.choice(texts)) for c in range(80) for t in range(rng.randint(1, 9))]
    rows += [(500, None, "user", "Fine."), (500, None, "user", "Fine."), (500, None, "assistant", "ok"), (None, 3, "user", "Hm"), (None, 9, "assistant", "Yes.")]
    rows += [(501, 4, "user", f"t{k % 3}.") for k in range(12)] + [(502, 10 * k, ("user", "assistant")[k % 2], f"turn {k}" + "." * (k % 3 > 0)) for k in range(3000)]
    return rows + [(503, 2**40, "system", "Alone.")]


def test_reports_against_plain_python(spark):
    rows = conversations()
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(5)
    repaired, report = turnrepair.repair(frame)
    order = ["conv_id", *turnrepair.COUNTS, "audit", "repaired_sha256"]
    assert report.columns == order
    assert sorted(map(tuple, report.collect()), key=repr) == plain(rows)
    assert repaired.columns == ["conv_id", "place", "part", "edit", "role", "text"]
    by_conv = defaultdict(list)
    for r in repaired.collect():
        by_conv[r.conv_id].append((r.place, r.part, r.role))
    for own in by_conv.values():
        assert GOOD.fullmatch("".join(role[0] for _, _, role in sorted(own)))
    # A hot conversation lies in many segments.
    assert repaired.where("conv_id = 502").select(F.shiftright("place", turnrepair.SEGMENT)).distinct().count() >= 3


def test_damage(spark):
    import zlib

    rows = [(c, t, ("user", "assistant")[t % 2], "One. Two! Three?") for c in range(20) for t in range(6)] + [(None, 1, None, None), (3, None, "user", None)]
    got = sorted(map(tuple, turnrepair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=repr)
    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(want, key=repr)


def test_empty_and_dropped(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    repaired, report = turnrepair.repair(none)
    assert repaired.collect() == [] and report.collect() == []
