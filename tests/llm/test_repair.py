"""Conversation repair against plain searches."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from resalelens.llm import conversation_repair as repair
from resalelens.llm.queries import op13_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, audit string"
SHAPE = re.compile(r"(s?(ua)+)?")


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        solid = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else None if solid[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Strings of edits by (cost, audit), all of them kept as plain strings."""
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    fits = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}

    def inserted(best):
        for _ in range(4):
            for s, (c, e, o) in list(best.items()):
                new = (c + 5, e + "I", (*o, ("user" if fits[s] == "u" else "assistant", "")))
                best[fits[s]] = min(best.get(fits[s], new), new)
        return best

    for (_, _, role, text), fault in zip(rows, found):
        new = {}
        for s, (c, e, o) in inserted(best).items():
            offers = [(s, (c + 2, e + "D", o))]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                if (s, role[:1]) in after:
                    offers.append((after[s, role[:1]], (c + more, e + "K", (*o, (role, text)))))
                offers.append((fits[s], (c + 1 + more, e + "R", (*o, ("user" if fits[s] == "u" else "assistant", text)))))
            for t, offer in offers:
                new[t] = min(new.get(t, offer), offer)
        best = new
    return min(b for s, b in inserted(best).items() if s in ("", "a"))


def plain(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = [r for r in damage(rows) if r[0] == conv]
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0))
        turns = {r[1] for r in mine if r[1] is not None}
        found = faults(mine)
        cost, audit, kept = cheapest(mine, found)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(k) for k in ("blank", "duplicate", "truncated")),
                    illegal, cost, audit, sha))
    return sorted(out, key=str)


def run(spark, tmp_path, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    df.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = op13_conversation_repair(spark, str(tmp_path)).collect()
    return sorted((tuple(r) for r in got), key=str)


def talk(rng, conv, n, roles=("user", "assistant", "system", "", "tool", "unknown", None)):
    """Turns are distinct, since messages of one turn have no order of their own."""
    turns = rng.sample(range(-3, 3 * n), n)
    texts = ["Yes.", "No!\n", "why", " \t", "", "Ünd?", None, "Yes"]
    weights = [9, 9, 3] + [1] * (len(roles) - 3)
    return [(conv, t, rng.choices(roles, weights)[0], rng.choice(texts) if rng.random() < .3 else f"{rng.random()}.") for t in turns]


@pytest.mark.parametrize("case", ["small", "long", "no ids", "same", "empty"])
def test_query_matches_plain(spark, tmp_path, monkeypatch, case):
    rng = random.Random(case)
    rows = {
        "small": lambda: [r for c in range(120) for r in talk(rng, c, rng.randrange(1, 9))],
        "long": lambda: [r for c, n in enumerate([1, 900, 3, 400, 2]) for r in talk(rng, c, n, ("user", "assistant", "tool"))],
        "no ids": lambda: talk(rng, None, 9) + [(7, None, "user", "a.")] + [(8, 1, "user", None)] + [(9, 2 ** 62, None, "x")],
        "same": lambda: [(3, 5, "user", "Again.")] * 300 + [(4, 4, "assistant", "x." * 200_000)],
        "empty": lambda: [],
    }[case]()
    assert run(spark, tmp_path, rows) == plain(rows)


def test_segments_change_nothing(spark, monkeypatch):
    """A conversation solved in segments of seven messages equals one search."""
    rng = random.Random(1)
    messages = [(rng.choice("uuaats"), rng.choice([0, 0, 0, 1, 2])) for _ in range(400)]
    whole = repair.Search()
    for m in messages:
        whole.read(*m)
    joined = repair._Joined(5)
    for at in range(0, len(messages), 7):
        run = repair._Run(5, repair.ANY if at else (repair.START,), 0, at)
        for m in messages[at:at + 7]:
            run.read(*m)
        names = ["conv_id", "part", "ordinal", "open", "start", "state", "cost", "audit", "illegal", "first", "last"]
        for row in run.open():
            joined.read(dict(zip(names, row)))
    assert joined.end()[1:3] == whole.end()


def test_cheapest_of_all_edits():
    """Against every sequence of edits over up to three messages and three inserts."""
    rng = random.Random(2)
    for _ in range(30):
        messages = [(rng.choice("uasx"), rng.choice([0, 0, 1, 2])) for _ in range(rng.randrange(0, 4))]
        best = None
        for inserts in itertools.product(range(3), repeat=len(messages) + 1):
            if sum(inserts) > 3:
                continue
            for edits in itertools.product("DKR", repeat=len(messages)):
                for fits in itertools.product("ua", repeat=sum(inserts) + edits.count("R")):
                    fit, roles, audit, cost = iter(fits), "", "", 0
                    for k, n in enumerate(inserts):
                        roles += "".join(next(fit) for _ in range(n))
                        audit, cost = audit + "I" * n, cost + 5 * n
                        if k < len(messages):
                            (initial, fault), edit = messages[k], edits[k]
                            if edit != "D" and fault == 1:
                                cost += 1000
                            cost += {"D": 2, "K": 0, "R": 1}[edit] + (5 if fault == 2 and edit != "D" else 0)
                            roles += {"D": "", "K": initial, "R": ""}[edit] + (next(fit) if edit == "R" else "")
                            audit += edit
                    if SHAPE.fullmatch(roles) and (best is None or (cost, audit) < best):
                        best = (cost, audit)
        search = repair.Search()
        for m in messages:
            search.read(*m)
        assert search.end() == best


def test_colliding_hashes_are_confirmed(monkeypatch):
    """With a hash of three values the order of audits stays that of their texts."""
    monkeypatch.setattr(repair, "PRIME", 3)
    rng = random.Random(4)
    audits, nodes = repair.Audits(), [0]
    for _ in range(300):
        nodes.append(audits.add(rng.choice(nodes), rng.choice("DIKR")))
    for _ in range(3_000):
        a, b = rng.choice(nodes), rng.choice(nodes)
        assert audits.less(a, b) == (audits.text(a) < audits.text(b))


def test_messages(spark):
    rows = [(1, 1, "assistant", "Hello."), (1, 2, "assistant", "There."), (2, 1, "user", " "), (3, None, "user", "Hm")]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    fixed = repair.Repair(df)
    got = sorted(tuple(r) for r in fixed.messages().collect())
    assert got == [(1, 0, "R", "user", "Hello."), (1, 1, "K", "assistant", "There.")]
    assert {r.conv_id: r.audit for r in fixed.conversations.collect()} == {1: "RK", 2: "D", 3: "D"}
