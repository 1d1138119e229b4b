import hashlib
import itertools
import random
import re
import zlib

from assayer.llm import conversations as c


def plain_damage(rows):
    """{conv: [(turn, role, text)]} by the rule, in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        part = lambda x: " " if x is None else str(x)
        rule = zlib.crc32(f"{part(conv)}:{part(turn)}".encode()) % 20
        role, text = part(role), part(text)
        text = "" if rule == 1 else re.sub("[.!?]", "", text) if rule == 2 else text
        role = "user" if rule == 4 else role
        own += [(turn, role, text)] * (0 if rule == 0 else 2 if rule == 3 else 1)
    return {k: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for k, v in out.items()}


def plain_faults(rows):
    out, seen = [], []
    for _, role, text in rows:
        m = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append(1 if not m else 2 if (role, text) in seen else 0 if m[-1] in ".!?" else 3)
        seen.append((role, text))
    return out


def plain_repair(rows, faults):
    """(cost, audit, text): every sequence of edits, longest sequences of inserts cut at the cost of deleting all."""
    most = 3 * len(rows)
    found = []

    def go(i, cost, audit, roles, lines):
        if cost > most:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit, "\n".join(lines)))
        if not re.fullmatch("s?(ua)*u?", roles):
            return
        for role in ("user", "assistant"):
            go(i, cost + 2, audit + "I", roles + role[0], [*lines, f"{role}:"])
        if i == len(rows):
            return
        _, own, text = rows[i]
        go(i + 1, cost + 3, audit + "D", roles, lines)
        if faults[i] in (0, 3):
            more = faults[i] == 3
            go(i + 1, cost + more, audit + "K", roles + (own[:1] or "-"), [*lines, f"{own}:{text}"])
            for role in ("user", "assistant"):
                go(i + 1, cost + more + 2, audit + "R", roles + role[0], [*lines, f"{role}:{text}"])

    go(0, 0, "", "", [])
    best = min(found)
    assert len({x for x in found if x[:2] == best[:2]}) == 1
    return best


def plain(rows):
    out = []
    for conv, own in plain_damage(rows).items():
        faults = plain_faults(own)
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, text = plain_repair(own, faults)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *(faults.count(x) for x in (1, 2, 3)), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def made(n, seed):
    r = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "speaker"]
    texts = ["Yes.", "No", "well?", "", " \t", "Да!", "a. ", "b.\x85", None, "same.", "same."]
    rows = []
    for conv in range(n):
        turn = r.choice([0, 5, -3])
        for _ in range(r.randrange(1, 7)):
            rows.append((conv if conv else None, r.choice([turn, turn, None]) if r.random() < 0.1 else turn, r.choice(roles[:5] if r.random() < 0.7 else roles), r.choice(texts)))
            turn += r.choice([1, 1, 1, 2])
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_against_every_sequence_of_edits(spark):
    rows = made(250, 3)
    docs = spark.createDataFrame(rows, SCHEMA)
    want = sorted(plain(rows), key=str)
    assert len({x[7] for x in want}) > 60 and any(x[7] == "" for x in want)
    for bounds in ({}, {"long": 3, "block": 2}, {"long": 0, "block": 1}):
        got = [tuple(x) for x in c.repair(docs, **bounds).collect()]
        assert sorted(got, key=str) == want


def test_long_conversations_in_blocks(spark):
    """Blocks give what one task gives, repeated rows and one text at many turns included."""
    r = random.Random(4)
    rows = [(1, t, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", f"{t}.", f"{t}!", ""])) for t in range(700)]
    rows += [(1, 350, "user", "hot.")] * 500 + [(2, None, None, None)] * 40 + [(3, 1, "user", "x.")] + [(4, i, "user", "same.") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = sorted(map(tuple, c.repair(docs, long=10_000).collect()))
    assert sorted(map(tuple, c.repair(docs, long=20, block=64).collect())) == want
    assert [x[0] for x in want] == [1, 2, 3, 4] and len(want[0][7]) > 900


def test_edges(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    wide = spark.createDataFrame([(dropped, 0, "user", "Hi.", 1, "x")], SCHEMA + ", cost int, audit string")
    empty = hashlib.sha256().hexdigest()
    for long in (0, 9):
        assert [tuple(x) for x in c.repair(wide, long=long).collect()] == [(dropped, 0, 0, 0, 0, 0, 0, "", empty)]
        assert c.repair(wide.limit(0), long=long).count() == 0
    kept = next(i for i in range(1000) if all(zlib.crc32(f"{i}:{t}".encode()) % 20 > 4 for t in (0, 1)))
    big = "long text " * 300_000 + "end."
    rows = [(kept, 0, "user", big), (kept, 1, "assistant", "Ok.")]
    for long in (0, 9):
        (x,) = c.repair(spark.createDataFrame(rows, SCHEMA), long=long).collect()
        assert (x.cost, x.audit) == (0, "KK") and x.repaired_sha256 == hashlib.sha256(f"user:{big}\nassistant:Ok.".encode()).hexdigest()


def test_weights_of_any_length():
    r = random.Random(9)
    for n in (0, 1, 2, 50, 200):
        rows = tuple((r.choice("usax"), r.randrange(4)) for _ in range(n))
        now = {0: (0, "")}
        for a in range(0, n, 7):
            now = c.folded(now, c.between(list(rows[a : a + 7])))
        assert c.end_of(now) == c.cheapest(rows)
