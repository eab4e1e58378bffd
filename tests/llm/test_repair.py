import itertools
import random
import re
import zlib
from hashlib import md5, sha256

from vacantia.llm import repair

SPACE = " \t\n\v\f\r"


def cheapest(rows):
    """Least (cost, audit, repaired) by trying every row with every edit; rows: (role, text, fault)."""
    sound = {}
    for has_s in (False, True):
        for pairs in range(len(rows) + 2):
            if pairs or not has_s:
                sound["s" * has_s + "ua" * pairs] = True
    found = []
    most = [10**9]

    def go(i, roles, cost, audit, out):
        if cost > most[0] or len(roles) > len(rows) + 4 or not any(k.startswith(roles) for k in sound):
            return
        if i == len(rows):
            if roles in sound:
                found.append((cost, audit, out))
                most[0] = min(most[0], cost)
        for r, name in (("u", "user"), ("a", "assistant")):
            go(i, roles + r, cost + 5, audit + "I", (*out, (name, "")))
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, roles, cost + 2, audit + "D", out)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, roles + role[:1], cost + more, audit + "K", (*out, (role, text)))
                for r, name in (("u", "user"), ("a", "assistant")):
                    go(i + 1, roles + r, cost + 1 + more, audit + "R", (*out, (name, text)))

    go(0, "", 0, "", ())
    return min(found)


def dynamic(rows):
    """The same by a table over rows and states, for longer conversations."""
    steps = repair.STEPS
    at = {0: (0, "", ())}

    def insertions(at):
        for _ in range(3):
            for (p, r), q in steps.items():
                if r != "s" and p in at:
                    c, a, o = at[p]
                    new = (c + 5, a + "I", (*o, ({"u": "user", "a": "assistant"}[r], "")))
                    if q not in at or new < at[q]:
                        at[q] = new
        return at

    at = insertions(at)
    for role, text, fault in rows:
        new = {}
        for p, (c, a, o) in at.items():
            options = [(p, (c + 2, a + "D", o))]
            if fault not in ("blank", "duplicate"):
                c += 5 * (fault == "truncated")
                options += [(q, (c, a + "K", (*o, (role, text)))) for (s, r), q in steps.items() if s == p and r == role[:1]]
                options += [(q, (c + 1, a + "R", (*o, ({"u": "user", "a": "assistant"}[r], text)))) for (s, r), q in steps.items() if s == p and r != "s"]
            for q, x in options:
                if q not in new or x < new[q]:
                    new[q] = x
        at = insertions(new)
    return min(at[q] for q in (0, 3) if q in at)


def brute(table, damage=True):
    convs = {}
    for conv, turn, role, text in table:
        rows = convs.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        same = lambda r, c=conv: md5(f"{' ' if c is None else c}:{len(r[1].encode())}:{r[1]}{r[2]}".encode()).hexdigest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], same(r)))
        n, seen, marked = dict.fromkeys(("blank", "duplicate", "truncated", None), 0), set(), []
        for _, role, text in rows:
            t = text.strip(SPACE)
            fault = "blank" if not t else "duplicate" if (role, text) in seen else None if t[-1] in ".!?" else "truncated"
            seen.add((role, text))
            n[fault] += 1
            marked.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
        cost, audit, said = dynamic(marked)
        digest = sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=str)


def test_cells_hold_the_cheapest_repair():
    rng = random.Random(4)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool"]), f"t{i}", rng.choice([None, None, "blank", "truncated"])) for i in range(rng.randrange(6))]
        symbols = "".join("d" if f == "blank" else (lambda x: x.upper() if f else x)(r[0] if r[0] in "sua" else "x") for r, _, f in rows)
        cost, audit, said = cheapest(rows)
        assert repair.best(repair.parsed(symbols)) == (cost, audit) == dynamic(rows)[:2]
        assert tuple(repair.repaired(audit, iter([(r, t) for r, t, _ in rows]))) == said


def test_any_split_gives_the_same_cells():
    rng = random.Random(5)
    for _ in range(50):
        s = "".join(rng.choices("suaxSUAXd", k=rng.randrange(2, 200)))
        k = rng.randrange(len(s))
        assert repair.parsed(s) == repair.combined(repair.parsed(s[:k]), repair.parsed(s[k:]))


def ours(df):
    return sorted((tuple(r) for r in repair.report(df).collect()), key=str)


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    expected = brute([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])
    assert ours(df) == expected
    assert {c for r in expected for c in r[7]} == set("KRD")  # a deletion is cheaper than an insertion


def test_odd_rows(spark):
    rng = random.Random(6)
    texts = [None, "", " \t", "Well.", "Well", "No end. ", "é!", "x" * 5000 + "?", "a\nb."]
    rows = [(rng.choice([1, 2, None]), rng.choice([None, 0, 1, 5, 9]), rng.choice([None, "", "system", "user", "assistant", "tool", "unit"]), rng.choice(texts)) for _ in range(150)]
    rows += [(100 + i, 0, "user", "Gone?") for i in range(60)]  # some lose their only row
    rows += [(7, i, "user" if i % 3 else "assistant", f"A long one {i}.") for i in range(900)] + [(8, 3, "user", "Twice.")] * 5
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, same int, head string")
    expected = brute(rows)
    assert any(r[7] == "" for r in expected)
    for n in (1, 3, 40):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        try:
            assert ours(df) == expected
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert ours(df.limit(0)) == []


def test_repaired_turns_are_sound(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = repair.repaired_turns(repair.damaged(df)).collect()
    said = {}
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["position"])):
        said[r["conv_id"]] = said.get(r["conv_id"], "") + r["role"][0]
    assert said and all(re.fullmatch("s?(ua)+", x) for x in said.values())
