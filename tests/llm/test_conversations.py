"""Operators 11 and 12 against plain versions: a dictionary of prefixes; every sequence of edits."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

import oracle
from dermotrace.llm import prefix_trie, turn_repair
from dermotrace.llm.common import scratch

TALK = "conv_id long, turn long, role string, text string, rank long, key string, part long, n long, depth long, initial string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 3, 4, "i") for r in rows], TALK)


def write(spark, folder, rows):
    frame(spark, rows).write.mode("overwrite").parquet(f"{folder}/conversations.parquet")
    return str(folder)


def ordered(rows, blank):
    """Turns of each conversation in order: nulls first, ties by digest."""
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = blank if role is None else role, blank if text is None else text
        out[c].append(((t is not None, t or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()), role, text, t))
    return {c: [x[1:] for x in sorted(v, key=lambda x: x[0])] for c, v in out.items()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_trie(convs):
    """Nodes of {conv_id: [(role, text)]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    rows = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(p))))
        rows.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(ends)))
    return Counter(rows)


def plain_rebuilt(rows):
    own = {c: [(r, x) for r, x, _ in v] for c, v in ordered(rows, "").items() if c is not None}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, int(c - (abs(c) % 100) * (1 if c >= 0 else -1))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie(spark, rows, block=prefix_trie.BLOCK):
    """The operator's nodes with the digest of each node's own conversations."""
    folder = scratch(spark, "test")
    nodes, ends, members = prefix_trie.prefix_trie(*prefix_trie.plain_turns(frame(spark, rows), folder), folder, block)
    reps = defaultdict(list)
    for r in members.collect():
        reps[r.rep].append(r.conv_id)
    own = {(r.conv_id, r.depth): ",".join(map(str, sorted(reps[r.rep]))) for r in ends.collect()}
    return Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, sha(own.get((r.conv_id, r.depth), ""))) for r in nodes.collect())


ROLES = ("user", "assistant", "system", None, "", "User", "useless")
TEXTS = ("Yes.", "No!", "And then", None, "", " \t", "é?", "a.\n", "Hello. There? ", "日本", "!", "\xa0")


def random_rows(seed, n=60, most=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample([*range(-30, 60), 100, 101, 102, 200, 205, 1_000_000_007, -205, -200], n):
        for t in range(rng.randrange(1, most + 1)):
            rows.append((c, rng.choice([t, t, t, t, None, 2, -1]), rng.choice(ROLES[:2] * 4 + ROLES), rng.choice(TEXTS[:3] * 3 + TEXTS)))
    rows += [(None, 0, "user", "of no conversation"), (None, None, None, None)] + rng.sample(rows, 9)
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def talk(spark, tmp_path_factory):
    rows = random_rows(1)
    return write(spark, tmp_path_factory.mktemp("talk"), rows), rows


def test_trie_query(spark, talk):
    got = prefix_trie.query(spark, talk[0])
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == plain_trie(plain_rebuilt(talk[1]))
    oracle.same(got, prefix_trie.SQL, talk[0])


def test_trie_of_copies_prefixes_and_a_long_chain(spark):
    """Copies of a long conversation are one chain; a prefix of it ends inside; digests of blocks of three turns."""
    long = [(t, "user" if t % 2 else "assistant", f"turn {t} {'x' * t}") for t in range(40)]
    rows = [(c, *x) for c in range(300) for x in long[:11]]
    rows += [(c, *x) for c in (5000, 4999, 9000) for x in long] + [(400, *x) for x in long[:9]] + [(401, *x) for x in long[:9]] + [(402, *long[0]), (402, 1, "user", "another way")]
    convs = {c: [(r, x) for r, x, _ in v] for c, v in ordered(rows, "").items()}
    assert trie(spark, rows, 3) == plain_trie(convs)


def test_trie_ends_are_a_stream(spark, monkeypatch):
    """Ids of a node in many rows, negative ones too."""
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    members = spark.createDataFrame([(1, c) for c in range(-37, 90)] + [(2, 7), (3, 5), (3, -5)], "rep long, conv_id long").repartition(5)
    got = {r.rep: r.ends_sha256 for r in prefix_trie._digests(members).collect()}
    assert got == {1: sha(",".join(map(str, range(-37, 90)))), 2: sha("7"), 3: sha("-5,5")}


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def faults(turns):
    seen, out = set(), []
    for role, text, _ in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(turns):
    """(cost, audit, repaired) by trying every edit of every turn and up to two insertions anywhere."""
    best, fault = None, faults(turns)
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    paths = {"": [(0, "", [])]}  # least by state, kept whole: all ties stay

    def insert(paths):
        out = defaultdict(list)
        for state, many in paths.items():
            for cost, audit, made in many:
                for add in inserts:
                    s = state
                    for role in add:
                        s = step.get((s, role[0]), None) if s is not None else None
                    if s is not None:
                        out[s].append((cost + 2 * len(add), audit + "I" * len(add), made + [f"{role}:" for role in add]))
        return {s: [x for x in v if x[0] == min(v)[0]] for s, v in out.items()}

    paths = insert(paths)
    for (role, text, _), f in zip(turns, fault):
        out = defaultdict(list)
        for state, many in paths.items():
            for cost, audit, made in many:
                out[state].append((cost + 3, audit + "D", made))
                if f not in ("b", "d"):
                    for edit, name, more in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                        if (s := step.get((state, name[:1]))) is not None:
                            out[s].append((cost + more + (f == "t"), audit + edit, made + [f"{name}:{text}"]))
        paths = insert({s: list({(c, a): (c, a, m) for c, a, m in v if c == min(v)[0]}.values()) for s, v in out.items()})
    return min((x for s in ("", "a") for x in paths.get(s, [])), key=lambda x: x[:2])


def walked_repair(turns):
    """(cost, audit, repaired) by one walk that keeps the least of each state, for long conversations."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    role = {"u": "user", "a": "assistant"}

    def insert(best):
        for _ in (0, 1):
            for state, (cost, audit) in list(best.items()):
                to = "a" if state == "u" else "u"
                best[to] = min(best.get(to, (cost + 3, "")), (cost + 2, audit + "I"))
        return best

    best = insert({"": (0, "")})
    for (name, _, _), f in zip(turns, faults(turns)):
        new = {s: (c + 3, a + "D") for s, (c, a) in best.items()}
        for state, (cost, audit) in best.items():
            for edit, by, more in (("K", name[:1], 0), ("R", "u", 2), ("R", "a", 2)):
                if f not in ("b", "d") and (to := step.get((state, by))) is not None:
                    one = (cost + more + (f == "t"), audit + edit)
                    new[to] = min(new.get(to, one), one)
        best = insert(new)
    cost, audit = min(best[s] for s in ("", "a") if s in best)
    made, state, rest = [], "", iter(turns)
    for edit in audit:
        name, text, _ = ("", "", None) if edit == "I" else next(rest)
        if edit != "D":
            to = name[0] if edit == "K" else "a" if state == "u" else "u"
            made.append(f"{name if edit == 'K' else role[to]}:{text}")
            state = to
    return cost, audit, made


def plain_rows(rows):
    after = ordered(plain_damage(rows), " ")
    out = []
    for c in {r[0] for r in rows}:
        turns = after.get(c, [])
        cost, audit, made = plain_repair(turns) if turns else (0, "", [])
        f, have = faults(turns), [t for _, _, t in turns if t is not None]
        odd = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        out.append((c, max(have) - min(have) + 1 - len(set(have)) if have else 0, f.count("b"), f.count("d"), f.count("t"), odd, cost, audit, sha("\n".join(made))))
    return Counter(out)


REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("run", [4096, 2])
def test_repair_query(spark, talk, monkeypatch, run):
    monkeypatch.setattr(turn_repair, "RUN", run)
    got = turn_repair.query(spark, talk[0])
    assert Counter(tuple(r[n] for n in REPAIR) for r in got.collect()) == plain_rows(talk[1])
    oracle.same(got, turn_repair.SQL, talk[0])


@pytest.mark.parametrize("seed", range(3))
def test_repair_of_random_talk(spark, seed, tmp_path):
    rows = [r for r in random_rows(seed + 10, 90, 9)]
    path = write(spark, tmp_path, rows)
    assert Counter(tuple(r[n] for n in REPAIR) for r in turn_repair.query(spark, path).collect()) == plain_rows(rows)


def test_repair_of_a_long_conversation(spark, monkeypatch):
    """A conversation over many tasks and runs: the tree gives what one walk over it gives, and its turns are written in order."""
    monkeypatch.setattr(turn_repair, "RUN", 50)
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system", "bot"]), rng.choice([f"Line {t}.", f"Line {t}", f"Line {t % 90}.", " "])) for t in range(2500)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(40) for t in range(4) if c != 7]
    folder, talk = scratch(spark, "test"), frame(spark, rows).repartition(9)
    plans = turn_repair.plans(talk, folder)
    got = {r.conv_id: r for r in plans.collect()}
    turns = ordered(rows, " ")[7]
    cost, audit, made = walked_repair(turns)
    f = faults(turns)
    assert (got[7].cost, got[7].audit, got[7].gaps) == (cost, audit, 0)
    assert (got[7].blank, got[7].duplicate, got[7].truncated) == (f.count("b"), f.count("d"), f.count("t"))
    assert got[7].illegal == sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    assert all((got[c].cost, got[c].audit) == (0, "KKKK") for c in got if c != 7)
    out = turn_repair.repaired_turns(talk, plans.select("conv_id", "audit")).where("conv_id = 7").orderBy("turn").collect()
    assert [f"{r.role}:{r.text}" for r in out] == made and [r.turn for r in out] == list(range(len(made)))


def test_both_plain_versions_agree():
    rng = random.Random(9)
    for _ in range(150):
        turns = [(rng.choice(["user", "assistant", "system", "bot"]), rng.choice(["A.", "B", " ", "C!"]), None) for _ in range(rng.randrange(1, 6))]
        assert plain_repair(turns) == walked_repair(turns)


def test_products_are_associative():
    rng = random.Random(2)
    for _ in range(200):
        a, b, c = (turn_repair.scan("".join(rng.choices("suaxSUAX-", k=rng.randrange(1, 7)))) for _ in range(3))
        assert turn_repair.product(turn_repair.product(a, b), c) == turn_repair.product(a, turn_repair.product(b, c))
