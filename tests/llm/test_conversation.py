import hashlib
import random
import re
import zlib

import pytest

from marginalia.llm import conversation, queries

SPACE = " \t\n\x0b\x0c\r"
LAWFUL = re.compile(r"(s?(ua)+)?\Z")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        how = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if how == 1:
            text = ""
        elif how == 2:
            text = re.sub("[.!?]", "", text)
        elif how == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def ordered(rows):
    def key(r):
        return (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest())

    return sorted(rows, key=key)


def expected(rows):
    """Cheapest edits by trying everything: (cost, audit) from each place and string so far, as dynamic programming over states."""
    rows = ordered(rows)
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(SPACE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {}

    def options(i, state, inserts):
        if i == len(rows) and state in ("", "a"):
            yield 0, "", ()
        if inserts < 2:
            for letter, to in moves[state].items():
                if letter != "s":
                    c, a, t = solve(i, to, inserts + 1)
                    yield c + 3, "I" + a, (({"u": "user", "a": "assistant"}[letter], ""),) + t
        if i < len(rows):
            role, text = rows[i][2:]
            c, a, t = solve(i + 1, state, 0)
            yield c + 4, "D" + a, t
            if faults[i] not in ("blank", "duplicate"):
                more = 3 if faults[i] else 0
                if role[:1] in moves[state]:
                    c, a, t = solve(i + 1, moves[state][role[:1]], 0)
                    yield c + more, "K" + a, ((role, text),) + t
                for letter, to in moves[state].items():
                    if letter != "s":
                        c, a, t = solve(i + 1, to, 0)
                        yield c + 3 + more, "R" + a, (({"u": "user", "a": "assistant"}[letter], text),) + t

    def solve(i, state, inserts):
        if (i, state, inserts) not in best:
            best[i, state, inserts] = min(options(i, state, inserts), default=(10**9, "", ()), key=lambda x: x[:2])
        return best[i, state, inserts]

    for i in range(len(rows), -1, -1):
        for inserts in (2, 1, 0):
            for state in moves:
                solve(i, state, inserts)
    cost, audit, lines = solve(0, "", 0)
    turns = {r[1] for r in rows} - {None}
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    assert LAWFUL.match("".join(r[:1] for r, _ in lines))
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in ("su", "ua", "au") for p in pairs),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest(),
    }


def conversations(seed, n, most):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "uncle"]
    texts = ["Yes.", "No!", "Why?", "well", " \t\n", "", "Fine. \n", "no end ", None, "Ünd."]
    out = []
    for conv in [None, *range(n)]:
        for turn in range(rnd.randint(1, most)):
            row = (conv, rnd.choice([turn, turn, turn, turn, 2 * turn, 0, None]), rnd.choice(roles), rnd.choice(texts) if rnd.random() < 0.4 else f"text {turn}{rnd.choice('.!? ')}")
            out += [row] * (3 if rnd.random() < 0.05 else 1)
    return out


SCHEMA = "conv_id long, turn long, role string, text string, cost string"


def test_query_against_brute_force(spark, tmp_path):
    rows = conversations(5, 120, 9)
    spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation(spark, str(tmp_path)).collect()
    assert len(got) == 121
    for r in got:
        want = expected(damaged([x for x in rows if x[0] == r.conv_id]))
        assert {k: r[k] for k in want} == want, r.conv_id


@pytest.mark.parametrize("block", [1, 3, 50])
def test_blocks_join(spark, block):
    """Conversations cut into blocks come out as whole ones do."""
    rows = conversations(8, 4, 60)
    summary, lines = conversation.repair(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA), block=block)
    shas = {r.conv_id: r.sha for r in conversation.line_digests(lines).collect()}
    got = summary.collect()
    assert len(got) == 5
    for r in got:
        want = expected([(a, b, " " if c is None else c, " " if d is None else d) for a, b, c, d in rows if a == r.conv_id])
        for name in ("blank", "duplicate", "truncated", "illegal", "cost", "audit"):
            assert r[name] == want[name], (r.conv_id, name)
        assert shas.get(r.conv_id, hashlib.sha256(b"").hexdigest()) == want["repaired_sha256"]


def test_empty_table_and_nothing_left(spark, tmp_path):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/a/conversations.parquet")
    assert queries.op12_conversation(spark, f"{tmp_path}/a").collect() == []
    spark.createDataFrame([(gone, 0, "user", "Hi.", "")], SCHEMA).write.parquet(f"{tmp_path}/b/conversations.parquet")
    (row,) = queries.op12_conversation(spark, f"{tmp_path}/b").collect()
    assert (row.conv_id, row.cost, row.audit, row.gaps, row.repaired_sha256) == (gone, 0, "", 0, hashlib.sha256(b"").hexdigest())


def test_many_copies_of_a_row_and_long_texts(spark):
    long = "word " * 300_000 + "end."
    rows = [(1, 0, "user", "Hello.", "")] * 20_000 + [(1, 1, "assistant", long, "")]
    summary, lines = conversation.repair(spark.createDataFrame(rows, SCHEMA))
    row = summary.first()
    assert (row.duplicate, row.illegal, row.cost, row.audit) == (19_999, 19_999, 4 * 19_999, "K" + "D" * 19_999 + "K")
    assert conversation.line_digests(lines).first().sha == hashlib.sha256(f"user:Hello.\nassistant:{long}".encode()).hexdigest()


def test_extreme_turns(spark):
    rows = spark.createDataFrame([(1, -(2**63)), (1, 2**63 - 1), (2, None)], "conv_id long, turn long")
    assert {r.conv_id: r.gaps for r in conversation.gaps(rows).collect()} == {1: 2**63 - 1, 2: 0}
