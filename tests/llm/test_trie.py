import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F
from tests.llm import brute

from annalist.llm import oracles, trie
from annalist.llm.queries import QUERIES

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256")


def rebuilt(rows):
    """{conv: [(role, text)]} by the rule, one conversation after another."""
    own = {}
    for c, n, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((n is not None, n or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def plain_trie(convs):
    """Rows of a trie grown turn by turn."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for path in members:
        if path:
            children.setdefault(path[:-1], []).append(path)

    def below(path):
        yield path
        for child in children.get(path, ()):
            yield from below(child)

    out = []
    for path, of in members.items():
        under = list(below(path))
        ends = sorted(c for c in of if len(convs[c]) == len(path))
        out.append((
            min(of), len(path), min(members[path[:-1]]) if path else None, len(of), len(children.get(path, ())),
            sum(x not in children for x in under), sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x), brute.sha(",".join(map(str, ends))),
        ))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, b"k") for r in rows], "conv_id long, turn long, role string, text string, depth int, key binary")


def got(spark, rows, rebuild=True, **limits):
    options = {"block": lambda c: c - c % 5, "head": lambda c: F.crc32(c.cast("string")) % 9} if rebuild else {}
    return sorted((tuple(r[c] for c in COLUMNS) for r in trie.trie(trie.steps(table(spark, rows), **options), **limits).collect()), key=str)


def random_rows(seed, convs, most, texts):
    rng = random.Random(seed)
    ids = rng.sample(range(convs * 2), convs)
    return [(c, n, rng.choice(["user", "assistant"][:texts]), rng.choice("aäb你"[:texts]) * rng.randint(0, 2)) for c in ids for n in range(rng.randint(1, most))]


@pytest.mark.parametrize("seed, convs, most, texts", [(1, 60, 12, 1), (2, 80, 6, 2), (3, 40, 20, 4)])
def test_equals_plain_trie(spark, seed, convs, most, texts):
    rows = random_rows(seed, convs, most, texts)
    assert got(spark, rows) == plain_trie(rebuilt(rows))
    own = {}
    for c, _, r, t in rows:
        own.setdefault(c, []).append((r, t))
    assert got(spark, rows, rebuild=False) == plain_trie(own)


@pytest.mark.parametrize("convs, turns, ids", [(3, 1000, 2), (1000, 10, 1), (1, 1, 1)])
def test_small_indexes_add_up(spark, convs, turns, ids):
    rows = random_rows(4, 70, 9, 2) + [(c, n, "user", "same") for c in range(500, 560) for n in range(3)]
    assert got(spark, rows, convs=convs, turns=turns, ids=ids) == plain_trie(rebuilt(rows))


def test_odd_rows(spark):
    rows = [
        (None, 0, "user", "no conversation"), (5, None, None, None), (5, 1, "user", ""), (5, 1, "user", ""), (6, 0, "user", "x"), (-7, 3, "user", "é" * 3000),
        (-10, 0, "user", "lead"), (8, 0, "a", "bc"), (9, 0, "ab", "c"), (2**62, 0, "user", "x"), *[(10, n, "user", "long") for n in range(400)],
    ]
    own = {}
    for c, n, r, t in rows:
        if c is not None:
            own.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    assert got(spark, rows, rebuild=False) == plain_trie({c: [x[2:] for x in sorted(v)] for c, v in own.items()})
    kept = [r for r in rows if r[0] is None or r[0] >= 0]  # below zero, remainders differ between languages
    assert got(spark, kept) == plain_trie(rebuilt(kept))
    assert got(spark, [r for r in rows if r[0] is None]) == []


def test_turnless_conversations_and_sql(spark, sf):
    rows = [(c, 0, "user", "one") for c in range(1, 60) if c % 5]
    expected = plain_trie(rebuilt(rows))
    assert got(spark, rows) == expected and [r for r in expected if not r[1]][0][-1] != brute.sha("")
    con = duckdb.connect()
    con.register("conversations", table(spark, rows).select("conv_id", "turn", "role", "text").toPandas())
    names = [*COLUMNS[:6], "saved_tokens", COLUMNS[-1]]
    assert sorted((tuple(r) for r in con.sql(f"SELECT {', '.join(names)} FROM ({oracles.TRIE})").fetchall()), key=str) == expected
    con.sql(f"CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    mine = QUERIES["op12_trie"](spark, sf).select(names).collect()
    assert sorted(map(tuple, mine), key=str) == sorted((tuple(r) for r in con.sql(f"SELECT {', '.join(names)} FROM ({oracles.TRIE})").fetchall()), key=str)
