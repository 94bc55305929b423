import random

from tests.llm import brute

from annalist.llm import lines as L
from annalist.llm.queries import QUERIES


def sentences(rng, n):
    return [" ".join(f"w{rng.randrange(10**5)}" for _ in range(rng.randrange(3, 14))).capitalize() + "." for _ in range(n)]


def common_runs(a, b, counts, least):
    """Places of b in any common run of at least ``least`` words, by brute force."""
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(counts[j : j + n]) >= least:
                out.update(range(j, j + n))
    return out


def test_split_keeps_the_text():
    for t in ("", "a", "a\n", "\n\na.\nb", "One. Two! Three? Four.five 3.14\n\n x. \n", "x" * 1000 + ". " + "\n" * 5):
        assert "".join(L.split_lines(t)) == t


def test_patience_is_a_common_ordered_alignment():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.randrange(12) for _ in range(rng.randrange(15))] for _ in range(2))
        last = (0, 0)
        for i, j, n in L.patience(a, b):
            assert n and a[i : i + n] == b[j : j + n] and i >= last[0] and j >= last[1]
            last = (i + n, j + n)


def test_repeated_finds_every_long_block():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.randrange(200) for _ in range(rng.randrange(25))] for _ in range(2))
        for _ in range(3):
            if a:
                i, n = rng.randrange(len(a)), rng.randrange(1, 6)
                at = rng.randrange(len(b) + 1)
                b[at:at] = a[i : i + n]
        counts = [5] * len(b)
        got = {k for s, e in L.repeated(a, b, counts, 15) for k in range(s, e)}
        must = common_runs(a, b, counts, 15)
        assert got <= must
        left = [x for k, x in enumerate(b)]
        # what stays holds no whole common block any more
        rest, run = [], []
        for k, x in enumerate(left):
            if k in got:
                rest.append(run)
                run = []
            else:
                run.append(x)
        rest.append(run)
        assert not any(common_runs(a, r, [5] * len(r), 15) for r in rest)


def corpus():
    rng = random.Random(3)
    passages = [" ".join(sentences(rng, 9)) for _ in range(3)]
    rows = []
    for k in range(40):
        own = [" ".join(sentences(rng, 4)) for _ in range(3)]
        if k % 3 == 0:
            own.insert(rng.randrange(4), passages[k % 2])
        if k % 4 == 0:
            own[0] = own[0] + " " + passages[2]
        rows.append((k, "\n".join(own)))
    rows += [(50, rows[1][1]), (51, rows[1][1]), (52, "Short line.\nOther line."), (53, "Short line.\nOther line.")]
    return rows, passages


def test_planted_passages_and_copies_go_and_the_rest_stays(spark):
    rows, passages = corpus()
    out = {r.doc_id: r for r in L.line_dedup(brute.docs(spark, rows)).collect()}
    texts = dict(rows)
    for p in passages:
        held = [k for k, t in rows if p in t]
        assert len(held) > 5 and [k for k in held if p in out[k].text] == held[:1]
    for k, t in rows:
        if k not in (50, 51) and not any(p in t for p in passages):
            assert out[k].text == t and out[k].n_removed == 0 and out[k].shared_with == []
        # what is left of a document is what it had, without the passages
        rest = t
        for p in passages:
            if p in t and k != next(x for x, y in rows if p in y):
                rest = rest.replace(p, "")
        if k not in (50, 51):
            assert out[k].text.split() == rest.split()
    assert out[50].text.strip() == out[51].text.strip() == "" and out[50].shared_with == [1]
    assert out[53].text == texts[53]


def test_odd_rows(spark):
    out = L.line_dedup(brute.docs(spark)).collect()
    assert sorted(((r.doc_id or -1), r.text) for r in out if r.text is not None) == sorted((k or -1, t) for k, t in brute.ODD if t is not None)
    assert [r.text for r in out if r.doc_id == 900] == [None]
    assert L.line_dedup(brute.docs(spark, [])).count() == 0
    twice = L.line_dedup(brute.docs(spark, [(1, "word " * 30), (1, "word " * 30), (None, "word " * 30)])).collect()
    assert [r.n_removed for r in twice] == [0, 0, 0]


def test_query(spark, sf):
    docs = dict(tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op4_line_dedup"](spark, sf).collect()
    assert len(rows) == len(docs)
    tables = {k: [(h, c) for h, c in zip(*L.line_table(t)) if c] for k, t in docs.items()}
    seen, must = set(), {}
    for k in sorted(docs):
        h, c = [x for x, _ in tables[k]], [y for _, y in tables[k]]
        keys = L.run_keys(h, c, L.BLOCK_WORDS)
        must[k] = any(x in seen for x in keys)
        seen.update(keys)
    assert {r.doc_id: r.n_removed > 0 for r in rows} == must and any(must.values())


def window_model(docs, least):
    """Words of each document that no run of ``least`` words shared with an earlier one covers, by brute force."""
    seen, out = set(), {}
    for k in sorted(docs):
        own = docs[k].split()
        runs = [tuple(own[i : i + least]) for i in range(len(own) - least + 1)]
        gone = {j for i, x in enumerate(runs) if x in seen for j in range(i, i + least)}
        seen.update(runs)
        out[k] = [w for j, w in enumerate(own) if j not in gone]
    return out


def test_passages_inside_longer_lines_go(spark):
    rng = random.Random(7)
    word = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    passages = [word(n) for n in (60, 25, 24, 40)]
    docs = {}
    for k in range(24):
        own = word(30)
        for p in rng.sample(passages, 2):
            # parts of a passage as well, so that its owner differs from place to place
            a = rng.randrange(8) if k % 3 == 0 else 0
            own += p[a:] + [f"end{k}{rng.choice(('', '.', '\u3002'))}"] + word(rng.randrange(12))
        docs[k] = " ".join(own)
    docs[30] = docs[31] = "\n".join(" ".join(passages[0][i : i + 6]) + f" x{i}" for i in range(0, 60, 6))
    docs[32] = "Own start. " + " ".join(passages[3]).replace(" ", "  ", 5) + "\nOwn end."
    want = window_model(docs, L.BLOCK_WORDS)
    assert sum(len(x.split()) for x in docs.values()) > sum(map(len, want.values())) + 500
    out = {r.doc_id: r for r in L.line_dedup(brute.docs(spark, list(docs.items()))).collect()}
    assert {k: r.text.split() for k, r in out.items()} == want
    assert out[32].text == "Own start. \nOwn end." and out[32].n_cut == 40 and out[32].shared_with


def test_an_exact_copy_is_one_block():
    rng = random.Random(5)
    for _ in range(300):
        b = [rng.randrange(4) for _ in range(rng.randrange(1, 30))]
        counts = [h + 1 for h in b]
        aligned = [(j, j + n) for _, j, n in L.patience(b, b) if sum(counts[j : j + n]) >= 9]
        assert L.repeated(list(b), b, counts, 9) == aligned == ([(0, len(b))] if sum(counts) >= 9 else [])
