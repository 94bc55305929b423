import random

from pyspark.sql import functions as F

from annalist.functions import similarity
from annalist.functions.similarity import best_window, best_windows, ratio
from annalist.operators import evidence as ev

CHUNK = (
    "Acme said on Monday that it will widen its cloud search service to further product groups from this spring. "
    "The firm wants to invest strongly in data centres to carry the wider search functions."
)


def locate(spark, pairs):
    df = spark.createDataFrame([(i, q, t) for i, (q, t) in enumerate(pairs)], "i int, raw_quote string, text string")
    return {r.i: r for r in ev.locate_quotes(df).collect()}


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_outcomes_by_closeness(spark):
    quotes = [
        "Acme said on Monday that it will widen its cloud search service",
        "ACME  said on Monday\n\nthat it will widen its cloud search service",
        "Acme said on Monday that it will extend its cloud search service",
        "A wholly different sentence on quarterly tax rules for bakeries.",
        "",
        "search",
        None,
    ]
    got = locate(spark, [(q, CHUNK) for q in quotes])
    assert [got[i].match_method for i in range(7)] == ["exact", "exact", "fuzzy_rapidfuzz", "rejected", "rejected", "rejected", "rejected"]
    assert [got[i].review_status for i in range(3)] == ["auto_valid"] * 3
    assert got[0].match_score == 1.0 and 0.85 <= got[2].match_score < 1
    assert got[3].matched_text is None and 0 < got[3].match_score < 0.6
    assert got[4].match_score == 0.0 and got[6].match_score == 0.0


def test_spans_map_back_through_runs_of_white_space_and_quotes(spark):
    text = "Said  \n\n “the new   service” opens　 in  spring for everyone"
    got = locate(spark, [('"THE new service" opens in spring', text)])[0]
    assert got.match_method == "exact"
    assert got.matched_text == "“the new   service” opens　 in  spring"
    assert text[got.start_offset : got.end_offset] == got.matched_text


def test_uncertain_matches_wait_for_review(spark):
    quote = "it will widen products of the cloud and of the search for groups this spring"
    got = locate(spark, [(quote, CHUNK)])[0]
    assert got.review_status == "pending" and not got.is_valid and got.matched_text is not None


def test_best_window_is_the_best_of_all_windows():
    rng = random.Random(1)
    for _ in range(60):
        a = "".join(rng.choice("abc d😀") for _ in range(rng.choice([1, 5, 20, 70])))
        b = "".join(rng.choice("abc de") for _ in range(rng.choice([20, 70, 130])))
        if len(a) >= len(b):
            continue
        m, n = len(a), len(b)
        windows = [(0, i) for i in range(1, m)] + [(i, i + m) for i in range(n - m + 1)] + [(i, n) for i in range(n - m + 1, n)]
        top = max(2 * lcs(a, b[s:e]) / (m + e - s) for s, e in windows)
        score, s, e = best_window(a, b)
        assert abs(score - top) < 1e-12
        assert abs(score - 2 * lcs(a, b[s:e]) / (m + e - s)) < 1e-12


def test_rows_of_like_lengths_are_searched_together(monkeypatch):
    rng = random.Random(2)
    quotes = ["".join(rng.choice("abcd ") for _ in range(rng.randint(40, 45))) for _ in range(200)]
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(200, 220))) for _ in quotes]
    passes, plain = [], similarity._strands
    monkeypatch.setattr(similarity, "_strands", lambda a, b: passes.append(1) or plain(a, b))
    together = best_windows(quotes, texts)
    assert len(passes) < 10
    assert together == [best_window(q, t) for q, t in zip(quotes, texts)]


def test_ratio_definition():
    assert ratio("", "") == 1.0 and ratio("a", "") == 0.0
    assert abs(ratio("lewenstein", "levenshtein") - 2 * lcs("lewenstein", "levenshtein") / 21) < 1e-12


def test_validation_adds_the_chunk_start(spark):
    events = spark.createDataFrame([(1, 7, "widen its cloud search service")], "event_id long, chunk_id long, raw_quote string")
    chunks = spark.createDataFrame([(7, CHUNK, 100)], "chunk_id long, text string, start_offset long")
    r = ev.validate_events(events, chunks).first()
    assert r.start_offset == 100 + CHUNK.index("widen") and r.is_valid
    assert ev.status_counts(ev.validate_events(events, chunks)).first().n == 1


def test_text_choice(spark):
    df = spark.createDataFrame([(True, "m", "r"), (False, "m", "r"), (None, "", "r")], "v boolean, m string, r string")
    got = df.select(ev.evidence_text(F.col("v"), F.col("m"), F.col("r")).alias("a"), ev.usable_text(F.col("m"), F.col("r")).alias("b")).collect()
    assert [(g.a, g.b) for g in got] == [("m", "m"), ("r", "m"), ("r", "r")]
