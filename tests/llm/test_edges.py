"""Packing against the plain rule, and rows that are null, repeated, empty, long or oddly named, operator by operator."""

import numpy as np
import pytest

pytest.importorskip("millrace.llm")

from pyspark.sql import functions as F  # noqa: E402

from millrace.llm import chat_format, decontaminate, packing, quality_ordinal, quality_rules, toxicity, url_reputation  # noqa: E402


@pytest.mark.parametrize("seed, capacity, most", [(0, 64, 63), (1, 64, 20), (2, 128, 100), (3, 32, 31)])
def test_packing_follows_the_sum_of_squares(seed, capacity, most):
    lengths = np.sort(np.random.default_rng(seed).integers(1, most + 1, 300))[::-1]
    _, offsets, gaps = packing.place(lengths, capacity)
    count: dict[int, int] = {}
    for n, offset in zip(lengths.tolist(), offsets.tolist(), strict=True):
        best = None
        for g in sorted(g for g, k in count.items() if k and g >= n):
            after = dict(count)
            after[g] -= 1
            if g > n:
                after[g - n] = after.get(g - n, 0) + 1
            cost = sum(k * k for k in after.values())
            if best is None or cost < best[0]:
                best = (cost, g)
        g = best[1] if best else capacity
        assert offset == capacity - g
        if g < capacity:
            count[g] -= 1
        if g > n:
            count[g - n] = count.get(g - n, 0) + 1
    assert sorted(x for x in gaps.tolist() if x) == sorted(g for g, k in count.items() for _ in range(k))


def test_url_edges(spark):
    long = "http://h.org/" + "a/" * 50_000
    rows = [(1, "http://h.org/1", "x", 1), (1, "http://h.org/1", "x", 1), (None, None, None, None), (2, long, "y", 2), (3, "http://bad.org/7", "z", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, a0 long")
    none = spark.createDataFrame([], "host string, bad int")
    got = url_reputation.judge(pages, none).collect()
    assert len(got) == 5 and all(r["verdict"] == "allow" for r in got) and sum(r["page_id"] == 1 for r in got) == 2
    assert next(r["path"] for r in got if r["page_id"] == 2) == long[len("http://h.org") :]
    assert url_reputation.judge(pages.where("false"), none).count() == 0
    bad = spark.createDataFrame([("bad.org", 1)] * 60 + [("h.org", 0)] * 60, "host string, bad int")
    at = {r["page_id"]: (r["verdict"], r["bad_bound"]) for r in url_reputation.judge(pages, bad).collect()}
    assert at[3][0] == "block" and at[1][0] == "allow"
    same = url_reputation.judge(pages, bad, tolerated=at[3][1]).where("page_id = 3").first()
    assert same["verdict"] == "allow"  # a bound that equals the tolerated rate


def test_letters_are_counted_alike_in_all_languages():
    names = quality_rules.BASE + quality_rules.MORE
    stats = lambda t: dict(zip(names, quality_rules.stats_of(t), strict=True))
    assert stats("HELLO WORLD 12")["n_letters"] == 10 and stats("HELLO WORLD 12 é")["n_letters"] == 11
    assert stats("HELLO ÉÀ 1,2")["n_upper"] == 7 and stats("ß é !")["n_upper"] == 0


def test_probe_meets_a_conversation_of_its_number(spark):
    turns = spark.createDataFrame([(-1, 2, "user", "mine"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(chat_format.with_probe(turns))).collect()}
    assert got[-1]["n_turns"] == 3 and not got[-1]["valid"] and got[None]["n_turns"] == 1


def test_empty_documents_have_no_hits(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k l m")], "item_id long, text string")
    assert decontaminate.report_query(docs.where("false"), bench).count() == 0
    assert decontaminate.report_query(docs, bench).first()["contaminated"]


def test_fitting_is_bounded_in_rows_and_features(spark):
    rows = [(k, f"{'good calm words' if k % 2 else 'bad ### words'} number{k}") for k in range(200)] + [(0, " ".join(f"w{j}" for j in range(5000)))]
    docs = spark.createDataFrame(rows + rows[:50], "doc_id long, text string")
    ratings = spark.createDataFrame([(k, k % 2) for k in range(200)] + [(None, 1)], "doc_id long, grade int")
    for most in (8_000, 20):
        for features in (8_000_000, 600):
            m = quality_ordinal.fit(docs, ratings, 2, most, features)
            kept = {r["doc_id"] for r in quality_ordinal.classify(docs, m).where("kept").collect()}
            assert {k for k in range(1, 200, 2)} <= kept and not {k for k in range(2, 200, 2)} & kept
    assert quality_ordinal.fit(docs, ratings, 2, 8_000, 1).weights.any() == False  # noqa: E712  not even one row fits in


def test_toxic_edges(spark):
    docs = spark.createDataFrame([(k, ("vile nasty filth " * 2 if k % 4 == 0 else "calm words here ") + f"and number{k}", "x") for k in range(400)] + [(None, "vile nasty filth", "x"), (900, None, "x"), (901, "", "x")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    m = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.report(docs, m).collect()}
    assert got[None]["predicted"] == 1 and got[900]["predicted"] == got[901]["predicted"] == 0
    assert all(got[k]["predicted"] == int(k % 4 == 0) for k in range(400))
    assert m.lam > 0 and m.k > 0 and all(s > 0 for s in m.stems.values())


def test_all_stages_take_odd_rows(spark, tmp_path):
    import corpus_pipeline

    text = "The quick brown fox jumps over the lazy dog while the sun sets behind the quiet hills of the old town "
    rows = [(1, text * 3, "a", "s", 1), (1, text * 3, "a", "s", 1), (2, None, None, None, None), (None, "no id at all here", "a", "s", 2), (3, "", "a", "s", 0), (4, text + "mail ann.lee7@example.com", "a", "s", 3), (5, "word " * 30_000, "a", "s", 4)]
    extra = "rated dropped bad_id bad_text spans matches gaps made __id at comp".split()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", *[F.lit(x).alias(x) for x in extra])
    spark.createDataFrame([(1, 1, 0), (4, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "another text that no document has, of some words and more of them than thirteen")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert sorted(out.columns) == sorted(docs.columns)
            path = str(tmp_path / f"stage{k}")
            out.write.parquet(path)
            docs = spark.read.parquet(path)
            kept = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert {1, 2, 3, 4, 5, None} >= set(kept) and 4 in kept
        else:
            assert {r["doc_id"] for r in out.collect()} == set(kept)
    assert "ann.lee7" not in kept[4]


def test_every_row_is_reported(spark):
    hit, clean = "a b c d e f g h i j k l m", "nothing of that here"
    rows = [(1, hit), (1, hit), (1, clean), (None, None), (None, None), (2, ""), (3, f"{hit} {hit} n o p q")]
    docs = spark.createDataFrame([(*r, 7, 8, "x") for r in rows], "doc_id long, text string, copies int, at int, `from` string")
    bench = spark.createDataFrame([(1, hit)], "item_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["n_hit"], r["contaminated"]) for r in decontaminate.report_query(docs, bench).collect()))
    assert got == [(0, 0, False), (0, 0, False), (1, 0, False), (1, 13, True), (1, 13, True), (2, 0, False), (3, 26, True)]
    many = spark.range(25_001).select(F.lit(5).alias("doc_id"), F.lit(hit).alias("text"))
    out = decontaminate.report_query(many, bench).groupBy("contaminated").count().collect()
    assert [tuple(r) for r in out] == [(True, 25_001)]


def test_ordinal_fit_is_a_minimum_of_the_plain_likelihood():
    """The cumulative-link likelihood, written out row by row; its finite differences vanish at what was fitted."""
    from math import exp, log

    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(["calm", "fair", "loud", "junk", "spam"], 6)) for _ in range(40)]
    grades = np.array([min(2, max(0, t.split().count("calm") + t.split().count("fair") - 1 + int(rng.integers(-1, 2)))) for t in texts])
    rows = [quality_ordinal.features(t) for t in texts]
    m = quality_ordinal.fit_rows(rows, grades, 3, epochs=1500)
    used = sorted({int(p) for places, _ in rows for p in places})

    def loss(weights, thresholds):
        total = 0.0
        for (places, values), g in zip(rows, grades, strict=True):
            s = sum(weights[int(p)] * v for p, v in zip(places, values, strict=True))
            below = lambda k: 0.0 if k < 0 else 1.0 if k >= len(thresholds) else 1 / (1 + exp(-(thresholds[k] - s)))  # noqa: B023, E731
            total -= log(max(1e-9, below(g) - below(g - 1))) / len(rows)
        return total + 0.5 * quality_ordinal.RIDGE * sum(w * w for w in weights.values())

    w, t, step = {p: float(m.weights[p]) for p in used}, [float(x) for x in m.thresholds], 1e-4
    slopes = [(loss(w | {p: w[p] + step}, t) - loss(w | {p: w[p] - step}, t)) / (2 * step) for p in used]
    slopes += [(loss(w, [x + step * (j == k) for j, x in enumerate(t)]) - loss(w, [x - step * (j == k) for j, x in enumerate(t)])) / (2 * step) for k in range(len(t))]
    assert t[0] < t[1] and max(map(abs, slopes)) < 5e-3
