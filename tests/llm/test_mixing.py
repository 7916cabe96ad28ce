import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stayline.llm.mixing import TOKENIZERS, encoding, mix, water_fill

VOCAB = os.path.join(TOKENIZERS, "byte_bpe_50k.tiktoken")


def test_water_filling():
    s = {x.source: x for x in water_fill({"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 9), "none": (0.1, 3)}, {"a": 10, "b": 100, "c": 100})}
    assert s["a"].tokens == 10 and s["none"].tokens == 0 and s["b"].tokens == pytest.approx(120) and s["c"].tokens == pytest.approx(80)
    assert sum(x.tokens for x in water_fill({"a": (1, 1), "b": (1, 1)}, {"a": 3, "b": 4}, 100)) == 7
    assert [x.tokens for x in water_fill({"a": (0.0, 5), "b": (1.0, 5)}, {"a": 3, "b": 4})] == [0.0, 7.0]
    with pytest.raises(ValueError):
        water_fill({"a": (-1, 1)}, {"a": 1})
    assert water_fill({}, {}) == []


@settings(max_examples=200)
@given(st.dictionaries(st.sampled_from("abcdef"), st.tuples(st.integers(0, 9), st.integers(0, 5), st.integers(0, 1000)), min_size=1), st.integers(0, 5000))
def test_no_cap_is_passed_and_shares_hold_among_the_free(spec, total):
    got = water_fill({s: (w, r) for s, (w, r, _) in spec.items()}, {s: n for s, (_, _, n) in spec.items()}, total)
    assert all(x.tokens <= x.cap * x.size + 1e-6 for x in got) and sum(x.tokens for x in got) <= total + 1e-6
    free = [x for x in got if x.target > 0 and x.tokens < x.cap * x.size - 1e-6]
    rates = [x.tokens / x.target for x in free]
    assert not rates or max(rates) - min(rates) < 1e-6 * (1 + max(rates))
    if free:
        assert sum(x.tokens for x in got) == pytest.approx(total)


@pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary")
def test_mixture(spark):
    e = encoding(VOCAB)
    docs = [(i, f"word {i} " * (1 + i % 9), [" A ", "a", "B", "c", None][i % 5]) for i in range(500)] + [(900, None, "a"), (901, "", "b"), (902, "<|endoftext|> x", "b")]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_tokens", F.lit("clash"))
    t = spark.createDataFrame([("A", 0.3, 1), ("b", 0.5, 3), ("C", 0.1, 5), ("zz", 0.1, 5)], "source string, target_share double, max_repeats int")
    m, report = mix(d, t)
    got, rep = m.collect(), {r.source: r for r in report.collect()}
    size = {r.doc_id: r.n_tokens for r in got}
    assert size[2] == len(e.encode_ordinary(docs[2][1]))
    assert {r.source for r in got} <= {"a", "b", "c"} and max(r.repeats for r in got if r.source == "a") == 1 and max(r.repeats for r in got) <= 3
    for s in "abc":
        used = sum(r.n_tokens * r.repeats for r in got if r.source == s)
        assert used == rep[s].tokens_used and abs(rep[s].actual_share - rep[s].feasible_share) < 0.01
    assert rep["zz"].tokens_used == 0 and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9
    again = {(r.doc_id, r.repeats) for r in mix(d.repartition(7), t)[0].collect()}
    assert again == {(r.doc_id, r.repeats) for r in got}
    m, report = mix(d.limit(0), t)
    assert m.count() == 0 and {r.actual_share for r in report.collect()} == {None}


@pytest.mark.skipif(not os.path.exists(VOCAB) or not os.path.isdir("/root/testdata/sf0.01"), reason="no vocabulary or tables")
def test_shares_reached_on_the_tables(spark):
    """Feasible shares equal those of a plain bisection over the fill level; what is reached differs by a document's size at most; no cap is passed."""
    from stayline.llm import queries

    e, sf = encoding(VOCAB), "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()
    size, longest = {}, 0
    for r in docs:
        if r.source is not None and r.text is not None:
            n = len(e.encode_ordinary(r.text))
            size[r.source.strip().lower()] = size.get(r.source.strip().lower(), 0) + n
            longest = max(longest, n)
    want = {r.source.strip().lower(): (r.target_share, r.max_repeats) for r in spark.read.parquet(f"{sf}/mix_targets.parquet").collect()}
    total, lo, hi = sum(size.get(s, 0) for s in want), 0.0, 1e12
    fill = lambda x: {s: min(w * x, r * size.get(s, 0)) for s, (w, r) in want.items()}
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(fill(mid).values()) < total else (lo, mid)
    level = fill(lo)
    rep = {r.source: r for r in queries.R.queries["p9_report"](spark, sf).collect()}
    assert set(rep) == set(want)
    for s, tokens in level.items():
        assert rep[s].tokens_there == size.get(s, 0) and abs(rep[s].feasible_share - tokens / sum(level.values())) < 1e-5
        assert -1 <= tokens - rep[s].tokens_used <= longest and rep[s].most_repeats <= want[s][1]
        assert abs(rep[s].actual_share - rep[s].feasible_share) < 2 * longest / total
