import os
import random

import pytest
from pyspark.sql import functions as F

from stayline.llm.contamination import ItemIndex, LeakRules, leaked_spans, remove_spans, words


def text(n, seed):
    r = random.Random(seed)
    return [f"w{r.randrange(400)}" for _ in range(n)]


ITEM = text(120, 1)
FILL = text(300, 2)


def found(doc, rules=LeakRules()):
    return {s[0] for s in ItemIndex.build([(7, " ".join(ITEM))], rules).search(" ".join(doc))}


@pytest.mark.parametrize("n,leak", [(24, False), (25, True), (60, True)])
def test_length_of_the_run(n, leak):
    assert (found(FILL[:100] + ITEM[30 : 30 + n] + FILL[100:]) == {7}) == leak


def test_isolated_edits_are_let_go():
    run = ITEM[10:60]
    for k in range(7, 50, 8):
        run[k] = "changed"
    assert found(FILL + run) == {7}
    dropped = [w for i, w in enumerate(ITEM[10:60]) if i % 9 != 8]
    assert found(dropped + FILL) == {7}
    added = [x for i, w in enumerate(ITEM[10:60]) for x in ([w, "very"] if i % 8 == 7 else [w])]
    assert found(FILL[:50] + added) == {7}


def test_two_short_runs_are_no_run():
    assert found(FILL[:50] + ITEM[10:30] + FILL[50:60] + ITEM[30:50] + FILL[60:]) == set()
    assert found(ITEM[10:30] + ["x", "y", "z"] + ITEM[33:53]) == set()
    assert found(ITEM[10:30] + ITEM[60:80]) == set()


def test_case_punctuation_spacing_line_marks():
    doc = " ".join(FILL) + "\n" + "\n> ".join(w.upper() + "," for w in ITEM[20:50])
    assert {s[0] for s in ItemIndex.build([(7, " ".join(ITEM))], LeakRules()).search(doc)} == {7}


def test_brute_force_on_random_texts():
    """Runs without edits: found exactly where the longest common run of words has the length."""
    r = random.Random(5)
    rules = LeakRules(min_words=12, seeds=3)
    for _ in range(60):
        item = [f"v{r.randrange(30)}" for _ in range(40)]
        doc = [f"v{r.randrange(30)}" for _ in range(60)]
        if r.random() < 0.6:
            a, n = r.randrange(20), r.randrange(6, 20)
            doc[10 : 10 + n] = item[a : a + n]
        best = max((k for i in range(40) for j in range(60) for k in [next((k for k in range(41) if i + k >= 40 or j + k >= 60 or item[i + k] != doc[j + k]), 0)]), default=0)
        got = bool(ItemIndex.build([(1, " ".join(item))], rules).search(" ".join(doc)))
        assert got or best < 12


class Whole(ItemIndex):
    """Without a prefilter: every pair of words is looked at."""

    def candidates(self, x, first):
        return {k: {i: [] for i in range(len(self.items))} for k in range(len(first))}


def test_three_words_changed_of_25():
    run = ITEM[40:65]
    for k in (3, 7, 21):
        run[k] = "changed"
    assert found(FILL[:100] + run + FILL[100:]) == {7}


def test_prefilter_loses_no_run_with_isolated_edits():
    """Changed, added and dropped words at least three equal words apart: the same runs as without a prefilter."""
    r = random.Random(3)
    runs = 0
    for _ in range(400):
        item, around = ([f"v{r.randrange(60)}" for _ in range(80)] for _ in range(2))
        at, n = r.randrange(50), r.randrange(25, 30)
        doc, k = [], r.randrange(1, 4)
        for i, w in enumerate(item[at : at + n]):
            edit = "cad"[r.randrange(3)] if i == k and i < n - 1 else ""
            k += r.randrange(4, 9) if edit else 0
            doc += {"": [w], "c": ["new"], "a": ["new", w], "d": []}[edit]
        text, rows = " ".join(around[:40] + doc + around[40:]), [(1, " ".join(item))]
        want = Whole.build(rows, LeakRules()).search(text)
        runs += bool(want)
        assert sorted(ItemIndex.build(rows, LeakRules()).search(text)) == sorted(want)
    assert runs > 300


@pytest.mark.parametrize("every", [4, 5, 7])
def test_prefilter_loses_no_run_with_a_regular_share_of_edits(every):
    """Every fourth, fifth, seventh word changed, over runs of 30 to 60 words, and several texts searched at once."""
    r = random.Random(every)
    texts, rows = [], [(k, " ".join(f"v{r.randrange(90)}" for _ in range(100))) for k in range(6)]
    for _ in range(40):
        _, item = rows[r.randrange(6)]
        at, n = r.randrange(40), r.randrange(30, 60)
        run = [("new" if i % every == every - 1 else w) for i, w in enumerate(item.split()[at : at + n])]
        texts.append(" ".join([f"v{r.randrange(90)}" for _ in range(r.randrange(80))] + run + [f"v{r.randrange(90)}" for _ in range(50)]))
    texts[5], texts[9] = "", "one"
    got, want = (sorted(c.build(rows, LeakRules()).search_all(texts)) for c in (ItemIndex, Whole))
    assert got == want and len({x[0] for x in got}) >= 36
    assert got == sorted((k, *x) for k, t in enumerate(texts) for x in ItemIndex.build(rows, LeakRules()).search(t))


def test_words_keep_their_places():
    t = "Ａ straße İx—don't stop ___ ﬁn"
    w, a, b = words(t)
    assert len(w) == len(a) == len(b) and all(0 <= x < y <= len(t) for x, y in zip(a, b)) and t[a[1] : b[1]] == "straße"


def frames(spark):
    item = " ".join(ITEM)
    docs = [(1, "clean " + " ".join(FILL)), (2, "Head. " + " ".join(ITEM[5:70]) + " tail."), (3, None), (4, ""), (5, " ".join(FILL * 300 + ITEM[:30])), (2, "Head. " + " ".join(ITEM[5:70]) + " tail.")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, "too short"), (7, item)], "item_id long, text string")
    return d, i


@pytest.mark.parametrize("chars", [8_000_000, 300])
def test_spans_over_blocks_of_items(spark, chars):
    d, i = frames(spark)
    got = leaked_spans(d, i, block_chars=chars)
    assert sorted({(r.doc_id, r.item_id) for r in got.collect()}) == [(2, 7), (5, 7)] and got.where("doc_id = 2").count() == 2
    assert leaked_spans(d.limit(0), i).count() == 0 and leaked_spans(d, i.limit(0)).count() == 0


def test_removal(spark):
    d, i = frames(spark)
    got = {r.doc_id: r for r in remove_spans(d, leaked_spans(d, i)).collect()}
    assert got[2].text == "Head.  tail." and got[1].n_removed == 0 and got[1].text.startswith("clean") and got[3].text is None and got[4].text == ""
    assert 2 not in {r.doc_id for r in remove_spans(d, leaked_spans(d, i), min_left=0.5).collect()}
    s = spark.createDataFrame([(1, 0, 3), (1, 2, 6), (1, 9, 12)], "doc_id long, start_char int, end_char int")
    one = spark.createDataFrame([(1, "abcdefghijkl")], "doc_id long, text string")
    assert remove_spans(one, s).first().text == "ghi"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_the_tables_give_what_verification_of_every_pair_gives(spark):
    """All documents of the smallest tables against all items without a prefilter; and every verbatim run of 25 words is among the leaks found."""
    from stayline.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if r.text]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/eval_items.parquet").select("item_id", "text").collect() if r.text]
    got = {(r.doc_id, r.item_id) for r in queries.R.queries["p8_found"](spark, sf).collect()}
    whole = Whole.build(items, LeakRules())
    assert got == {(docs[k][0], i) for k, i, *_ in whole.search_all([t for _, t in docs])}
    grams = {}
    for i, t in items:
        w = words(t)[0]
        for a in range(len(w) - 24):
            grams.setdefault(tuple(w[a : a + 25]), set()).add(i)
    exact = {(d, i) for d, t in docs for w in [words(t)[0]] for a in range(len(w) - 24) for i in grams.get(tuple(w[a : a + 25]), ())}
    assert exact and exact <= got
