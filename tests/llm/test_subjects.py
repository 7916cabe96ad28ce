import os
import random

import numpy as np
import pytest

from stayline.llm.subjects import Hasher, SubjectModel, fit, sentences, subject_areas, train

WORDS = {"heart": ["atrial fibrillation", "troponin", "metoprolol", "systolic murmur"], "kidney": ["hemodialysis", "proteinuria", "ureteral stone", "creatinine"], "mind": ["sertraline", "flat affect", "group therapy", "panic disorder"]}
FRAMES = ["Overnight, {} was noted.", "We discussed {} as the next step.", "Repeat testing confirmed {}.", "The exam showed {}, score 9 of 12."]
PASSING = ["Denies any history of {}.", "Family history is notable for {}.", "Remote mention of {}, resolved years ago."]
ROUTINE = ["No acute events.", "All questions were answered.", "Signed electronically."]


def document(r, areas):
    s = [r.choice(FRAMES).format(r.choice(WORDS[a])) for a in areas for _ in range(r.randrange(3, 7))]
    s += [r.choice(PASSING).format(r.choice(WORDS[r.choice(list(WORDS))])) for _ in range(r.randrange(0, 2))] + r.sample(ROUTINE, 1)
    r.shuffle(s)
    return " ".join(s)


def corpus(n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        areas = r.sample(list(WORDS), r.choice([0, 1, 1, 2]))
        out.append((document(r, areas), set(areas)))
    return out


def test_held_out_accuracy():
    learn = [x for x in corpus(500, 1) if x[1]]
    wrong = random.Random(9)
    noisy = [(t, {wrong.choice(list(WORDS))} if wrong.random() < 0.03 else a) for t, a in learn]
    m = fit([t for t, _ in noisy], [a for _, a in noisy], sorted(WORDS))
    s = m.shares([t for t, _ in corpus(300, 2)], Hasher())
    want = np.array([[a in ls for a in m.areas] for _, ls in corpus(300, 2)])
    got = s >= m.share - 1e-6
    tp, fp, fn = (got & want).sum(), (got & ~want).sum(), (~got & want).sum()
    assert tp / (tp + fp) > 0.9 and tp / (tp + fn) > 0.95  # documents about nothing, with one passing mention in two sentences, are the hard ones


def test_sentences():
    assert sentences("'A':\n  'Care Taker 3': 'Noted 5 mg.'\nFINDINGS:\n1. One. Two!\n\n'H': '3-2: 71'") == [["noted", "#", "mg"], ["one"], ["two"]]
    assert sentences("Am 7. Tag gut. Am 12. Tag besser.") == [["am", "#", "tag", "gut"], ["am", "#", "tag", "besser"]]
    assert sentences("") == [] and sentences("123 --- ...") == []


def test_features_are_per_sentence():
    a, sa = Hasher()([["x", "y"], ["z"]])
    b, sb = Hasher()([["x", "y"]])
    assert list(sa) == [0, 3] and list(a[:3]) == list(b) and len(a) == 4 and list(sb) == [0]


def test_model_without_labels_says_nothing():
    m = fit([], [], ["a", "b"])
    assert not (m.shares(["some words here", ""], Hasher()) > 0).any()


def test_spark_end_to_end(spark):
    data = corpus(300, 3)
    docs = spark.createDataFrame([(i, t, "s") for i, (t, _) in enumerate(data)] + [(1000, None, "s"), (1001, "", None), (1002, "x " * 50_000, None)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, a) for i, (_, ls) in enumerate(data[:150]) for a in ls] + [(5000, "heart"), (3, None)], "doc_id long, subject_area string")
    areas = spark.createDataFrame([(a, "d") for a in WORDS], "subject_area string, description string")
    m = train(docs, labels, areas, {"nothing": "heart"})
    assert isinstance(m, SubjectModel) and m.areas == sorted(WORDS)
    got = {(r.doc_id, r.subject_area) for r in subject_areas(docs, m).collect()}
    want = {(i, a) for i, (_, ls) in enumerate(data) for a in ls}
    assert len(got & want) / len(want) > 0.93 and len(got & want) / len(got) > 0.8  # from 150 documents
    assert subject_areas(docs.limit(0), m).count() == 0
    with pytest.raises(ValueError):
        subject_areas(docs.drop("text"), m)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_held_out_labels_of_the_tables():
    """A quarter of the labelled documents held out: precision and recall against the labels as given, some of which are wrong."""
    import pandas as pd

    from stayline.llm.queries import SOURCE_AREAS

    sf = "/root/testdata/sf0.1"
    d = pd.read_parquet(f"{sf}/documents.parquet", columns=["doc_id", "text", "source"]).dropna(subset=["text"])
    per = pd.read_parquet(f"{sf}/subject_labels.parquet").dropna().drop_duplicates().groupby("doc_id").subject_area.agg(set)
    areas = sorted(pd.read_parquet(f"{sf}/subject_areas.parquet").subject_area.unique())
    rows = [(t, per[i], 1.0) for i, t in zip(d.doc_id, d.text) if i in per.index]
    learn, test = [r for k, r in enumerate(rows) if k % 4], rows[::4]
    kind = d.source.str.lower().str.strip()
    for s, a in SOURCE_AREAS.items():
        learn += [(t, {a}, 0.5) for t in d[(kind == s) & ~d.doc_id.isin(per.index)].head(300).text]
    m = fit([t for t, _, _ in learn], [x for _, x, _ in learn], areas, [c for _, _, c in learn])
    got = m.shares([t for t, _, _ in test], Hasher()) >= m.share - 1e-6
    want = np.array([[a in x for a in areas] for _, x, _ in test])
    tp = (got & want).sum()
    assert tp / got.sum() > 0.9 and tp / want.sum() > 0.9, (tp / got.sum(), tp / want.sum())
