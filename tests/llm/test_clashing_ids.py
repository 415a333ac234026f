"""Near duplicates where an id stands for several texts."""

import collections

from mlqa.llm import probminhash

from llm_tables import docs_of  # noqa: F401


def test_every_text_of_a_clashing_id_has_its_class(docs_of):
    one, two, other = (" ".join(f"{c}{k}" for k in range(60)) for c in "abz")
    near = one + " end"
    rows = [(5, one), (5, two), (5, one), (7, near), (8, two), (3, near), (9, other), (9, other), (2, two + " end"),
            (4, None), (4, other)]
    got = collections.Counter((r.doc_id, r.class_id) for r in probminhash.near_duplicates(docs_of(rows)).collect())
    assert got == {(5, 3): 2, (5, 2): 1, (7, 3): 1, (8, 2): 1, (3, 3): 1, (9, 4): 2, (2, 2): 1, (4, 4): 2}
    kept = sorted((r.doc_id, r.text or "") for r in probminhash.keep_one(docs_of(rows, extra=False)).collect())
    assert kept == sorted([(3, near), (2, two + " end"), (4, other), (4, "")])


def test_different_texts_of_one_id_both_stay(docs_of):
    one, two = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(5, one), (5, two), (5, two), (6, two)]
    kept = sorted((r.doc_id, r.text) for r in probminhash.keep_one(docs_of(rows, extra=False)).collect())
    assert kept == [(5, one), (5, two)]
