"""Decontamination: what grows with the documents is not broadcast, and a document's windows are kept as the places where they start."""

import random

from pyspark.sql import functions as F

from verilens.llm import decontaminate


def passage(n, seed):
    return " ".join(random.Random(seed).choices([f"word{i}" for i in range(3000)], k=n))


def found(df):
    return sorted((str(r.doc), str(r.item), round(r.similarity, 9), r.start_word, r.n_words) for r in df.collect())


def tables(spark):
    items = [(1, passage(40, "a")), (2, passage(30, "b")), (None, passage(20, "c")), (4, passage(25, "d")), (5, None)]
    rnd = random.Random(5)
    rows = []
    for i in range(300):
        words = items[i % 4][1].split()
        if i % 3 == 0:
            words[rnd.randrange(len(words))] = "other"
        rows.append((None if i % 50 == 0 else i % 200, f"{passage(rnd.randint(0, 30), i)} {' '.join(words)} {passage(rnd.randint(0, 30), -i - 1)}"))
    rows += rows[:20] + [(900, passage(200, "none")), (901, ""), (902, None)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_what_grows_with_the_documents_is_not_broadcast(spark, monkeypatch):
    docs, items = tables(spark)
    want = found(decontaminate.matches(docs, items))
    n = len({(doc, start) for doc, _, _, start, _ in want})
    assert n > 150
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: (sent.append(df.columns), broadcast(df))[1])
    for most in (200 * n, 0):  # a digest takes 160 bytes, a row of windows over 200
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most, raising=False)
        sent.clear()
        assert found(decontaminate.matches(docs, items)) == want
        assert not [c for c in sent if "doc" in c] and (["digest"] in sent) == (most > 0)
    bad = {doc for doc, *_ in want}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and not [c for c in sent if "bad_doc" in c]
    kept = [r for r in kept.collect() if str(r.doc_id) not in bad]
    assert sorted(str(r) for r in kept) == sorted(str(r) for r in docs.collect() if str(r.doc_id) not in bad)


def test_windows_of_a_document_are_kept_as_their_starts(spark, monkeypatch):
    """A text that is one passage again and again has a window at each of its words; each costs a number, not a row."""
    item = passage(40, "again")
    text = " ".join([item] * 50)
    docs, items = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    made, stored = [], decontaminate.stored
    monkeypatch.setattr(decontaminate, "stored", lambda df, name: made.append(stored(df, name)) or made[-1])
    assert found(decontaminate.matches(docs, items)) == [("1", "7", 1.0, 0, 40)]
    assert made[0].select(F.max(F.length(F.to_json(F.struct(*made[0].columns))))).first()[0] < 8 * 2000


def test_parts_do_not_change_the_windows(spark, monkeypatch):
    docs, items = tables(spark)
    want = found(decontaminate.matches(docs, items, threshold=0.5))
    monkeypatch.setattr(decontaminate, "PART", 3, raising=False)
    assert found(decontaminate.matches(docs, items, threshold=0.5)) == want
