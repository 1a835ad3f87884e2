"""The pipeline's stages against plain statements of what they do."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from silvaframe.llm import mixing, pieces, secrets


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice(["ka", "lo", "mi", "the", "an"]) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, text(rng.randint(20, 60)), rng.choice(["en", None]), rng.choice("aaab"), 0) for i in range(60)]
    rows += [(100 + i, rows[i][1], "en", "a", 0) for i in range(10)] + [(200, "1234 !", "en", "a", 0), (201, None, "en", "a", 0), (202, "", "en", "b", 0), (3, rows[3][1], rows[3][2], rows[3][3], 0)]
    rows += [(300, text(30) + " password = x7Kp9QmZ2vLr8TnB", "en", "b", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")

    one = cp.language_id(spark, frame, "").cache()
    ids = lambda df: collections.Counter(r.doc_id for r in df.collect())
    assert ids(one) == ids(frame) - collections.Counter([200, 201, 202]) and one.columns == frame.columns
    assert one.where("lang is null").count() == 0
    two = cp.jaccard_join(spark, one, "").cache()
    assert ids(two) == collections.Counter([*range(60), 300]) and two.columns == frame.columns
    three = cp.secret_scan(spark, two, "").cache()
    texts = {r.doc_id: r for r in two.collect()}
    for r in three.collect():
        want = secrets.redact(texts[r.doc_id].text, [(a, b) for _, a, b in secrets.scan(texts[r.doc_id].text, 40.0, secrets.Guesser(secrets.read_words()))[0]])
        assert r.text == want and r.n_chars == len(want)
    assert three.where("text like '%[SECRET]%'").count() == 1
    four = cp.source_mixing(spark, three, "").cache()
    copies = {r.doc_id: r.copies for r in mixing.mix_sources(three).collect()}
    assert ids(four) == +collections.Counter(copies) and four.columns == frame.columns
    five = cp.sentencepiece(spark, four, "").collect()
    p = pieces.Pieces(open(pieces.MODEL, "rb").read())
    kept = {r.doc_id: r.text for r in four.collect()}
    assert len(five) == four.count() and all(r.ids == p.encode(kept[r.doc_id]) and r.round_trip for r in five)
    assert sorted(r.doc_id for r in cp.run(spark, str(tmp_path)).collect()) == sorted(r.doc_id for r in five)
    assert [n for n, _ in cp.STAGES] == ["language_id", "jaccard_join", "secret_scan", "source_mixing", "sentencepiece"]


def test_rows_keep_apart_whatever_their_ids(spark):
    """Null and repeated ids: no row goes for another's sake, and no copy stays."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    text = lambda n: " ".join(word() for _ in range(n))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    row = lambda i, t, s="a": (i, t, "en", s, len(t))
    copy, other, twins = text(40), text(40), [text(40), text(40)]
    rows = [row(None, copy), row(None, copy), row(9, copy), row(None, other), row(None, other), row(5, twins[0]), row(5, twins[1]), row(None, text(40))]
    kept = collections.Counter((r.doc_id, r.text) for r in cp.jaccard_join(spark, spark.createDataFrame(rows, schema), "").collect())
    assert kept == collections.Counter([(9, copy), (None, other), (5, twins[0]), (5, twins[1]), (None, rows[7][1])])

    rows = [row(i % 3 or None, text(rng.randint(1, 9)), rng.choice("aaaaaab")) for i in range(200)] + [row(None, "")]
    frame = spark.createDataFrame(rows, schema)
    taken = collections.Counter((r.doc_id, r.text) for r in cp.source_mixing(spark, frame, "").collect())
    want = collections.Counter()
    for r in mixing.mix_sources(frame, row_col="text").collect():
        want[r.doc_id, r.text] += r.copies
    assert taken == +want and {want[i, t] for i, t, *_ in rows if i is None} > {0, 1}
    # a source's numbers of copies differ by one at most, and its tokens keep to its quota
    spread = collections.defaultdict(set)
    for r in mixing.mix_sources(frame, row_col="text").where("n_tokens > 0").collect():
        spread[r.source].add(want[r.doc_id, r.text])
    assert all(max(s) - min(s) <= 1 for s in spread.values())


def test_stages_leave_clashing_columns_alone(spark):
    """Columns named as what the stages use inside, null and repeated ids, and an empty table."""
    names = ["_row", "_copies", "_copy", "component_id", "n_tokens", "lang_pred", "score", "c0", "key", "ids", "hash"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    texts = [f"word{i} kaloka minola {i * 7} tuvo renak {i % 3} sopi" for i in range(12)] + ["same text of eight words in all here"] * 3
    rows = [(None if i % 5 == 0 else i % 4, t, "en", "s", len(t), *[f"{c}{i}" for c in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    for stage in (cp.jaccard_join, cp.secret_scan, cp.source_mixing):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert set(got) <= set(rows) and len({r[1] for r in got}) == len({r[1] for r in rows})
        assert stage(spark, docs.limit(0), "").count() == 0


def test_language_stage_leaves_columns_and_unlabelled_corpora_alone(spark):
    """Clashing names, null ids and repeated rows; a corpus without any label passes whole; rejected are only rows without letters."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score string, c0 string, c1 string, hash string"
    texts = ["the quick brown fox jumps over the lazy dog again and again"] * 2 + [f"word{i} and other words of the text number {i}" for i in range(30)] + [None, "", "½ ² ①", "Ⅷ 12"]
    rows = [(None if i % 5 == 0 else i % 4, t, "en", "s", len(t or ""), "p", "q", "r", "s", "t") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, schema)
    out = cp.language_id(spark, docs, "")
    assert out.columns == docs.columns
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter(r for r in rows if r[1] and any(c.isalpha() for c in r[1]))
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert collections.Counter(map(tuple, cp.language_id(spark, bare, "").collect())) == collections.Counter(map(tuple, bare.collect()))
    assert cp.language_id(spark, docs.limit(0), "").count() == 0
    last = cp.sentencepiece(spark, docs, "").collect()
    assert len(last) == len(rows)


def test_junk_labels_are_refused(spark, monkeypatch):
    from silvaframe.llm import langid

    monkeypatch.setattr(langid, "LANGUAGES", 5)
    docs = spark.createDataFrame([(i, f"some words here {i}", f"l{i}") for i in range(40)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="more than 5"):
        langid.train(docs, F.lit(True))
    assert langid.train(docs.where("doc_id < 5"), F.lit(True)).languages == [f"l{i}" for i in range(5)]
