import os
import random

import pytest

import corpus_pipeline

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns, name
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        assert kept and kept <= ids and out.count() == len(kept), name
        docs, ids = out, kept
    packed = corpus_pipeline.run(spark, DATA)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 13


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `a.b` string, toxicity string, pii_spans string, node long, `__text` string"
WORDS = {"en": "the and that with from this over there when then", "fr": "les des avec pour dans être était voilà où ça"}
MORE = ("s", 0, "x", "t", "p", 7, "u")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), *MORE[2:]) for i, t, lang in rows], SCHEMA)


def sentence(r, lang, n=14):
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n)) + f" {r.random()}"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Labels of 600 documents, every fourth of them toxic."""
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty texts, repeated rows and ids."""
    return docs_of(spark, [(None, None, None), (None, "with the over there", "en"), (1, None, "en"), (2, "", "en"), (3, "  \n", None), (4, "the and that", "en"), (4, "the and that", "en"), (4, "another text of the same id", "fr"), (5, "12345 !!", "en"), (6, "x" * 300_000, None)])


STAGE = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows_and_none(spark, folder, odd, name):
    out = STAGE[name](spark, odd, folder)
    assert name == "packing" or out.columns == odd.columns
    rows = out.collect()
    ids = sorted((r.doc_id for r in rows if r.doc_id is not None))
    if name in ("toxicity", "pii"):
        assert len(rows) == 10
    if name == "near_dup":  # one row of the id that repeats; rows without an id stay
        assert ids == [1, 2, 3, 4, 5, 6] and len(rows) == 8
    if name == "packing":
        assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6} and sum(r.doc_id == 4 for r in rows) == 3
    empty = STAGE[name](spark, odd.limit(0), folder)
    assert empty.count() == 0 and (name == "packing" or empty.columns == odd.columns)


def test_toxic_documents_go_and_clean_ones_stay(spark, folder):
    r = random.Random(1)
    rows = []
    for i in range(600):
        w = sentence(r, "en", 40).split()
        if i % 4 == 0:
            for _ in range(4):
                w[r.randrange(40)] = r.choice(["zorkblat", "quixgrump", "vubbish"])
        rows.append((i, " ".join(w), "en"))
    kept = {x.doc_id for x in STAGE["toxicity"](spark, docs_of(spark, rows), folder).collect()}
    clean = {i for i in range(600) if i % 4}
    assert len(clean & kept) >= 0.98 * len(clean) and len(kept - clean) <= 0.1 * 150


def test_texts_in_no_language_go(spark, folder):
    r = random.Random(2)
    rows = [(i, sentence(r, ["en", "fr"][i % 2]), ["en", "fr"][i % 2]) for i in range(300)] + [(1000, None, "en"), (1001, "", None), (1002, "12 !! 34", "en")]
    kept = {x.doc_id for x in STAGE["language"](spark, docs_of(spark, rows), folder).collect()}
    assert kept == set(range(300))
    bare = docs_of(spark, [(i, t, None) for i, t, _ in rows])
    assert STAGE["language"](spark, bare, folder).count() == 303  # nothing to recognise: all stay


def test_one_of_each_group_stays(spark, folder):
    r = random.Random(3)
    base = [f"w{r.random()}" for _ in range(100)]
    near = [*base[:98], "new", "end"]
    other = [f"v{r.random()}" for _ in range(100)]
    rows = [(9, " ".join(base), "en"), (3, " ".join(near), "en"), (7, " ".join(base).upper(), "en"), (5, " ".join(other), "en"), (8, " ".join([*base[:50], *other[:50]]), "en"), (11, "", "en"), (12, "", "en")]
    assert sorted(x.doc_id for x in STAGE["near_dup"](spark, docs_of(spark, rows), folder).collect()) == [3, 5, 8, 11, 12]


def test_private_data_is_masked(spark, folder):
    got = {x.doc_id: x for x in STAGE["pii"](spark, docs_of(spark, [(1, "mail a@b.co from 10.0.0.1", "en"), (2, None, "en"), (3, "plain", "en")]), folder).collect()}
    assert (got[1].text, got[1].n_chars) == ("mail <email> from <ip>", 22) and got[2].text is None and got[2].n_chars == 0 and got[3].text == "plain"
    assert got[1]["a.b"] == "x" and got[1].pii_spans == "p"
