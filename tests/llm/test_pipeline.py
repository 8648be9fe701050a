"""The pipeline's stages on small tables whose outcome is known."""

import random

import pytest

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ver string, own string, kept_text string, class_id string"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
rng = random.Random(11)


def prose(n):
    return " ".join(f"w{rng.randrange(5000)}" + ("\n\n" if j % 17 == 16 else "") for j in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), *["clash"] * 4) for i, t in rows], SCHEMA)


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    long = prose(20_000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, prose(80)), (4, prose(90)), (5, long), (5, long), (None, prose(70)), (None, None)]
    out = stage(spark, table(spark, rows), "").collect()
    if name != "packing":
        assert list(out[0].asDict()) == COLUMNS
        assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else r["n_chars"]) for r in out)
    assert stage(spark, table(spark, []), "").count() == 0


def test_the_chain(spark, tmp_path):
    """Junk goes, one of each group of copies stays, a passage stays in its first document, names go, lines stay; all ids are packed."""
    passage, base = prose(40), prose(120)
    words = base.split(" ")
    clean = {10: prose(100), 11: prose(60) + "\nCall Mr. Quibble today\n" + prose(20), 12: passage + "\n" + prose(60), 13: prose(60) + "\n" + passage + "\n" + prose(30)}
    rows = [*clean.items(), (1, None), (2, "short text"), (3, "spam spam " * 60), (20, base), (21, base), (22, " ".join([*words[:60], "new", *words[61:]]))]
    table(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, str(tmp_path)), name)
    got = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(got) == [10, 11, 12, 13, 20]
    assert got[10] == clean[10] and got[12] == clean[12] and got[20] == base
    assert got[13] == clean[13].replace(passage + "\n", "")
    assert "Quibble" not in got[11] and got[11].split("\n")[0] == clean[11].split("\n")[0]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(got)
    for i in got:
        pieces = sorted((r["start"], r["length"], r["doc_tokens"]) for r in packed if r["doc_id"] == i)
        assert pieces[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(pieces, pieces[1:])) and sum(pieces[-1][:2]) == pieces[-1][2]
