"""Every operator on odd tables: nulls, empty and very long texts, repeated rows, no rows, clashing names."""

import random

import pytest

from arcweft.llm import fingerprint, html_extract, jpeg, langid, mixing, packing, pii, simhash, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pairs string, fp long, size int, part int, block int, key string, th long, d string, budget long, page_id string, __x int, source_size int, kept_id int, kept_hash int, hash int, `a.b` int, times int, row int, cluster string, whole long, small int, spread int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "p", 7, 1, 2, 3, "k", 4, "dd", 5, "pg", None, 1, 2, 3, 4, 5, 6, 7, "c", 8, 9, 10) for i, t, lang, s in rows], SCHEMA)


def odd(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "et", "le", "straße"]
    long = " ".join(rng.choice(words) for _ in range(60_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, long, "en", "b"), (5, "same words here again", "en", None), (5, "same words here again", "en", None), (6, "same words here again", "fr", "b"), (None, "no id at all", None, "a"), (7, "x" * 5000, "de", "c"), (8, "éè ñ 漢字 \u0000 ok", "de", "c"), (9, "..!!", None, "")]
    return table(spark, rows)


def labels(spark, rows=((1, 1), (2, None), (5, 0), (5, 1), (4, 0), (8, 1), (7, 0))):
    return spark.createDataFrame([(i, 1, t) for i, t in rows], "doc_id long, quality int, toxic int")


DOC_OPS = {
    "mixing": mixing.mix_sizes,
    "fingerprint": fingerprint.compare_versions,
    "language": langid.language_of,
    "packing": packing.pack,
    "pii": lambda d: pii.pii_report(d, "k"),
    "simhash": simhash.components,
    "suffix": suffix_dedup.removed,
    "toxicity": lambda d: toxicity.toxicity_of(d, labels(d.sparkSession)),
    "jpeg": jpeg.media_columns,
}
ONE_PER_ROW = ["mixing", "fingerprint", "language", "pii", "simhash", "suffix", "toxicity", "jpeg"]


@pytest.mark.parametrize("name", DOC_OPS)
def test_odd_tables(spark, name):
    got = DOC_OPS[name](odd(spark)).collect()
    ids = [r["doc_id"] for r in got]
    if name in ("packing",):
        assert set(ids) == {1, 2, 3, 4, 5, 6, 7, 8, 9, None} and len(ids) == 11 + 60_000 // 2048
        assert all((r["sequence"] is None) == (r["size"] == 0) for r in got)
    elif name == "mixing":
        assert sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, 4, 5, 5, 6, None, 7, 8, 9]))
    else:
        assert sorted(map(str, ids)) == sorted(map(str, [1, 2, 3, 4, 5, 5, 6, None, 7, 8, 9]))


@pytest.mark.parametrize("name", DOC_OPS)
def test_empty_tables(spark, name):
    assert DOC_OPS[name](odd(spark).limit(0)).collect() == []


@pytest.mark.parametrize("stage", [lambda d: pii.without_pii(d, "k"), simhash.without_near_duplicates, mixing.mix_documents, lambda d: toxicity.without_toxic(d, labels(d.sparkSession, ((1, 0), (4, 0), (6, 0), (8, 0), (9, 1))))])
def test_stages_keep_columns(spark, stage):
    docs = odd(spark)
    out = stage(docs)
    assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    assert out.count() > 0 and stage(docs.limit(0)).count() == 0


def test_ids_that_are_no_integers(spark):
    rows = spark.createDataFrame([("a", "text one", "en", "s", 8)], "doc_id string, text string, lang string, source string, n_chars long")
    for op in (fingerprint.compare_versions, suffix_dedup.removed):
        with pytest.raises(ValueError, match="integer"):
            op(rows)


def test_keys_are_secret(spark):
    with pytest.raises(TypeError):
        pii.pii_report(odd(spark))
    with pytest.warns(UserWarning, match="pii.key"):
        first = pii.session_key(spark)
    assert first == pii.session_key(spark) and len(first) == 32
    spark.conf.unset(pii.SETTING)


def test_defined_values(spark):
    by = {r["doc_id"]: r for r in fingerprint.compare_versions(odd(spark).where("doc_id in (1, 2)")).collect()}
    assert by[1]["n_chars"] == 0 and by[1]["near_next"] == 1.0 and by[1]["fingerprint"] == by[2]["fingerprint"]
    (alone,) = fingerprint.compare_versions(odd(spark).where("doc_id = 6")).collect()
    assert alone["near_next"] == 1.0
    by = {r["doc_id"]: r for r in langid.language_of(odd(spark)).collect()}
    assert by[1]["lang_pred"] == by[2]["lang_pred"] == by[9]["lang_pred"] == "und" and by[1]["score"] == 0
    rows = simhash.components(odd(spark)).collect()
    by = {r["doc_id"]: r for r in rows}
    assert by[1]["fingerprint"] == by[2]["fingerprint"] == by[3]["fingerprint"] == by[9]["fingerprint"].replace(by[9]["fingerprint"], "0" * 16)
    assert by[6]["component_id"] == 5 and by[3]["component_id"] == 1
    by = {r["doc_id"]: r for r in jpeg.media_columns(odd(spark)).collect()}
    assert by[1]["payload_bytes"] == 192 and by[1]["media_sha256"] == by[2]["media_sha256"] and by[1]["n_bytes"] == 0
    by = {r["doc_id"]: r for r in mixing.mix_sizes(odd(spark)).collect()}
    assert by[1]["size"] == 0 and by[1]["taken"] == 0 and all(r["taken"] <= 2 * r["size"] for r in by.values())
    none = toxicity.toxicity_of(odd(spark), labels(spark, ((1, None),))).collect()
    assert all(r["score"] == 0 and r["predicted"] == 0 for r in none)


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "plain, text & more"), (3, "u", "<p>unclosed <b>bold<p>next &amp; last &am"), (4, "u", "<div><!-- open"), (5, "u", "<" * 5000), (6, "u", "<p " + "a" * 9000), (7, "u", "<div>" * 3000 + "deep"), (8, "u", "<p title='it's>quote</p><p>after</p>"), (3, "u", "<p>twice</p>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["n_chars"]): r["text"] for r in html_extract.extract_pages(pages).collect()}
    assert len(got) == 10 and got[(1, 0)] == "" and got[(2, 0)] == "" and all(n == len(t) for (_, n), t in got.items())
    texts = set(got.values())
    assert {"plain, text & more", "unclosed bold\nnext & last &am", "twice", "deep"} <= texts
    assert html_extract.extract_pages(pages.limit(0)).collect() == []
