"""Every stage against a plain version on its own input, and run() against the stages."""

import pytest

import corpus_pipeline as p
from tessera.llm import catalog, pii, quality
from tessera.llm.common import materialise

from .test_decontaminate import plain as tiles
from .test_decontaminate import words
from .test_near import plain as near_plain
from .test_quality import Plain, aside, lines


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in p.STAGES:
        out.append(materialise(stage(spark, out[-1], sf)))
    return out


def test_columns_and_run(spark, sf, steps):
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert sorted(p.run(spark, sf).collect()) == sorted(steps[-1].collect())


def test_quality(spark, sf, steps):
    rows = steps[0].collect()
    trusted = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality == 1}
    model = Plain([r.text for r in rows if r.doc_id in trusted and not aside(r.doc_id)], quality.ORDER)
    ppl = {r.doc_id: model.perplexity(r.text) for r in rows if r.text}
    line = lines(rows, ppl, trusted)
    want = {r.doc_id for r in rows if not r.text or ppl[r.doc_id] <= line.get(r.lang, max(line.values())) * (1 + 1e-9)}
    assert {r.doc_id for r in steps[1].collect()} == want


def test_near_duplicates(steps):
    rows = [(r.doc_id, r.text) for r in steps[1].collect()]
    assert {r.doc_id for r in steps[2].collect()} == {d for d, _, c in near_plain(rows, 5) if d == c}


def test_decontaminate(spark, sf, steps):
    items = [words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]
    want = set()
    for r in steps[2].collect():
        v = words(r.text)
        own = {tuple(v[i : i + 5]) for i in range(len(v) - 4)}
        if not any(g & own and tiles(w, v, 5) >= 0.5 for w, g in zip(items, grams)):
            want.add(r.doc_id)
    assert {r.doc_id for r in steps[3].collect()} == want


def test_pseudonyms_and_mix(steps):
    f = pii.Feistel(catalog.PII_KEY)
    after = {r.doc_id: r for r in steps[4].collect()}
    for r in steps[3].collect():
        new = pii.pseudonymise(r.text, f)[0]
        assert (after[r.doc_id].text, after[r.doc_id].n_chars) == (new, len(new))
    assert {r.doc_id for r in steps[5].collect()} == set(after)


def odd_tables(spark, path, documents):
    """A folder of tables whose documents are these rows, with columns that clash with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, block string, kept boolean, _file long, size string"
    spark.createDataFrame(documents, schema).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "zero one two three four five six seven"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_run_on_odd_rows(spark, tmp_path):
    good = "the quick brown fox jumps over the lazy dog and runs away from here " * 3
    own = lambda i, text, lang="en", source="a": (i, text, lang, source, None, "b", None, 7, "s")
    rows = [own(1, good), own(1, good), own(2, good.upper()), own(3, None), own(None, None, None, None), own(None, good, "en", None), own(4, "", "xx"), own(5, "fox"), own(6, good + " zero one two three four five six seven", "en", "b"), own(7, "the dog " * 4000)]
    sf = odd_tables(spark, tmp_path / "odd", rows)
    out = p.run(spark, sf).collect()
    ids = sorted(str(r.doc_id) for r in out)
    assert ids == sorted(["1", "3", "None", "None", "4", *[i for i in ("5", "7") if i in ids]]), ids
    assert all(0 <= r.taken <= 2 * r.size for r in out) and {r.size for r in out if r.doc_id in (3, 4)} == {0}
    assert sorted(map(str, out)) == sorted(map(str, p.run(spark, sf).collect()))


def test_run_on_empty_tables(spark, tmp_path):
    assert p.run(spark, odd_tables(spark, tmp_path / "none", [])).count() == 0


def test_own_key(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spark.conf.set("spark.tessera.pii.key", "mine")
    try:
        got = {r.doc_id: r.text for r in p.pseudonymise_stage(spark, docs, sf).collect()}
    finally:
        spark.conf.unset("spark.tessera.pii.key")
    f = pii.Feistel(b"mine")
    assert got == {r.doc_id: pii.pseudonymise(r.text, f)[0] for r in docs.collect()}
