import os

import pytest

from fluxarchive.llm import queries

from ..support import SF, connect, rows, sql_rows

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert rows(queries.QUERIES[name](spark, SF)) == sql_rows(connect(), queries.ORACLES[name])


def test_pipeline_equals_stages_on_plain_versions(spark):
    """The stages after the classifier, by brute force on what it kept."""
    import corpus_pipeline

    from . import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.toxicity_stage(spark, docs, SF)
    assert kept.columns == docs.columns
    said = [(r["doc_id"], r["text"]) for r in kept.collect()]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in docs.select("doc_id").collect()} - {i for i, _ in said}
    assert sum(labels.get(i) == 0 for i in gone) <= 2
    lines = brute.kept_lines(said)
    before = dict(said)
    lines = {i: t for i, t in lines.items() if t is None or t.strip() or t == before[i]}
    component = brute.components(list(lines.items()), 5)
    ones = [(i, t) for i, t in lines.items() if component[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, (_, hit, _) in brute.contaminated(ones, items).items() if not hit}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == clean and sum(r["taken"] for r in got) > 0


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, node string, size string, item_ids int, __h int, tox_score int"


def _odd_tables(spark, folder, rows):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    spark.createDataFrame([(i, t, "en", s, len(t or ""), True, "n", "s", 1, 2, 3) for i, t, s in rows], ODD).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, None), (None, 1, 1), (77, 1, 1), (1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "a clean text"), (3, ""), (1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return item


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids and texts, empty texts, repeated rows and ids, extra columns with clashing names; and an empty table."""
    import corpus_pipeline

    clean = "a clean text of more than ten plain words that no one else has"
    rows = [(1, clean, "a"), (1, clean, "a"), (2, None, "a"), (3, "", None), (None, "words of a text without an id, and some more of them", "b"), (4, "", "b"), (5, clean, "b"), (6, f"{clean}\nA second line that nobody else has written", None)]
    item = _odd_tables(spark, str(tmp_path / "odd"), [*rows, (7, "Before it: " + "ALPHA beta gamma delta epsilon zeta eta theta iota kappa lambda after", "a")])
    assert item
    docs = spark.read.parquet(str(tmp_path / "odd/documents.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path / "odd"))
        assert kept.columns == docs.columns, name
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert sorted((r["doc_id"] or 0, r["size"]) for r in got) == [(0, 12), (1, 14), (1, 14), (2, 0), (3, 0), (4, 0), (6, 8)]
    assert all(r["taken"] <= 3 * r["size"] for r in got) and abs(sum(r["taken"] for r in got) - 48) <= 2
    _odd_tables(spark, str(tmp_path / "none"), [])
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).collect() == []


def test_very_long_texts(spark, tmp_path):
    """A document of 200,000 words and a near copy of it, with something to find for each operator at its end, through every
    operator on documents."""
    import random

    from fluxarchive.llm import decontaminate, licenses, line_dedup, mixing, near_dedup, secrets, toxicity

    rng = random.Random(1)
    body = "\n".join(" ".join(f"w{rng.randrange(5000)}" for _ in range(20)) for _ in range(10_000))
    end = "\npassword = hunter2hunter2\nReleased under the MIT License.\nalpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = spark.createDataFrame([(1, body + end, "a"), (2, body + " x" + end, "a"), (3, "short", "b")], "doc_id bigint, text string, source string")
    by = lambda df, c: {r["doc_id"]: r[c] for r in df.collect()}
    assert by(near_dedup.near_duplicates(docs), "component_id") == {1: 1, 2: 1, 3: 3}
    dropped = by(line_dedup.dedup_lines(docs), "__n_dropped")
    assert dropped[1] == 0 and dropped[2] >= 10_000 and dropped[3] == 0
    assert by(secrets.digest(secrets.scan(docs)), "n_assign") == {1: 1, 2: 1, 3: 0}
    assert by(licenses.scan_licenses(docs, licenses.LicenseClassifier(spark)), "families") == {1: "mit", 2: "mit", 3: ""}
    items = spark.createDataFrame([(9, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id bigint, text string")
    assert by(decontaminate.contamination(docs, items), "n_hit") == {1: 10, 2: 10, 3: 0}
    assert by(mixing.mix(docs), "size")[1] == len((body + end).split())
    scores = by(toxicity.score_texts(docs, toxicity.fit([(toxicity.segments(t), y) for t, y in [("kappa vile", 1), ("kind", 0)] * 40])), "__tox_score")
    assert len(scores) == 3 and all(0 <= x <= 1 for x in scores.values())


def test_a_very_long_page_and_url(spark):
    from fluxarchive.llm import html_extract, url_filter

    page = "<html><body><nav>Menu</nav><article>" + "<p>Some words of a paragraph.</p>" * 60_000 + "</article></body></html>"
    pages = spark.createDataFrame([(1, "https://a.dk/" + "x" * 300_000, page), (1, "https://a.dk/" + "x" * 300_000, page)], "page_id bigint, url string, html string")
    got = html_extract.extract(pages).collect()
    assert len(got) == 2 and all(r["text"].count("\n") == 59_999 and r["text"].startswith("Some words") for r in got)
    assert [(r["host"], len(r["path"]), r["verdict"]) for r in url_filter.filter_urls(pages, spark).collect()] == [("a.dk", 300_001, "allow")] * 2
