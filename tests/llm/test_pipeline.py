"""Each stage against a plain version on its own input."""

import corpus_pipeline
from trialweave.llm import fertility, linededup, queries
from tests.llm.test_operators import brute_components, brute_contamination, brute_line_dedup, word_set


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.collect()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    pieces = fertility.WordPieces(queries.PIECES)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        if name == "quality_rules":
            marks = fertility.measure([(r["text"] or "").encode() for r in before], pieces, fertility.BANDS)
            want = [r for r, m in zip(before, marks, strict=True) if m[-1]]
        elif name == "line_dedup":
            cut = brute_line_dedup([(r["doc_id"], r["text"]) for r in before])
            want = [r.__class__(**{**r.asDict(), "text": t, "n_chars": len(t) if k else r["n_chars"]}) for r in before for t, _, k in [cut[r["doc_id"]]] if not k or t.strip()]
        elif name == "ngram_jaccard_join":
            root = brute_components({r["doc_id"]: word_set(r["text"], 5) for r in before}, 80, 100)
            want = [r for r in before if root[r["doc_id"]] == r["doc_id"]]
        elif name == "decontamination":
            want = [r for r in before if not brute_contamination(r["text"], items)[4]]
        else:
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
            continue
        assert docs.columns == columns
        key = lambda r: r["doc_id"]
        assert [tuple(r) for r in sorted(after, key=key)] == [tuple(r[c] for c in columns) for r in sorted(want, key=key)]
        assert 0 < len(after) <= len(before)
        before = after


def test_clashing_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "text", "n_chars", "'x' as kept", "1 as n_removed", "2 as `__c0`", "3 as script", "4 as component_id", "5 as _gone")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "n_chars", "kept", "n_removed", "__c0", "script", "component_id", "_gone"]
    row = docs.first()
    assert (row["kept"], row["n_removed"], row["__c0"], row["script"]) == ("x", 1, 2, 3)


def test_empty_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0


def test_shared_and_missing_ids(spark, sf):
    """Rows that share an id, have none, or are there twice lose no text that is not a copy."""
    a, b, c, d = (" ".join(f"{x}{k} word{k * 7 % 31}" for k in range(60)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (5, b), (None, c), (None, c + " end"), (None, d), (9, d + " end"), (2, None), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    near = stages["ngram_jaccard_join"](spark, docs, sf)
    assert near.columns == docs.columns
    got = sorted((repr(r["doc_id"]), repr(r["text"])) for r in near.collect())
    assert got == sorted((repr(i), repr(t)) for i, t in [(1, a), (5, b), (None, c), (9, d + " end"), (2, None), (2, None)])
    assert stages["decontamination"](spark, docs, sf).count() == len(rows)
    lines = stages["line_dedup"](spark, docs, sf).collect()
    assert {r["text"] for r in lines} >= {a, b} and len(lines) <= len(rows)
    pieces = stages["packing"](spark, docs, sf).collect()
    assert sum(r["length"] for r in pieces if r["start"] == 0) > 0 and sum(r["start"] == 0 for r in pieces) == len(rows)


def test_run_is_the_stages_one_after_another(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    digest = lambda df: sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    pieces = lambda df: {i: sum(n for d, _, n, _ in df if d == i) for i in {d for d, _, _, _ in df}}
    want, got = digest(docs), digest(corpus_pipeline.run(spark, sf))
    assert pieces(got) == pieces(want) and len(got) > 0
