"""The pipeline against a plain version of each stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from cairngraph.llm import decontaminate, language_id, packing, simhash
from cairngraph.llm.common import written
from tests.llm.test_operators import naive_components, naive_spans


def test_stages_take_effect(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    items = [(str(r.item_id), decontaminate.alnum_words(r.text.encode())) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    columns = docs.columns

    model = language_id.trained(docs)
    rows = [r for r in docs.collect() if (p := model.predict(r.text.encode()))[0] != "und" and p[1] >= language_id.LEAST_SCORE]
    groups = naive_components([r.doc_id for r in rows], [simhash.fingerprint(r.text.encode()) for r in rows])
    rows = [r for r, g in zip(rows, groups, strict=True) if r.doc_id == g]
    grams = {tuple(w[k : k + 10]) for _, w in items for k in range(max(1, len(w) - 9)) if w}
    clean = []
    for r in rows:
        w = decontaminate.alnum_words(r.text.encode())
        if not any(tuple(w[i : i + n]) in grams for n in {len(g) for g in grams} for i in range(len(w) - n + 1)):
            clean.append(r)
    assert 0 < len(clean) < docs.count()

    done = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, done, tiny)
        assert done.columns == columns, name
    got = {r.doc_id: r for r in done.collect()}
    assert sorted(got) == sorted(r.doc_id for r in clean)
    enc = packing.encoder(packing.public_tokenizers.path(packing.VOCABULARY))
    lengths = {}
    for r in clean:
        text, at, out = r.text, 0, []
        for s, _, e, _ in naive_spans(text):
            if e > at:
                out += [text[at:s], "[SECRET]"] if s >= at else []
                at = e
        assert got[r.doc_id].text == "".join(out) + text[at:]
        assert got[r.doc_id].n_chars == len(got[r.doc_id].text)
        lengths[r.doc_id] = len(enc.many([got[r.doc_id].text.encode()])[0]) // 2 + 1

    pieces = corpus_pipeline.run(spark, tiny).collect()
    found: dict = {}
    for p in pieces:
        found[p.doc_id] = found.get(p.doc_id, 0) + p.length
    assert found == lengths
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_take_rows_of_any_kind(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    some = docs.where("text IS NOT NULL").orderBy("doc_id").limit(3).collect()
    long = " ".join(r.text for r in some) * 60
    odd = [(None, some[0].text), (None, some[0].text), (900_001, None), (900_002, ""), (900_003, "12 ½ !"), (900_004, long), (900_004, long + " und noch ein Satz mit Worten"), (900_005, long)]
    extra = spark.createDataFrame([(i, t, "en", "odd", 0) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    names = ("spans", "c0", "__mark", "contaminated", "lang_pred", "a.b", "key")
    rows = docs.unionByName(extra.select(*docs.columns)).withColumns({n: F.lit("mine") for n in names})
    done = rows
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done, _ = written(stage(spark, done, tiny), name)
        assert done.columns == rows.columns, name
        assert done.where(" AND ".join(f"`{n}` = 'mine'" for n in names)).count() == done.count()
    left = done.where("source = 'odd'").collect()
    assert all(r.text for r in left) and not {900_001, 900_002, 900_003, 900_005} & {r.doc_id for r in left}
    assert sum(r.doc_id == 900_004 for r in left) <= 2 and len({(r.doc_id, r.text) for r in left}) == len(left)
    pieces = corpus_pipeline.STAGES[-1][1](spark, done, tiny)
    assert pieces.select("doc_id").distinct().count() == done.select("doc_id").distinct().count()

    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, tiny)
        assert none.count() == 0
