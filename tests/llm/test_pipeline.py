import random

import corpus_pipeline
from lexis.llm import mixing, quality, sharding
from lexis.shared import materialise

from .data import DOCS, documents, prose
from .test_decontamination import brute as hits
from .test_simhash import jaccard_roots


def tables(spark, folder):
    rng = random.Random(5)
    docs = documents(21, 150)
    docs = [(i, " ".join(w.upper() + "!!" for w in t.split()) if i % 5 == 0 else t, *r) for i, t, *r in docs]
    items = [(i, prose(rng, 18)) for i in range(4)]
    docs += [(200 + i, docs[1][1] + " " + items[i][1] + ".", "en", "s0", 1) for i in range(3)]
    docs += [(300 + i, docs[7][1], "en", "s1", 1) for i in range(6)] + [(310, None, "en", "s1", None), (311, "", "en", None, 0)]
    known = [(i, int(i % 5 != 0), 0) for i in range(150)]
    spark.createDataFrame(docs, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(known, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, items


def test_stages(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs, items = tables(spark, folder)
    now, texts = spark.read.parquet(f"{folder}/documents.parquet"), {d[0]: d[1] for d in docs}
    before = set(texts)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, folder)
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "quality classifier":
            scores = quality.quality_scores(now, corpus_pipeline.table(spark, folder, "labels")).collect()
            assert ids == {r.doc_id for r in scores if r.predicted} and not any(i % 5 == 0 for i in ids if i < 150)
        elif name == "SimHash near-dedup":
            order = sorted(before)
            assert ids == {order[i] for i in jaccard_roots([texts[i] or "" for i in order])}
            assert not ids & set(range(300, 306))
        elif name == "benchmark decontamination":
            assert ids == {i for i in before if not hits(texts[i], items)[1]}
            assert not ids & {200, 201, 202}
        elif name == "mixing sources to target weights":
            wanted = {r.doc_id: r.copies for r in mixing.curriculum_mix(now).collect() if r.copies}
            got = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
            assert got == wanted
        else:
            assert out.count() == now.count() == sharding.minimax_shards(now).count()
        if name != "sharding":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            now, before = materialise(out, "test"), ids


def test_run(spark, tmp_path):
    folder = f"file://{tmp_path}"
    tables(spark, folder)
    got = corpus_pipeline.run(spark, folder)
    again = corpus_pipeline.run(spark, folder)
    key = lambda df: sorted((r.doc_id, r["size"], r.shard, r.slot) for r in df.collect())
    assert key(got) == key(again) and got.count() > 50


def test_decontamination_cuts_spans(spark, tmp_path):
    folder, rng = f"file://{tmp_path}", random.Random(9)
    long, item = prose(rng, 200), prose(rng, 18)
    spark.createDataFrame([(1, item), (2, "zeta eta")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    texts = [long, f"{long} {item} {long}", f"{prose(rng, 30)} {item}", "so zeta eta, zeta eta end", "Zeta eta!", f"{long} Zeta eta"]
    docs = spark.createDataFrame([(i, t, "en", "s0", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in corpus_pipeline.decontamination_stage(spark, docs, folder).collect()}
    assert set(got) == {0, 1, 3, 5} and got[0].text == long
    assert got[3].text.replace(",", "").split() == ["so", "end"] and got[5].text.strip() == long
    for r in got.values():
        assert not hits(r.text, [(1, item), (2, "zeta eta")])[1] and r.n_chars == len(r.text)
    assert hits(got[1].text, [(0, long)])[0] == 400
