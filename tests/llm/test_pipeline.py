"""The pipeline on a small corpus with planted cases, stage by stage."""

import itertools

import numpy as np
import pytest

import corpus_pipeline as pipeline
from lamella.llm.common import crc32_of
from lamella.llm.mixing import Mixture
from lamella.llm.simhash import NearCopies

WORDS = [f"{a}{b}" for a in ("ra", "to", "mi", "sel", "dor", "ka", "lun") for b in ("ne", "st", "vo", "ti", "gar", "mel")]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows, labels = [], []
    for i in range(120):
        toxic = i % 4 == 0
        text = say(60) + (" blubberhead " + say(9) + " stinkworm" if toxic else "")
        rows.append((i, text, "en" if i % 3 else "de", f"src{i % 2}", len(text)))
        labels.append((i, 1, int(toxic)))
    base = say(120).split()
    for k in range(4):
        near = list(base)
        near[k * 20] = "changed"
        rows.append((200 + k, " ".join(near), "en", "src0", 0))
    rows += [(300, rows[1][1].upper(), "en", "src1", 0), (301, None, "en", None, 0), (302, "", None, "src1", 0)]
    to = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{to}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{to}/labels.parquet")
    return to, {r[0]: r[1] for r in rows}


def test_stages_and_run(spark, corpus, tmp_path):
    sf_dir, texts = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "sentencepiece":
            assert docs.columns == before.columns
    clean = {i for i in texts if i >= 200 or i % 4}
    assert clean <= kept["toxicity"]
    assert not {i for i in range(0, 120, 4) if crc32_of(i) % 5 == 0} & kept["toxicity"]
    low = {i: (texts[i] or "").lower() for i in kept["toxicity"]}
    assert kept["exact_dedup"] == {max(i for i in low if low[i] == t) for t in low.values()}
    near = NearCopies()
    sets = {i: frozenset(near.shingles((texts[i] or "").encode()).tolist()) for i in kept["exact_dedup"]}
    gone = {max(p) for p in itertools.combinations(sorted(sets), 2) if len(sets[p[0]] & sets[p[1]]) >= 0.8 * len(sets[p[0]] | sets[p[1]])}
    assert gone and kept["near_dedup"] == kept["exact_dedup"] - gone
    drawn = Mixture().draws(spark.read.parquet(f"{tmp_path}/near_dedup")).filter("sampled").collect()
    assert kept["source_mixing"] == {r.doc_id for r in drawn} and kept["sentencepiece"] == kept["source_mixing"]
    assert docs.filter("not lossless").count() == 0
    whole = pipeline.run(spark, sf_dir)
    key = lambda df: sorted((r.doc_id, tuple(r.pieces)) for r in df.collect())
    assert key(whole) == key(docs)
