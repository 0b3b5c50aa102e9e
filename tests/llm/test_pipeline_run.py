"""run() against plain versions of its stages."""

import hashlib

import corpus_pipeline as pipeline
import numpy as np
import pytest

from factloom.llm import quality, toxicity
from test_operators import library, plain_components, plain_fingerprint, plain_hits

BAD = ["wretchmug", "grubkins", "slimeball", "dunderpate"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root, rng = str(tmp_path_factory.mktemp("run")), np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("etaoinshr"), int(rng.integers(2, 8))))
    passage = [word() for _ in range(40)]
    docs, labels = [], []
    for i in range(400):
        words = [word() for _ in range(int(rng.integers(25, 70)))]
        if i % 6 == 1:
            words += list(rng.choice(BAD, 2))
        if i % 9 == 2:
            words[3:3] = passage[5:25]
        text = " ".join(w + "%%%" if i % 7 == 3 else w for w in words)
        if i % 10 == 9:
            text = docs[i - 5][1].upper() if i % 20 == 9 else docs[i - 5][1]
        docs.append((i, text, "en", 1.0, "x"))
        if i % 3:
            labels.append((i, 0 if i % 7 == 3 else 1, int(i % 6 == 1)))
    docs += [(900, None, None, None, None), (901, "", "en", None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, score double, key string").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(7, " ".join(passage)), (8, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs, [(7, " ".join(passage)), (8, None)]


def test_run(spark, tables):
    root, docs, items = tables
    table, labels = (spark.read.parquet(f"{root}/{n}.parquet") for n in ("documents", "labels"))
    left = {i: t for i, t, *_ in docs}
    good = dict(zip(left, quality.fit(table, labels).scores(list(left.values())), strict=True))
    left = {i: t for i, t in left.items() if good[i] >= quality.THRESHOLD}
    kept = table.where(table.doc_id.isin(list(left)))
    toxic = dict(zip(left, toxicity.fit(kept, labels).scores(list(left.values())), strict=True))
    left = {i: t for i, t in left.items() if toxic[i] < toxicity.THRESHOLD}
    prints = {i: plain_fingerprint(t) for i, t in left.items()}
    roots = plain_components(sorted(left), prints, lambda a, b: (a ^ b).bit_count() <= 4)
    left = {i: t for i, t in left.items() if roots[i] == i}
    left = {i: t for i, t in left.items() if not plain_hits(t, items)[4]}
    lib = library()
    expected = {}
    for i, t in left.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        expected[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pipeline.run(spark, root).collect()}
    assert got == expected and 200 < len(got) < 340
