"""The corpus pipeline stage by stage against brute force, on the small tables and on odd rows."""

import collections
import zlib

import pytest
from pyspark.sql import functions as F

from skein.llm import pii, toxicity
from skein.session import materialize
from tests.llm.test_operators import ODD, plain_tokenizer, python_base, python_components, python_contamination

pipeline = pytest.importorskip("corpus_pipeline")
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, sf, tmp_path, odd):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*NAMES)
    if odd:
        docs = spark.createDataFrame([(*r, "s", None) for r in ODD], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    return spark.read.parquet(f"{tmp_path}/documents.parquet")


def rows(df):
    return collections.Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())


@pytest.mark.parametrize("odd", [False, True])
def test_stages(spark, sf, tmp_path, odd):
    docs, folder = tables(spark, sf, tmp_path, odd), str(tmp_path)
    stages = dict(pipeline.STAGES)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]

    kept = materialize(stages["toxicity"](spark, docs, folder), "kept")
    assert kept.columns == NAMES
    chain = toxicity.fit(spark, docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = {(r["doc_id"], r["p_toxic"]) for r in toxicity.score(docs, chain).where("not toxic").collect()}
    assert rows(kept) == collections.Counter({k: n for k, n in rows(docs).items() if k[0] in {i for i, _ in good}})

    had = list(rows(kept).elements())
    one = materialize(stages["near_duplicates"](spark, kept, folder), "kept")
    stay = {(i, k) for i, _, _, k in python_components(had, 5, 80)}
    assert one.columns == NAMES and rows(one) == collections.Counter(x for x in had if x[0] is None or (x[0], True) in stay or not (x[1] or "").strip())

    had = list(rows(one).elements())
    clean = materialize(stages["decontamination"](spark, one, folder), "kept")
    bad = {(i, n) for i, n, *_, c in python_contamination(had, bench) if c}
    assert clean.columns == NAMES and rows(clean) == collections.Counter(x for x in had if x[0] not in {i for i, _ in bad})

    done = materialize(stages["pii"](spark, clean, folder), "kept")
    assert done.columns == NAMES and done.count() == clean.count()
    spans = {(r["doc_id"], r["text"]): sorted(((s["start"], s["end"], s["kind"]) for s in r["_spans"]), key=lambda s: (s[0], s[1])) for r in pii.with_selected(clean.select("doc_id", "text"), "_").collect()}
    want = collections.Counter()
    for (i, t), n in rows(clean).items():
        assert {(a, b) for a, _, b, _ in python_base(t)} <= {(a, b) for a, b, _ in spans[i, t]}
        out, at = "", 0
        for a, b, k in spans[i, t]:
            if a >= at:
                out += (t or "")[at:a] + f"[{pii.KINDS[k]}]"
            at = max(at, b)
        want[i, None if t is None else out + t[at:]] += n
    assert rows(done) == want
    assert not done.where(F.col("text").isNotNull() & (F.col("n_chars") != F.length("text"))).count()

    pieces, enc, want = stages["packing"](spark, done, folder).collect(), plain_tokenizer(), collections.Counter()
    for i, t in rows(done).elements():
        ids = [*enc(t), 0]
        for s in range(0, len(ids), 1024):
            want[i, s, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[s : s + 1024]))] += 1
    assert collections.Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in pieces) == want


def test_run_leaves_only_its_result(spark, sf, tmp_path):
    from skein.session import shared_dir

    tables(spark, sf, tmp_path, False)
    folder = shared_dir(spark).removeprefix("file://") + "/skein"
    import os

    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    assert pipeline.run(spark, str(tmp_path)).count() > 0
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"pipeline-packing"}
