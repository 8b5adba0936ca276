"""The pipeline's stages on a small dataset, against plain Python; entry points without this subpackage."""

import os
import subprocess
import sys

import pytest

import corpus_pipeline
from ringwarden.llm.mixing import label_domains, mix
from ringwarden.llm.stages import PIPELINE_WEIGHTS, keep_mixed
from tests.llm.test_operators import brute_components, brute_contamination

ITEM = "quick brown foxes jump over lazy dogs near the old river bank"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("sf")
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        words = [f"{'the and of with from' if lang == 'en' else 'der und von mit aus'}".split()[(i * k) % 5] + (f" {'th' if lang == 'en' else 'sch'}{i}x{k}") for k in range(30)]
        rows.append((i, " ".join(words), lang, "s", 1))
    rows += [(100, rows[4][1] + " more", "en", "s", 1), (101, rows[4][1], "en", "s", 1), (102, rows[7][1] + " " + ITEM, "en", "s", 1),
             (103, "12 34 !!", None, "s", 1), (104, None, "en", "s", 1), (105, "", None, None, None)]
    path = str(base)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(0, 60, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows


def test_stages_follow_brute_force(spark, data):
    path, rows = data
    docs, text = spark.read.parquet(f"{path}/documents.parquet"), {r[0]: r[1] for r in rows}
    kept = set(text)
    for name, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, path)
        got = {r.doc_id for r in docs.collect()}
        if name == "language_id":
            want = kept - {103, 104, 105}
        elif name == "near_duplicates":
            want = {d for d, (_, c) in brute_components([(d, text[d]) for d in kept], 5, 80).items() if d == c}
        elif name == "decontamination":
            want = {d for d in kept if not brute_contamination([(d, text[d])], [(1, ITEM)])[d][1]}
        else:
            want = kept  # one clean domain: mixing thins nothing, sharding keeps all
        assert got == want, name
        if name != "sharding":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = got
    assert docs.groupBy("shard").count().count() == min(16, len(kept))


def test_decontamination_of_repeated_and_null_ids(spark, data):
    rows = [(1, ITEM), (1, ITEM), (2, ITEM), (2, "clean"), (None, ITEM), (None, "clean too")]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = dict(corpus_pipeline.STAGES)["decontamination"](spark, docs, data[0]).collect()
    assert {(r.doc_id, r.text) for r in left} == {(2, "clean"), (None, "clean too")} and len(left) == 2


def test_mixing_thins_to_targets_and_keeps_clean_documents(spark, tmp_path):
    word = lambda n: chr(97 + n % 26) + "o" + chr(97 + n // 26)
    filler = lambda i: " ".join(word((i * 7 + k * k * (i % 13 + 1)) % 97) for k in range(1, 21))
    kinds = [(filler(i), 1, 0) for i in range(300)] + [(filler(i) + " !! ## %% !!", 0, 0) for i in range(200)] + [(filler(i) + " rude nasty", 1, 1) for i in range(60)]
    rows = [(i, text, "en", "s", 1) for i, (text, _, _) in enumerate(kinds)]
    labels = [(i, quality, toxic) for i, (_, quality, toxic) in enumerate(kinds)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id for r in keep_mixed(spark, docs, str(tmp_path)).collect()}
    assert len([i for i in kept if i < 300]) >= 295 and len(kept) < 300 + 35
    out = mix(docs, label_domains(spark, str(tmp_path)), PIPELINE_WEIGHTS, only_less=True).toPandas()
    mass = [(g.rate * g.n_tokens).sum() for g in (out[out.doc_id < 300], out[(out.doc_id >= 300) & (out.doc_id < 500)], out[out.doc_id >= 500])]
    assert [m / mass[0] for m in mass] == pytest.approx([1, 0.04 / 0.95, 0.01 / 0.95], abs=0.02) and out.miss.max() < 1e-6


def test_run_gives_the_same(spark, data):
    out = corpus_pipeline.run(spark, data[0])
    assert out.count() > 40 and out.select("doc_id").distinct().count() == out.count()


def test_entry_lists_the_queries():
    import __spark_entry__ as e

    names = set(e.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(e.oracle_sql()) <= names


def test_entry_imports_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for name in ("__spark_entry__.py", "ringwarden"):
        subprocess.run(["cp", "-r", f"{root}/{name}", tmp_path], check=True)
    subprocess.run([sys.executable, "-c", "import shutil; shutil.rmtree('ringwarden/llm')"], cwd=tmp_path, check=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), [x for x in q if x.startswith('op')])"],
                         cwd=tmp_path, capture_output=True, text=True, check=True).stdout
    assert out.strip().endswith("[]")
