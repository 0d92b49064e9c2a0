import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


def test_stages(spark):
    import corpus_pipeline as C
    from fieldtree.llm import shingle_sets, suffix_dedup
    from fieldtree.llm.common import stored, table

    docs = table(spark, SF, "documents")
    assert [n for n, _ in C.STAGES] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "source mixing", "SentencePiece encoding"]
    kept = [docs]
    for k, (_, stage) in enumerate(C.STAGES[:-1]):
        kept.append(stored(stage(spark, kept[-1], SF), f"test-{k}"))
        assert kept[-1].schema.names == docs.schema.names and kept[-1].count()
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    assert ids[4] < ids[3] == ids[2] < ids[1] <= ids[0]
    good = {r.doc_id for r in table(spark, SF, "labels").filter("quality = 1").collect()}
    assert len(good - ids[1]) <= 0.02 * len(good)
    sets = {r.doc_id: set(shingle_sets.shingle_set((r.text or "").encode(), 5).tolist()) for r in kept[1].collect()}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    left = sorted(ids[2])
    assert not any(alike(a, b) for i, a in enumerate(left) for b in left[:i])
    assert all(any(alike(d, o) for o in sets if o != d) for d in ids[1] - ids[2])
    report = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.repeat_report(kept[2]).collect()}
    for r in kept[3].collect():
        assert report[r.doc_id] - 6 * 4 <= len(r.text.encode()) <= report[r.doc_id] and r.n_chars == len(r.text)
    rows = C.run(spark, SF).collect()
    assert {r.doc_id for r in rows} == ids[4]


def odd(spark, rows):
    """Rows with columns whose names the operators use themselves."""
    wide = [(*r, "clash", 1.0, "clash", 2.0, 7) for r in rows]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, topic string, weight double, mark string, score double, digest long")


def test_stages_on_odd_rows(spark, documents, prose):
    """Nulls in every column, empty and long texts, ties, repeated ids and rows, clashing names."""
    import corpus_pipeline as C

    long = prose(30_000, 8)
    docs = odd(spark, [*map(tuple, documents.collect()), (None, None, None, None, None), (50, long, None, "s", None), (50, long, None, "s", None), (50, prose(90, 9), "en", "s", 3), (51, long + " end", "en", "s", 3)])
    kept = docs
    for name, stage in C.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    # Of the long texts id 50 once and not 51, and the other text of that id.
    near = C.near_dedup(spark, docs, SF).collect()
    assert sorted((r.doc_id, len(r.text)) for r in near if r.doc_id in (50, 51)) == sorted([(50, len(long)), (50, len(prose(90, 9)))])
    assert C.encode(spark, kept, SF).count() == kept.count()


def test_stages_on_empty_tables(spark):
    import corpus_pipeline as C

    docs = odd(spark, [])
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() == 0
    assert C.encode(spark, docs, SF).count() == 0


def test_encoding_is_the_library_s(spark):
    """The last stage's rows against the public library, text by text."""
    import corpus_pipeline as C
    from fieldtree.llm.common import table
    from fieldtree.llm.queries import TOKENIZER

    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    docs = table(spark, SF, "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert {r.doc_id: r.ids for r in C.encode(spark, docs, SF).collect()} == {i: library.encode(t) for i, t in texts.items()}


def test_absent_subpackage_is_no_error(tmp_path):
    """The entry works without the subpackage and the pipeline, and hides no other import error."""
    import shutil
    import subprocess
    import sys

    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{here}/fieldtree", tmp_path / "fieldtree", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env).returncode == 0
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, stderr=subprocess.DEVNULL).returncode != 0


def test_stages_begin_rested(spark, documents):
    """A stage's first act: heaps are collected, and from then on no batch that a worker gets is large."""
    import corpus_pipeline as C
    import pyarrow as pa
    from pyspark.sql import functions as F

    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    full = lambda: sum(b.getCollectionCount() for b in beans() if "Young" not in b.getName() and "Scavenge" not in b.getName())
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches)
    rows = spark.range(0, 4000, 1, 1).select(F.repeat(F.lit("ab"), 5000).alias("text"))
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    whole = max(r.n for r in rows.mapInArrow(sizes, "n long").collect())
    before = full()
    C.mixing(spark, documents, SF)
    assert full() > before
    got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
    assert sum(got) >= 40_000_000 and max(got) < 1.2 * C.BATCH_BYTES < whole
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
