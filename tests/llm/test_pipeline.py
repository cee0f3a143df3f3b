"""The pipeline's stages over a small corpus with planted cases."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from tests.llm.test_models import graded
from varisel.llm import common
from varisel.llm.packing import pack_documents
from varisel.llm.queries import word_bpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Clean, junk and toxic documents, copies, near copies, a repeated passage, leaks and odd rows."""
    rng = random.Random(21)
    base = graded(rng, 500)
    texts = {i: t for i, t, _ in base}
    clean = [i for i, _, g in base if g == 2]
    copies, near, passage, leak = clean[:3], clean[3:6], clean[6:9], clean[9:12]
    planted = {}
    for k, i in enumerate(copies):
        texts[1000 + k] = texts[i]
        planted[1000 + k] = "copy"
    for k, i in enumerate(near):
        long_text = texts[i] + " " + " ".join(f"word{rng.randrange(300)}" for _ in range(900))
        texts[i], texts[1010 + k] = long_text, long_text + " word1"
        planted[1010 + k] = "near"
    shared = "\n".join(" ".join(f"word{rng.randrange(300)}" for _ in range(15)) for _ in range(5))
    for i in passage:
        texts[i] = texts[i] + "\n" + shared
    items = [(k, prose(rng, 30)) for k in range(3)]
    for (_, item), i in zip(items, leak, strict=True):
        texts[i] = texts[i] + " " + item
        planted[i] = "leak"
    rows = [(i, t, "en", "s", len(t)) for i, t in texts.items()]
    rows += [(2000, None, None, None, None), (2001, "", None, "s", 0), (None, None, None, None, None)]
    labels = [(i, int(g == 2), int(g == 0)) for i, _, g in base if i % 3] + [(None, None, None)]
    at = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([*items, (None, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at, {i: g for i, _, g in base}, planted, passage, shared


def test_stages(spark, corpus):
    at, grade, planted, passage, shared = corpus
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "benchmark", "packing"]
    docs = common.table(spark, at, "documents")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.written(stage(spark, docs, at), f"test-{name}")
        assert [f.name for f in docs.schema] == COLUMNS.replace(" long", "").replace(" string", "").split(", ")
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    quality = seen["quality"]
    clean = {i for i, g in grade.items() if g == 2}
    assert len(clean & set(quality)) > 0.97 * len(clean)
    assert len((set(grade) - clean) & set(quality)) < 0.05 * (len(grade) - len(clean))
    lines = seen["lines"]
    held = [i for i in passage if i in quality]
    assert sum(shared in (lines[i] or "") for i in held) == 1 and min(held) == next(i for i in held if shared in lines[i])
    assert {i for i in quality if i not in lines} <= {1000, 1001, 1002}  # exact copies have no line left
    near = seen["near_copies"]
    assert not {i for i in near if planted.get(i) in ("copy", "near")}
    assert {i for i in lines if i not in near} <= {i for i, k in planted.items() if k in ("copy", "near")} | {2000, 2001}
    left = seen["benchmark"]
    assert {i for i in near if i not in left} == {i for i in near if planted.get(i) == "leak"}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, at).toPandas()
    assert set(pieces.doc_id.dropna()) == {i for i in left if i is not None}
    whole = pieces.drop_duplicates("doc_id")
    assert pieces.groupby("doc_id").length.sum().sum() == whole[whole.doc_id.notna()].doc_tokens.sum()


def test_run_equals_the_stages(spark, corpus):
    at = corpus[0]
    docs = common.table(spark, at, "documents")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, at), f"test-{name}")
    key = lambda df: sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in df.collect())
    whole = lambda rows: sorted({(d, n) for d, _, n, _ in rows})
    a, b = key(docs), key(corpus_pipeline.run(spark, at))
    assert {d for d, *_ in a} == {d for d, *_ in b} and sum(r[2] for r in a) == sum(r[2] for r in b) and len(whole(a)) > 0


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_bound_the_bytes_of_a_batch(spark):
    """Long texts reach a worker in batches of bounded bytes, whatever their number of rows."""
    from pyspark.sql import functions as F

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.nbytes]})

    docs = spark.range(0, 12_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcdefgh "), 300).alias("text"))
    for name, stage in corpus_pipeline.STAGES:
        if name == "packing":
            stage(spark, docs, "")
    largest = docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]
    assert largest <= 1.1 * common.BATCH_BYTES


def test_packing_behind_other_stages_holds_less(monkeypatch, docs):
    """The encoder's store and the texts that it cuts at once are smaller than by itself, and the rows the same."""
    given = {}

    def pack(docs, tokenizer, **bounds):
        given.update(bounds)
        return pack_documents(docs, tokenizer, **bounds)

    monkeypatch.setattr(corpus_pipeline, "pack_documents", pack)
    key = lambda df: sorted((str(r.doc_id), r.start, r.length, r.sequence_id, r.offset) for r in df.collect())
    assert key(corpus_pipeline.packing(docs.sparkSession, docs, "")) == key(pack_documents(docs, word_bpe()))
    assert given["cache_bytes"] <= 24 << 20 and given["part"] <= 1 << 20


def test_what_a_worker_holds_at_once_is_small(spark, monkeypatch, docs):
    """Batches of 1 MB and an encoder's store of 12 MB: behind the other stages an executor's JVM leaves two workers no more."""
    given = {}

    def pack(docs, tokenizer, **bounds):
        given.update(bounds)
        return pack_documents(docs, tokenizer, **bounds)

    monkeypatch.setattr(corpus_pipeline, "pack_documents", pack)
    dict(corpus_pipeline.STAGES)["packing"](spark, docs, "")
    assert given["cache_bytes"] <= 12 << 20 and given["part"] <= 1 << 19
    size = int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").lower().rstrip("b"))
    assert 0 < size <= 1 << 20
