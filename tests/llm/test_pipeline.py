import hashlib
import random
from pathlib import Path

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from heddle.llm import encoding, near_dedup, queries


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus with copies, near copies, junk and leaks."""
    rng, root = random.Random(12), tmp_path_factory.mktemp("sf")
    text = lambda n: " ".join(f"{rng.choice('abcdefgh')}{rng.choice(['ing', 'er', 'on', 'al'])}{rng.randrange(900)}" for _ in range(n)) + "."
    docs = [text(rng.randrange(30, 200)) for _ in range(240)]
    junk = [" ".join(w.upper() + "!!" for w in text(60).split()) for _ in range(60)]
    items = [text(25) for _ in range(10)]
    near = [" ".join(["changed", *d.split()[1:]]) for d in docs[:20]]
    leaks = [f"{docs[100 + i]} {items[i % 10]} {text(9)}" for i in range(15)]
    rows = [*docs, *junk, *docs[:30], *near, *leaks]
    rng.shuffle(rows)
    spark.createDataFrame([(i, t, "en", f"s{i % 2}", len(t)) for i, t in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int("!!" not in t), 0) for i, t in enumerate(rows) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), rows, items


def test_stages(spark, tables):
    root, rows, items = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]
    kept, columns = {i for i, t in enumerate(rows) if "!!" not in t}, docs.columns
    after = corpus_pipeline.STAGES[0][1](spark, docs, root)
    assert after.columns == columns and {r["doc_id"] for r in after.collect()} == kept
    last = {}
    for i in sorted(kept):
        last[hashlib.sha256(rows[i].encode()).digest()] = i
    kept = set(last.values())
    after = corpus_pipeline.STAGES[1][1](spark, after, root)
    assert after.columns == columns and {r["doc_id"] for r in after.collect()} == kept
    from test_dedup import brute_classes, brute_leaks

    kept = set(brute_classes([(i, rows[i]) for i in kept]).values())
    after = corpus_pipeline.STAGES[2][1](spark, after, root)
    assert after.columns == columns and {r["doc_id"] for r in after.collect()} == kept
    kept -= {d for d, _, _ in brute_leaks([(i, rows[i]) for i in kept], list(enumerate(items)))}
    after = corpus_pipeline.STAGES[3][1](spark, after, root)
    assert after.columns == columns and {r["doc_id"] for r in after.collect()} == kept
    library = Tokenizer.from_file(encoding.tokenizer_path("word_bpe_49k.json"))
    packed = queries.pipeline(spark, root).collect()
    assert {r["doc_id"] for r in packed} == kept
    assert sum(r["length"] for r in packed) == sum(len(library.encode(rows[i], add_special_tokens=False).ids) + 1 for i in kept)
    assert near_dedup.SHARE == 0.8 and near_dedup.WORDS == 5


def test_every_query_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10


DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    want = con.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_python_gets_few_texts_at_a_time(spark, tables):
    """A batch is held several times outside the heap, in every task of an executor."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(key)
    corpus_pipeline.STAGES[1][1](spark, spark.read.parquet(f"{tables[0]}/documents.parquet"), tables[0]).count()

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [len(batch)]})

    assert max(r["n"] for r in spark.range(5_000, numPartitions=1).mapInArrow(sizes, "n long").collect()) <= 1_000
    spark.conf.set(key, "300")
    corpus_pipeline.STAGES[1][1](spark, spark.read.parquet(f"{tables[0]}/documents.parquet"), tables[0]).count()
    assert spark.conf.get(key) == "300"
    spark.conf.unset(key)
