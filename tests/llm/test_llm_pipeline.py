"""The registered queries against their SQL twins, and the pipeline on planted documents."""

import random

import duckdb
import pytest

import corpus_pipeline
from holdfast.llm import queries
from holdfast.llm.common import stored

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_twin(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = sorted(repr([r[c] for c in columns]) for r in df.collect())
    cursor = con.execute(queries.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert mine == sorted(repr([r[i] for i in at]) for r in cursor.fetchall())


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(n))


def test_pipeline_on_planted_documents(spark, tmp_path):
    bench = [(i, prose(9_000 + i, 30)) for i in range(3)]
    docs, labels = [], []
    for i in range(240):
        text = f"{prose(i, 60)}\nfollow us on the usual pages today\n{prose(i + 500, 20)}"
        bad = i % 6 == 0
        if bad:
            text += f"\n{prose(i + 900, 8)} zonk{random.Random(i).choice(['face', 'brain'])}"
        docs.append((i, text, "en", f"src{i % 12}", len(text)))
        labels.append((i, 1, int(bad)))
    near = docs[7][1].split(" ")
    near[5] = "changed"
    docs += [(300, " ".join(near), "en", "src3", 0), (301, docs[8][1], "en", "src4", 0), (302, f"{prose(77, 40)} {bench[1][1]} {prose(78, 40)}", "en", "src5", 0)]
    docs += [(303, None, "en", None, None), (304, "", "en", "src1", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    table, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        before = table
        table = stored(stage(spark, table, folder))
        kept.append({r.doc_id for r in table.select("doc_id").collect()})
        if name != "mixing":
            assert table.columns == before.columns
    clean = {i for i in range(240) if i % 6}
    assert kept[0] == clean | {300, 301, 302, 303, 304}
    assert kept[1] == kept[0]
    assert kept[2] == clean | {302, 303}
    assert kept[3] == clean | {303}
    assert kept[4] <= kept[3] and table.where("copies not in (1, 2)").count() == 0
    assert table.where("text like '%usual pages%'").count() <= 1
    assert corpus_pipeline.run(spark, folder).count() == len(kept[4])
