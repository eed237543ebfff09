"""The pipeline's stages against plain Python versions, and the entry module without the optional parts."""

import re
import shutil
import subprocess
import sys
from collections import Counter, defaultdict
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F
from rillflow.llm import bpe, mixing, pii, quality
from tests.llm.test_copies import plain_kept
from tests.llm.test_pii import brute as pii_brute
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
REPO = Path(corpus_pipeline.__file__).parent


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, every, kept = docs.columns, [], docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        rows = out.collect()
        every.append(rows)
        if name != "bpe":
            assert out.columns == columns
            kept = spark.createDataFrame(rows, docs.schema)
    first, good, single, clean, mix, ids = docs.collect(), *every

    model = quality.trained(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    score = model.score(*quality.PassageEncoder().bags([r.text for r in first]))
    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r, s in zip(first, score) if s >= 0.3)

    assert sorted(r.doc_id for r in single) == plain_kept([(r.doc_id, r.text) for r in good]) and set(single) <= set(good)

    text = {r.doc_id: r.text for r in single}
    with_terms = {r.doc_id for r in pii.report(spark.createDataFrame(single, docs.schema)).collect() if r.n_terms}
    assert len(with_terms) < len(single) / 10
    assert len(clean) == len(single)
    for r in clean:
        found = pii_brute(text[r.doc_id])
        for kind in ("email", "ip", "card", "phone"):
            assert r.text.count(f"<{kind}>") <= sum(f.startswith(kind) for f in found)
        if not found and r.doc_id not in with_terms:
            assert r.text == text[r.doc_id]
        for kind, a, b in (f.split(":") for f in found):
            assert text[r.doc_id][int(a) : int(b)] not in re.split("<[a-z-]+>", r.text)
        assert r.n_chars == len(r.text)

    taken, size, source = Counter(), Counter(), defaultdict(int)
    for r in clean:
        n = len(re.findall(mixing.WORD, r.text))
        size[r.doc_id] = n
        source[r.source] += n
    of = {r.doc_id: r.source for r in clean}
    by_source = Counter()
    for r in mix:
        n = len(re.findall(mixing.WORD, r.text))
        taken[r.doc_id] += n
        by_source[of[r.doc_id]] += n
    assert all(taken[i] <= 3 * size[i] for i in taken)
    names = sorted(source)
    for s, goal in zip(names, mixing.targets([source[s] for s in names], [(1, 2, 3)[i % 3] for i in range(len(names))])):
        assert abs(by_source[s] - goal) <= 4 * mixing.BLOCK

    library = Tokenizer.from_file(bpe.default_path())
    want = sorted((r.doc_id, library.encode(r.text, add_special_tokens=False).ids) for r in mix)
    assert sorted((r.doc_id, r.ids) for r in ids) == want and all(r.n_tokens == len(r.ids) for r in ids)


def test_odd_rows_and_empty_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "a word or two", "en", None, 13), (4, "me@x.org " * 5000, "en", "t", 45000)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "bpe":
                assert out.columns == schema.names
                docs = spark.createDataFrame(out.collect(), schema)
        assert out.count() <= 3 * len(rows)


def test_columns_with_the_names_of_inner_ones_pass_through(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    inner = ["d", "h", "k", "marks", "terms", "kind", "text_hash", "fp", "root", "component_id", "score", "size", "src", "block", "start", "uses", "words", "shard", "slot", "old_shard", "ids", "n", "__d", "__h", "__t", "__score", "__row", "__size", "__order", "__key", "__text", "__whole", "row", "key", "stays", "hash"]
    wide = spark.createDataFrame(docs.collect(), docs.schema).withColumns({c: F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")) for c in inner})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, SF)
        if name == "bpe":
            assert out.columns == ["doc_id", "ids", "n_tokens"] and out.count() > 0
            break
        assert out.columns == wide.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in inner)
        wide = spark.createDataFrame(rows, wide.schema)


def test_the_rest_stands_without_these_folders(tmp_path):
    shutil.copytree(REPO / "rillflow", tmp_path / "rillflow", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries() if k[2:3].isdigit() or k == 'pipeline'))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, m, odd = said.stdout.split()
    assert int(n) > 90 and int(m) > 90 and odd == "False"
