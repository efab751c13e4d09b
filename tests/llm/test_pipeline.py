import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
from test_near_dedup import ASCII, brute_force
from test_quality import texts
from tokenizers import Tokenizer

import corpus_pipeline
from graphloom.llm import quality
from graphloom.llm.common import bytes_of


def corpus(tmp_path, spark):
    rng = random.Random(9)
    rows = [(k, t) for k, t, _ in texts(500, 4)]
    items = [(1, " ".join(f"bench{i}" for i in range(14))), (2, "Short item, here"), (3, None)]
    prose = [t for _, t in rows if t.count(".") > 6][:40]
    add = [prose[0], prose[1] + " \n", prose[2].replace(" ", "  "), "  ".join(prose[3].split()[:-1]), prose[4] + " one more.", prose[5] + " Two more.", prose[6] + " " + items[0][1].upper() + ".", prose[7] + " a short ITEM here.", prose[8] + " short item here.", prose[8].replace(".", ",", 1)]
    rows += [(len(rows) + k, t) for k, t in enumerate(add)] + [(5000, None), (5001, "")]
    rng.shuffle(rows)
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, y, 0) for k, _, y in texts(500, 4) if k % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, items


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = quality.train(docs.select("doc_id", "text"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = [(d, t) for d, t in rows if 1 / (1 + np.exp(-model.logits(quality.features(*bytes_of(pa.array([t or ""]))))[0])) >= 0.5]
    best = {}
    for d, t in left:
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    kept = {min(v)[1] for v in best.values()}
    left = [(d, t) for d, t in left if d in kept]
    kept = {d for d, _, c in brute_force(left, 5) if d == c}
    left = [(d, t) for d, t in left if d in kept]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    windows = {tuple(w[i : i + min(10, len(w))]) for w in (words(t) for _, t in items) if w for i in range(len(w) - min(10, len(w)) + 1)}
    left = [(d, t) for d, t in left if not any(tuple(words(t)[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words(t)) - n + 1))]
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((d, plain.encode(t or "", add_special_tokens=False).ids, hashlib.sha256((t or "").encode()).hexdigest()) for d, t in left)
    got = sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want and len(rows) - 150 < len(got) < len(rows) - 90


def test_all_but_the_last_keep_the_columns(spark, tmp_path):
    corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
