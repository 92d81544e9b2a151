"""The pipeline's stages against a brute-force version of each, on its own input."""

import hashlib
import os
import re
import sys

import duckdb
import pandas as pd
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from millrace.llm import bpe, common, pii, queries

sys.path.insert(0, os.path.dirname(__file__))
from test_text_operators import all_spans  # noqa: E402

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def groups(rows):
    sets = []
    for r in rows:
        w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    return {min(rows[j].doc_id for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}


def sql(name, **tables):
    """Rows of a query's SQL twin over these tables (pandas frames or paths)."""
    con = duckdb.connect()
    for k, v in tables.items():
        if isinstance(v, str):
            con.execute(f"CREATE VIEW {k} AS SELECT * FROM read_parquet('{v}')")
        else:
            con.register(k, v)
    out = con.execute(queries.SQL[name])
    names = [c[0] for c in out.description]
    return [dict(zip(names, r)) for r in out.fetchall()]


def redacted(t):
    out, at = [], 0
    for a, k, z in all_spans(t):
        if a >= at:
            out += [t[at:a], f"<{pii.KINDS[k].upper()}>"]
        at = max(at, z)
    return "".join(out) + t[at:]


def brute(spark, docs):
    """The pipeline's rows: each stage by its SQL twin or by plain loops, one after the other."""
    frame = docs.toPandas()
    kept = {r["doc_id"] for r in sql("op9_quality_rules", documents=frame, labels=f"{SF}/labels.parquet") if r["kept"]}
    rows = [r for r in docs.collect() if r.doc_id in kept]
    one = groups(rows)
    clean = pd.DataFrame([{**r.asDict(), "text": redacted(r.text)} for r in rows if r.doc_id in one])
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in sql("op7_mixing", documents=clean)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(pipe.RANKS)), special_tokens={})
    return sorted((d, src, lang, own.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for d, src, lang, t in zip(clean.doc_id, clean.source, clean.lang, clean.text) for _ in range(taken[d]))


def test_run_is_brute_force(spark):
    got = pipe.run(spark, SF).collect()
    assert sorted((r.doc_id, r.source, r.lang, r.ids, r.decoded_sha256) for r in got) == brute(spark, spark.read.parquet(f"{SF}/documents.parquet"))
    assert all(r.n_tokens == len(r.ids) for r in got)


def test_stages_on_hard_rows(spark):
    """Nulls in every column, empty and repeated rows, clashing names, and empty tables, through all stages."""
    names = ("spans", "kept", "target", "copies", "own_kept", "row", "key", "ids")
    good = "some plain words that are all different from one another here now " * 1
    rows = [(1, good + "x", "en", "a", 5), (1, good + "x", "en", "a", 5), (None, good + "y z q", None, None, None), (3, None, "en", "a", 0), (4, "", "de", None, 0), (5, "few words", "en", "b", 9), (6, good + " mail a@b.co 1.2.3.4 now " + "é" * 3000, "en", "b", None), (7, good.upper() + "x", "en", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for n in names:
        docs = docs.withColumn(n, F.lit(f"own {n}"))
    for some in (docs, docs.limit(0)):
        for _, stage in pipe.STAGES[:-1]:
            some = common.cut(stage(spark, some, SF))
            assert some.columns == docs.columns and some.filter(" or ".join(f"not {n} <=> 'own {n}'" for n in names)).isEmpty()
        assert pipe.encode(spark, some, SF).count() == some.count()
    assert pipe.keep_good(spark, docs, SF).count() == 5
    single = pipe.keep_one_of_each(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in single) == ["1", "3", "4", "5", "6", "None"]  # 7 is 1 in capitals
    clean = {r.doc_id: r for r in pipe.redact(spark, docs, SF).collect()}
    assert "<EMAIL> <IP> now" in clean[6].text and clean[6].n_chars == len(clean[6].text) and clean[3].text is None and clean[4].text == ""


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = common.cut(pipe.keep_good(spark, docs, SF))
    before = {r.doc_id: r for r in docs.collect()}
    good = kept.collect()
    assert kept.columns == docs.columns and {r.doc_id for r in good} <= set(before)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(len(WORD.findall(r.text)) >= 10 for r in good)
    assert sum(labels.get(r.doc_id) == 1 for r in good) >= 0.95 * sum(q == 1 and len(WORD.findall(before[d].text)) >= 10 for d, q in labels.items())
    single = common.cut(pipe.keep_one_of_each(spark, kept, SF))
    assert sorted(r.doc_id for r in single.collect()) == sorted(groups(good))
    clean = common.cut(pipe.redact(spark, single, SF))
    for r in clean.collect():
        assert r.n_chars == len(r.text)
        assert "@" not in before[r.doc_id].text or not re.search(r"[\w.]+@\w+(\.\w+)+", r.text)
    assert pii.find(clean).filter("size(base) > 0").count() == 0
    mixed = common.cut(pipe.mix_sources(spark, clean, SF))
    counts = [r["count"] for r in mixed.groupBy("doc_id").count().collect()]
    assert max(counts) <= 2
    total = lambda df: sum(len(WORD.findall(r.text)) for r in df.collect())
    assert total(mixed) == pytest.approx(1.5 * total(clean), rel=0.1)
    assert sum(r["count"] == 0 for r in mixed.groupBy("doc_id").count().collect()) == 0
    ranks = P.path(pipe.RANKS)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(ranks), special_tokens={})
    texts = {r.doc_id: r.text for r in mixed.collect()}
    out = pipe.encode(spark, mixed, SF).collect()
    assert len(out) == mixed.count()
    assert all(r.ids == own.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids) for r in out)


def test_encoding_takes_one_worker_a_task(spark):
    docs = spark.createDataFrame([(1, "en", "a", "x y")], "doc_id long, lang string, source string, text string")
    assert pipe.encode(spark, docs, SF)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
