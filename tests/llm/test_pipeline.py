import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import exact_dedup, minhash_dedup, mixing, quality
from lodestone.llm.queries import QUERIES
from lodestone.llm.tokens import cached, tokenizer_path


def test_stages_agree_with_their_operators(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda d: sorted(r["doc_id"] for r in d.select("doc_id").collect())
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert ids(first) == ids(quality.score(docs, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1"))
    second = corpus_pipeline.STAGES[1][1](spark, first, sf)
    assert ids(second) == ids(exact_dedup.find_copies(first).where("kept"))
    third = corpus_pipeline.STAGES[2][1](spark, second, sf)
    assert ids(third) == ids(minhash_dedup.find_near_copies(second).where("kept"))
    fourth = corpus_pipeline.STAGES[3][1](spark, third, sf)
    assert fourth.columns == docs.columns
    want = mixing.mix(third).where("size > 0").select("doc_id", (F.col("taken") / F.col("size")).cast("int").alias("n"))
    assert {r["doc_id"]: r["count"] for r in fourth.groupBy("doc_id").count().collect()} == {r["doc_id"]: r["n"] for r in want.where("n > 0").collect()}
    last = corpus_pipeline.run(spark, sf)
    per_row = last.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).join(fourth.groupBy("doc_id").count(), "doc_id", "full_outer").collect()
    assert all(r["n"] == r["t"] * r["count"] for r in per_row)


def test_near_stage_equals_brute_force_at_four_fifths(spark, tmp_path):
    """Texts that share five-word shingles at 0.80 or more are one group in the pipeline; op10 keeps its 0.85."""
    random.seed(11)
    rows = []
    for g in range(30):  # a text, and copies with one to six words replaced, far apart: 0.95, 0.90, 0.86, 0.81, 0.77, 0.73
        base = [f"g{g}w{i}" for i in range(200)]
        rows.append((10 * g, " ".join(base)))
        changed = {10 + 30 * k for k in range(1 + g % 6)}
        rows.append((10 * g + 1, " ".join(f"new{g}" if i in changed else w for i, w in enumerate(base))))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in rows}

    def kept(percent):
        return sorted(i for i in sets if i % 10 == 0 or 100 * len(sets[i] & sets[i - 1]) < percent * len(sets[i] | sets[i - 1]))

    assert len(kept(85)) - len(kept(80)) == 5
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == kept(80)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    op10 = QUERIES["op10_minhash_dedup"](spark, str(tmp_path))
    assert sorted(r["doc_id"] for r in op10.where("kept").collect()) == kept(85)


def _kept_by_brute_force(rows, percent):
    """Rows (doc_id, text, source) with one of each group of near copies, by sets of word tuples and all pairs."""
    sets = []
    for _, text, _ in rows:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").replace("\x0b", " ").replace("\x0c", " ").split()
        sets.append({tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    first = {}
    for i, (doc_id, _, _) in enumerate(rows):
        first[find(i)] = min(first.get(find(i), doc_id), doc_id)
    return [row for i, row in enumerate(rows) if not sets[i] or row[0] == first[find(i)]]


def _copies_by_brute_force(rows):
    """How often the mix takes each row, by sorting each source's rows by their hash."""
    size = lambda text: len([w for w in re.split("[ \t-\r]+", text or "") if w])
    sources = sorted({s for _, _, s in rows if s is not None}) + [None] * any(s is None for _, _, s in rows)
    total = {s: sum(size(t) for _, t, x in rows if x == s) for s in sources}
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sources)}
    target, open_, budget = {}, list(sources), 1.5 * sum(total.values())
    while open_:  # whoever is above twice its size stops there, the others share the rest anew
        share = budget / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] >= 2 * total[s]]
        if not full:
            target |= {s: share * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * total[s]
            budget -= target[s]
        open_ = [s for s in open_ if s not in full]
    out = {}
    for s in sources:
        times = int(target[s] // total[s]) if total[s] else 0
        rest, used = target[s] - times * total[s], 0
        md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
        hashed = sorted((int(md5(f"{d}:{md5(t or '')}")[:15], 16), d, size(t)) for d, t, x in rows if x == s)
        for _, d, n in hashed:
            extra = used + n <= rest or (used <= rest and 2 * (rest - used) >= n)
            used += n
            out[d] = times + extra
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    """All stages on a table: the scores' decisions, and from there on plain Python."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    weights = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    scores = {r["doc_id"]: r["s"] for r in docs.select("doc_id", quality.scorer(spark, weights)("text").alias("s")).collect()}
    kept = [r for r in rows if scores[r[0]] >= 0.3]
    normal = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    least = {}
    for doc_id, text, _ in kept:
        least[normal(text)] = min(least.get(normal(text), doc_id), doc_id)
    kept = _kept_by_brute_force([r for r in kept if least[normal(r[1])] == r[0]], 80)
    copies = _copies_by_brute_force(kept)
    out = corpus_pipeline.run(spark, sf).collect()
    library = cached(tokenizer_path("byte_bpe_50k.json")).library
    got, windows = {}, {}
    whole = {d: [*library.encode(t or "", add_special_tokens=False).ids, 1] for d, t, _ in kept}
    for r in out:
        ids = whole[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and r["doc_tokens"] == len(whole[r["doc_id"]])
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert got == {d: n * len(whole[d]) for d, n in copies.items() if n}
    for parts in windows.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048


def test_pipeline_on_empty_and_null_tables(spark, tmp_path):
    schema = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").schema
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for name, rows in (("empty", []), ("nulls", [(None,) * len(schema)] * 3 + [(5, None, None, None, None)])):
        folder = str(tmp_path / name)
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        labels.limit(0).write.parquet(f"{folder}/labels.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() == 0
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:3]:
            assert stage(spark, docs, folder).count() == {"quality": len(rows), "exact_dedup": min(len(rows), 1), "near_dedup": len(rows)}[stage_name]
