"""Stages of the corpus pipeline on small inputs."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tallyloom.llm import mixing, queries, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def test_near_dedup_links_at_80_percent(spark):
    """96 shingles a text: with k last words replaced, the similarity is (96 - k) / (96 + k)."""
    rows = []
    for first, k in ((10, 8), (20, 9), (30, 10), (40, 11)):  # 0.846, 0.829, 0.811, 0.794
        words = [f"w{first}x{i}" for i in range(100)]
        rows += [(first, " ".join(words)), (first + 1, " ".join(words[: 100 - k] + [f"v{first}x{i}" for i in range(k)]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
    assert kept == [10, 20, 30, 40, 41]


BAD = ["vile", "filth", "scum", "trash", "moron", "rot"]
GOOD = [f"word{i}" for i in range(300)]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """300 documents: toxic ones, copies, near copies at 0.8 and more, repeated three-line passages, nulls and empty texts."""
    rng = random.Random(9)
    line = lambda: " ".join(rng.choice(GOOD) for _ in range(12))
    shared = [line() for _ in range(4)]
    rows, toxic = [], {}
    for i in range(300):
        lines = [line() for _ in range(rng.randint(4, 8))]
        if i % 10 == 3:
            lines[1:1] = shared
        if i % 6 == 0:
            lines = [f"{x} you {rng.choice(BAD)} {rng.choice(BAD)}" for x in lines]
        toxic[i] = int(i % 6 == 0)
        rows.append((i, "\n".join(lines), "en", ["a", "b", None][i % 3]))
    rows[101] = (101, rows[100][1], "en", "a")
    words = rows[200][1].split(" ")
    words[7] = "changed"
    rows[205] = (205, " ".join(words), "en", "b")
    long = [rng.choice(GOOD) for _ in range(90)]
    rows += [(303, " ".join(long), "en", "a"), (304, " ".join([*long[:-2], "other", "end"]), "en", "b"), (305, " ".join(long).title(), "en", "b")]
    rows += [(300, None, "en", "a"), (301, "", None, "b"), (302, rows[1][1].upper(), "en", "b")]
    folder = tmp_path_factory.mktemp("corpus")
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in toxic.items()], "doc_id bigint, quality int, toxic int").write.parquet(f"file://{folder}/labels.parquet")
    return f"file://{folder}"


def plain_line_dedup(rows):
    """Every window of three lines that occurred before, by id and position, is covered; covered lines go."""
    seen, out = set(), []
    for i, text in sorted(rows):
        if text is None:
            out.append((i, None))
            continue
        lines = text.split("\n")
        covered = set()
        for k in range(len(lines) - 2):
            window = tuple(lines[k : k + 3])
            if window in seen:
                covered |= {k, k + 1, k + 2}
            seen.add(window)
        out.append((i, "\n".join(x for k, x in enumerate(lines) if k not in covered)))
    return out


def plain_components(rows):
    sets = {}
    for i, text in rows:
        words = (text or "").lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in sets}
    for _ in sets:
        for i in sets:
            for j in sets:
                if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
        if all(root[root[i]] == root[i] for i in root):
            break
    return root


def test_run_equals_plain_stages(spark, corpus):
    """Each stage against plain Python on what the stage before it kept, and run() against them together."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns = docs.columns
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        after[name] = docs.collect()
        assert name == "bpe" or docs.columns == columns
    given = {r.doc_id: r for r in spark.read.parquet(f"{corpus}/documents.parquet").collect()}
    kept = {r.doc_id: r.text for r in after["toxicity"]}
    bad = {i for i in given if i < 300 and i % 6 == 0}
    assert len(bad - set(kept)) >= 0.95 * len(bad) and set(kept) >= set(given) - bad
    model = toxicity.fit(spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.score(spark.read.parquet(f"{corpus}/documents.parquet"), model, ["doc_id"]).collect() if r.score >= 0.5}
    assert set(kept) == set(given) - rejected
    lines = plain_line_dedup(list(kept.items()))
    assert sorted(((r.doc_id, r.text) for r in after["line dedup"]), key=lambda x: x[0]) == lines
    assert sum(a != b for (_, a), b in zip(lines, (kept[i] for i, _ in lines), strict=True)) > 10
    root = plain_components(lines)
    assert sorted(r.doc_id for r in after["near-dedup"]) == sorted(i for i in root if root[i] == i)
    assert {303, 304, 305} & set(root) and {i for i in (303, 304, 305) if root[i] == i} == {303}
    assert not {304, 305} & {r.doc_id for r in after["near-dedup"]}
    assert dict(lines)[101] == "" and 101 not in {r.doc_id for r in after["mixing"]}  # an exact copy loses all its lines
    near = spark.createDataFrame(after["near-dedup"], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    repeats = {r.doc_id: r.repeats for r in mixing.mix_sources(near).collect()}
    assert sorted(r.doc_id for r in after["mixing"]) == sorted(i for i, n in repeats.items() for _ in range(n))
    library = Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY_FILE))
    texts = dict(lines)
    for r in after["bpe"]:
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    run = corpus_pipeline.run(spark, corpus)
    assert sorted(map(str, run.collect())) == sorted(map(str, spark.createDataFrame(after["bpe"], run.schema).collect()))


def test_stages_of_an_empty_table(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.count() == 0


def test_stages_keep_other_columns(spark, corpus):
    """Columns called as the operators' own are those of the input in all stages but the last."""
    names = ("n_lines", "n_removed", "n_shingles", "component_id", "kept", "size", "target", "taken", "repeats", "score", "predicted")
    docs = spark.read.parquet(f"{corpus}/documents.parquet").where("doc_id % 7 = 1")
    docs = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, corpus)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert all(r[n] == f"{n}{r.doc_id}" for r in docs.collect() for n in names), name
