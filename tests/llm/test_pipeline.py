"""Each stage of the pipeline against brute force on what the stage before kept."""

from __future__ import annotations

import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest

from tripstrata.llm import mixing, pieces
from test_minhash import brute_force


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert 4 <= len(stages) <= 5
    good = corpus_pipeline.staged(corpus_pipeline.keep_good(spark, docs, sf_dir), "t")
    assert good.columns == columns and 0 < good.count() < docs.count()

    single = corpus_pipeline.staged(corpus_pipeline.drop_copies(spark, good, sf_dir), "t")
    best = {}
    for row in good.collect():
        key = re.sub(r"[\x20\x09-\x0D]", "", row.text or "")
        rank = (-len(row.text or ""), row.doc_id)
        best[key] = min(best.get(key, (rank, None)), (rank, tuple(row)), key=lambda x: x[0])if key in best else (rank, tuple(row))
    assert rows_of(single) == sorted((r for _, r in best.values()), key=repr)

    apart = corpus_pipeline.staged(corpus_pipeline.drop_near_copies(spark, single, sf_dir), "t")
    have = [(r.doc_id, r.text) for r in single.collect()]
    smallest = {c for i, _, c in brute_force(have) if c is not None}
    empty = {i for i, text in have if not (text or "").split()}
    assert sorted(r.doc_id for r in apart.collect()) == sorted(smallest | empty)

    mixed = corpus_pipeline.staged(corpus_pipeline.mix_sources(spark, apart, sf_dir), "t")
    copies = {r.id: r.copies for r in mixing.mix(apart).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})
    assert mixed.columns == columns and max(copies.values()) <= 3

    last = corpus_pipeline.encode_pieces(spark, mixed, sf_dir)
    back = last.select("text", pieces.decode(last.tokens, pieces.Vocabulary.load()).alias("back")).collect()
    assert len(back) == mixed.count() and all(r.text == r.back for r in back)


def test_run(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == [*spark.read.parquet(f"{sf_dir}/documents.parquet").columns, "tokens"]
    assert 0 < rows.count()


NAMES = ("block", "digest", "kept", "_row", "id", "component", "part", "text_hash", "payload")


def written(spark, folder, rows, labels):
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in NAMES)
    table = [(i, text, lang, source, n, *NAMES) for i, text, lang, source, n in rows]
    spark.createDataFrame(table, columns).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_documents(spark, tmp_path):
    draw = random.Random(3)
    words = ["".join(draw.choice("etaoinsh") for _ in range(draw.randint(2, 7))) for _ in range(200)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    base = prose(120)
    rows = [(i, prose(80), "en", f"s{i % 3}", 1) for i in range(40)]
    big = 2**60
    rows += [
        (big + 1, base, "en", None, None), (big + 3, f"{base} more", "en", None, 2), (None, prose(90), "en", "s1", 3), (big + 5, prose(60_000), "en", "s2", 4),
        (101, None, "en", "s0", 0), (102, "", None, "s0", 0), (103, " \n", "en", None, 0), (7, rows[7][1], "en", "s1", 1), rows[8], (104, "zq#7 %x kv!" * 40, "en", "s0", 1),
    ]
    folder = written(spark, tmp_path / "in", rows, [(i, 1, 0) for i in range(40)] + [(None, 1, 0), (5, None, None)])
    got = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in got}
    assert {101, 102, 103, 104}.isdisjoint(ids) and big + 3 not in ids
    kept = [i for i in (*range(40), big + 1, big + 5, None) if i in ids]
    # the mix may pass over a document, but takes most, and none more than three times
    assert len(kept) > 30 and max(Counter(r.doc_id for r in got).values()) <= 3
    texts = {(i, text) for i, text, *_ in rows}
    assert all((r.doc_id, r.text) in texts and tuple(r[n] for n in NAMES) == NAMES for r in got)
    assert {r.n_chars for r in got if r.doc_id == big + 1} <= {None}


def test_nothing_and_clashes(spark, tmp_path):
    empty = written(spark, tmp_path / "none", [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0
    docs = spark.createDataFrame([(1, "a b", "x")], "doc_id bigint, text string, tokens string")
    with pytest.raises(ValueError, match="tokens"):
        corpus_pipeline.encode_pieces(spark, docs, "")


@pytest.mark.parametrize("stage", ["exact dedup", "MinHash near-dedup", "mixing sources to target weights"])
def test_rows_meet_keys_of_any_number_by_a_merge(spark, sf_dir, stage):
    """A join that broadcasts few keys and shuffles whole texts for many moves more than in proportion as the input grows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = dict(corpus_pipeline.STAGES)[stage](spark, docs, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


HOLDS = """
import re
from pathlib import Path
from tripstrata.llm.base import tidy

pinned = []


def scan(batches):
    held = [b"%700d" % i for i in range(200_000)]
    pinned.append(b"%700d" % -1)  # what stays lies behind what goes
    yield len(held)


def anonymous():
    return int(re.search(r"Anonymous:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) // 1024


before = anonymous()
assert list(tidy(scan)([])) == [200_000]
print(anonymous() - before)
"""


def test_a_task_gives_its_memory_back():
    """Workers wait for the next task: what they keep of 140 MB counts in all later steps."""
    if sys.platform != "linux":
        pytest.skip("reads /proc")
    run = subprocess.run([sys.executable, "-c", HOLDS], cwd=Path(corpus_pipeline.__file__).parent, capture_output=True, text=True, check=True, timeout=120)
    assert int(run.stdout) < 50


def test_pieces_are_cut_in_small_batches(spark):
    """Whoever writes the last stage's result has Arrow batches of 10,000 rows, of any size."""
    docs = spark.createDataFrame([(i, "some words " * 50, "en") for i in range(50)], "doc_id bigint, text string, lang string")
    found = corpus_pipeline.encode_pieces(spark, docs, "")
    assert found.columns == ["doc_id", "text", "lang", "tokens"] and found.count() == 50
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
