"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, per operator."""

from __future__ import annotations

import re
import zipfile

import pytest

from tripstrata.llm import chat, components, exact_dedup, licenses, mixing, warc, zip_archive
from tripstrata.llm.catalogue import new_index
from tripstrata.session import scratch_dir

DOCS = "doc_id bigint, text string, source string, digest string, size int, s string, node string"


def docs(spark, rows):
    return spark.createDataFrame([(*row, *["x"] * 1, 1, "y", "z") for row in rows], DOCS)


# ---------------------------------------------------------------- exact dedup


def test_exact_dedup(spark):
    rows = [(1, "a b", "p"), (2, "ab ", "p"), (3, "a  b", "q"), (4, None, None), (5, "", "p"), (6, " \n", "p"), (None, "a b  ", "p"), (7, "x" * 100_000, "p"), (2, "ab ", "p")]
    table = docs(spark, rows)
    found = {(r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(table, new_index(spark)).collect()}
    # the longest original text stays, then the smallest id
    assert found == {
        (1, None, 5, False), (2, None, 5, False), (3, None, 5, False), (None, None, 5, True),
        (4, 6, 3, False), (5, 6, 3, False), (6, 6, 3, True), (7, 7, 1, True),
    }
    kept = exact_dedup.new_rows(table, new_index(spark))
    assert kept.columns == table.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == ["6", "7", "None"]


def test_exact_dedup_ties_and_repeats(spark):
    table = docs(spark, [(9, "same", "p"), (3, "same", "p"), (3, "same", "p"), (None, "same", "p")])
    rows = exact_dedup.deduplicate(table, new_index(spark)).collect()
    assert {r.keep_id for r in rows} == {3} and sorted(r.kept for r in rows) == [False, False, True, True]
    assert [r.doc_id for r in exact_dedup.new_rows(table, new_index(spark)).collect()] == [3]


def test_digest_index_lasts(spark):
    path = f"{scratch_dir(spark, 'index')}/index"
    first = exact_dedup.DigestIndex(spark, path, 4)
    exact_dedup.deduplicate(docs(spark, [(1, "one", "p"), (2, "two", "p")]), first).collect()
    again = exact_dedup.DigestIndex(spark, path, 4)
    later = docs(spark, [(0, " one ", "p"), (3, "three", "p")])
    assert [r.doc_id for r in exact_dedup.new_rows(later, again).collect()] == [3]
    assert again.read().count() == 3
    # joins on the digest find the index dealt out and sorted already
    known = again.read().select("digest").hint("merge")
    plan = known.join(again.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_a_batch_offered_again_gives_the_same_rows(spark):
    index = new_index(spark)
    first = docs(spark, [(1, "one", "p"), (2, "two", "p"), (3, "one", "p")])
    one = sorted(map(tuple, exact_dedup.deduplicate(first, index, batch="b1").collect()))
    again = sorted(map(tuple, exact_dedup.deduplicate(first, index, batch="b1").collect()))
    assert one == again and [r[4] for r in one].count(True) == 2
    assert [r.doc_id for r in exact_dedup.new_rows(docs(spark, [(4, "two", "p"), (5, "five", "p")]), index, batch="b2").collect()] == [5]
    assert index.read().count() == 3
    index.close()
    assert index.name not in [t.name for t in spark.catalog.listTables()]


def test_exact_dedup_of_nothing(spark):
    empty = docs(spark, [])
    assert exact_dedup.deduplicate(empty, new_index(spark)).count() == 0
    assert exact_dedup.new_rows(empty, new_index(spark)).count() == 0


# ---------------------------------------------------------------- licenses


def scan(spark, rows):
    result, spans = licenses.scan_licenses(docs(spark, rows))
    return {r.id: r for r in result.collect()}, spans.collect()


def test_licenses(spark):
    grant = licenses.TEMPLATES[1][1].split()
    changed = grant[:10] + ["very"] + grant[10:30] + grant[32:]
    rows = [
        (1, "Released under the MIT License.", "p"), (2, "mité license", "p"), (3, None, "p"), (4, "", "p"), (5, " ".join(changed), "p"),
        (6, " ".join(grant[:12]), "p"), (7, "GENERAL public-license, general  PUBLIC license", "p"), (8, "word " * 50_000 + "apache license", "p"), (None, "mit license", "p"),
        (9, "permission is hereby granted " * 2000, "p"), (1, "Released under the MIT License.", "p"),
    ]
    found, spans = scan(spark, rows)
    assert (found[1].n_words, found[1].n_base, found[1].first_word, found[1].labels, found[1].score) == (5, 1, 3, "mit", 1.0)
    assert (found[2].n_base, found[2].first_word, found[2].labels, found[2].score) == (0, None, "", 0.0)
    assert found[3].n_words == found[4].n_words == 0
    assert found[5].base_labels == "" and found[5].labels == "mit" and 0.9 < found[5].score < 1
    assert found[6].labels == ""
    assert (found[7].n_base, found[7].first_word, found[7].last_word, found[7].base_labels) == (2, 0, 3, "gpl")
    assert (found[8].n_words, found[8].first_word) == (50_002, 50_000)
    assert found[None].labels == "mit" and found[9].labels == ""
    assert {(s.id, s.first, s.last) for s in spans if s.id == 5} == {(5, 0, len(changed) - 1)}


def test_licenses_of_nothing(spark):
    assert scan(spark, []) == ({}, [])


# ---------------------------------------------------------------- mixing


def test_mixing(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 4}") for i in range(400)] + [(None, "a b", None), (3, None, "s1"), (3, None, "s1"), (900, "z " * 30_000, "s2")]
    found = mixing.mix(docs(spark, rows)).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.taken <= 3 * r.size for r in found)
    taken, target = {}, {}
    for r in found:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    total = sum(r.size for r in found)
    assert sum(target.values()) == pytest.approx(total)
    for source, wanted in target.items():
        assert abs(taken[source] - wanted) <= 4 * mixing.MixPlan().block_words
    again = mixing.mix(docs(spark, rows[::-1])).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_targets_share_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 5000, None: 20}
    facts = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size bigint")
    found = {r.source: r.target for r in mixing.targets(facts, mixing.MixPlan()).collect()}
    weight = {"a": 1, "b": 2, "c": 3, None: 1}
    wanted, left, free = {}, float(sum(sizes.values())), set(sizes)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            wanted[s] = 3.0 * sizes[s]
            left -= wanted[s]
        free -= over
    wanted |= {s: level * weight[s] for s in free}
    assert found == pytest.approx(wanted)


def test_mixing_of_nothing(spark):
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.mix(docs(spark, [(1, None, None), (2, "", "a")])).select("taken").distinct().collect()[0][0] == 0
    table = docs(spark, [(1, "a b c " * 40, "p"), (2, None, "p")])
    assert mixing.mixed_rows(table).columns == table.columns


# ---------------------------------------------------------------- chat


def test_chat(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "more"),
        (3, 0, "user", "hi"), (3, 1, "assistant", "no"), (4, 5, "user", "hi"), (5, 0, "user", "hi"), (5, 1, "assistant", "no"),
        (6, None, None, None), (None, 0, "user", "x" * 50_000), (7, 1, "user", "a"), (7, 1, "user", "b"),
    ]
    rows = spark.createDataFrame([(*t, "x") for t in turns], "conv_id bigint, turn bigint, role string, text string, place string")
    found = {r.conv: r for r in chat.collapse_and_render(rows).collect()}
    assert set(found) == {2, 3, 6, 7, None}
    assert found[3].copies == 2 and found[2].n_turns == 3
    assert found[2].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert found[7].rendered.index("\na<") < found[7].rendered.index("\nb<")
    assert chat.collapse_and_render(rows.limit(0)).count() == 0


def test_one_conversation_over_many_tasks(spark):
    """A third of all rows in one conversation, and another in the NULL one, repeated turns among them."""
    turns = [(1, n // 3, "user", f"t{n % 5}") for n in range(900)] + [(None, None, "user", "same")] * 600 + [(n, 0, "user", f"x{n}") for n in range(2, 600)]
    rows = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    hashed = chat.rolling_hashes(rows)
    assert {r["count"] for r in hashed.where("conv = 1").groupBy("place").count().collect()} == {1}
    assert hashed.where("conv = 1").agg({"place": "max"}).first()[0] == 900
    found = {r.conv: r for r in chat.collapse_and_render(rows).collect()}
    own = sorted(((t, r, x) for c, t, r, x in turns if c == 1))
    assert found[1].rendered == "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for _, r, x in own)
    assert found[None].n_turns == 600 and found[None].rendered == "<|im_start|>user\nsame<|im_end|>\n" * 600
    assert len(found) == 600


# ---------------------------------------------------------------- archives


def test_archives(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>"), (2, "http://b/é", "<p>"), (3, None, None), (4, "u", ""), (None, "n", "<p>"), (5, "u", "é" * 300_000), (2, "again", "<p>")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, url string, html string, path string")
    manifest = warc.write_packages(pages, scratch_dir(spark, "packages"), package_bytes=200)
    assert manifest.count() > 1
    found = warc.read_records(warc.locate(manifest)).collect()
    assert len(found) == len(rows)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in found), key=repr)
    assert got == sorted(
        [(1, "revisit", 2, 3), (2, "response", None, 3), (2, "response", None, 3), (None, "revisit", 2, 3), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 600_000)],
        key=repr,
    )
    assert {bytes(r.payload).decode() for r in found if r.page_id == 5} == {"é" * 300_000}
    assert all("\n" not in r.url for r in found)
    nothing = warc.write_packages(pages.limit(0), scratch_dir(spark, "packages"))
    assert warc.read_records(warc.locate(nothing)).count() == 0


def test_archives_of_large_ids(spark):
    """Ids beyond what a double holds, NULL among them: every payload is stored once, and revisits name its page."""
    ids = [2**60, 2**60 + 1, 2**60 + 3, None, 2**60 + 5]
    rows = [(i, "u", "same" if n < 4 else "other") for n, i in enumerate(ids)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    found = {r.page_id: r for r in warc.read_records(warc.locate(warc.write_packages(pages, scratch_dir(spark, "packages")))).collect()}
    assert set(found) == set(ids)
    assert {i: (r.record_type, r.refers_to) for i, r in found.items()} == {
        2**60: ("revisit", 2**60 + 3), 2**60 + 1: ("revisit", 2**60 + 3), None: ("revisit", 2**60 + 3), 2**60 + 3: ("response", None), 2**60 + 5: ("response", None),
    }
    assert bytes(found[2**60 + 3].payload) == b"same"


def test_archives_are_read_by_region(spark):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 500) for i in range(400)], "page_id bigint, url string, html string").coalesce(1)
    ranges = warc.locate(warc.write_packages(pages, scratch_dir(spark, "packages")))
    assert ranges.select("path").distinct().count() == 1
    records = warc.read_records(ranges, region_bytes=2000)
    regions = ranges.selectExpr("path", "floor(start / 2000)").distinct().count()
    assert records.rdd.getNumPartitions() == regions > 5 and records.count() == 400


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directory(tmp_path, monkeypatch, wide):
    """Offsets from the directory alone, with ordinary and with ZIP64 fields; comments and packed members are no obstacle."""
    if wide:
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    path = tmp_path / "a.zip"
    held = {"archive/é.bin": b"0123456789" * 50, "indexes/i": b"{}\n{}", "empty": b""}
    with zipfile.ZipFile(path, "w") as out:
        for name, data in held.items():
            out.writestr(name, data)
        out.writestr("packed", b"z" * 1000, zipfile.ZIP_DEFLATED)
        out.comment = b"PK\x05\x06 is in this comment too"
    data = path.read_bytes()
    read = lambda offset, length: data[offset : offset + length]
    found = {m.name: m for m in zip_archive.members(read, len(data))}
    assert set(found) == {*held, "packed"}
    for name, content in held.items():
        start = zip_archive.data_offset(read, found[name])
        assert read(start, found[name].size) == content
    with pytest.raises(ValueError, match="compressed"):
        zip_archive.data_offset(read, found["packed"])
    with pytest.raises(ValueError, match="no end"):
        list(zip_archive.members(lambda o, n: b"\0" * n, 100))


# ---------------------------------------------------------------- components


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 200), (300, 200), (7, 7), (100, 200)] + [(1000, n) for n in range(1001, 1060)]
    links = spark.createDataFrame(pairs, "a bigint, b bigint")
    found = {r.node: r.component for r in components.components(links, "a", "b").collect()}
    assert found == {n: 0 for n in range(41)} | {100: 100, 200: 100, 300: 100} | {n: 1000 for n in range(1000, 1060)}
    assert components.components(links.limit(0), "a", "b").count() == 0


def test_bytes_split_at_the_same_places():
    text = "a\x1cb\x0bc\x0cd\r\n\te  f\x85g h"
    assert [w.decode() for w in text.encode().split()] == re.findall(r"[^\x20\x09-\x0D]+", text)


# ---------------------------------------------------------------- staging


def test_only_the_result_stays(spark):
    from tripstrata.llm.base import condensed, staged
    from tripstrata.storage.files import Files

    folders = []

    def make():
        one = staged(spark.range(10), "one")
        two = condensed(lambda: staged(one.where("id > 2"), "inner").where("id > 4"), "two")
        folders.extend(f.rsplit("/", 2)[0] for f in (one.inputFiles()[0], two.inputFiles()[0]))
        return two.selectExpr("id + 1 as id")

    result = condensed(make, "result")
    assert sorted(r.id for r in result.collect()) == [6, 7, 8, 9, 10]
    assert [Files(spark).exists(f) for f in folders] == [False, False]
    assert Files(spark).exists(result.inputFiles()[0].rsplit("/", 2)[0])
