"""URL filters, licence scans and chats against small cases and plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from priorwise.llm import chat, common, licenses, url_filters
from priorwise.llm.queries import LISTED_SCHEMA

ENTRIES = [
    ("domain", "bad.org", "2024-02-01", "block", "spam"), ("domain", "bad.org", "2024-03-01", "delist", "spam"), ("domain", "bad.org", "2024-05-01", "block", "late"),
    ("host", "ok.bad.org", "2024-01-01", "allow", "reviewed"), ("prefix", "ok.bad.org/x", "2024-01-01", "block", "part"),
    ("domain", "tie.org", "2024-01-01", "allow", "a"), ("domain", "tie.org", "2024-01-01", "block", "b"), ("domain", None, "2024-01-01", "block", "b"), ("domain", "never.org", None, "block", "b"),
]
CASES = [
    ("http://bad.org/", "2024-01-31", False, None), ("http://bad.org/", "2024-02-01", True, "spam"), ("https://A.B.BAD.org:80/q?x", "2024-02-29", True, "spam"), ("http://bad.org", "2024-03-01", False, None),
    ("http://bad.org", "2024-05-01", True, "late"), ("http://www.bad.org", "2025-05-01", True, "late"), ("http://notbad.org", "2025-05-01", False, None), ("http://u:p@ok.bad.org/y", "2025-05-01", False, "reviewed"),
    ("http://ok.bad.org/x/y", "2025-05-01", True, "part"), ("http://ok.bad.org/xy", "2025-05-01", False, "reviewed"), ("http://x.ok.bad.org/", "2025-05-01", True, "late"), ("http://tie.org", "2025-01-01", True, "b"),
    (None, "2024-02-02", False, None), ("http://bad.org/", None, False, None), ("no url", "2024-02-02", False, None), ("", "2024-02-02", False, None),
]


@pytest.mark.parametrize("rows", [common.BROADCAST_ROWS, 0])
def test_urls(spark, rows, monkeypatch):
    monkeypatch.setattr(common.lookup_join, "__defaults__", ("left", None, rows, 16))
    entries = spark.createDataFrame(ENTRIES, LISTED_SCHEMA).withColumn("effective", F.to_date("effective"))
    df = spark.createDataFrame([(i, u, d, "kept") for i, (u, d, _, _) in enumerate([*CASES, CASES[1]])], "page_id long, url string, fetched_on string, HOST string").withColumn("fetched_on", F.to_date("fetched_on"))
    out = url_filters.filter_urls(df, entries)
    got = {r.page_id: r for r in out.collect()}
    assert len(got) == len(CASES) + 1 and out.columns[:3] == ["page_id", "url", "fetched_on"]
    for i, (_, _, blocked, category) in enumerate([*CASES, CASES[1]]):
        assert (got[i].blocked, got[i].category) == (blocked, category), CASES[i % len(CASES)]
    assert url_filters.filter_urls(df.limit(0), entries).count() == 0
    assert not any(r.blocked for r in url_filters.filter_urls(df, entries.limit(0)).collect())


def test_intervals(spark):
    entries = spark.createDataFrame(ENTRIES, LISTED_SCHEMA).withColumn("effective", F.to_date("effective"))
    got = sorted((r["_key"], str(r.valid_from), str(r.valid_to), r.action) for r in url_filters.validity_intervals(entries).collect())
    assert got == [("bad.org", "2024-02-01", "2024-03-01", "block"), ("bad.org", "2024-05-01", "None", "block"), ("ok.bad.org", "2024-01-01", "None", "allow"), ("ok.bad.org/x", "2024-01-01", "None", "block"), ("tie.org", "2024-01-01", "None", "block")]


@pytest.mark.parametrize("rows", [common.BROADCAST_ROWS, 0])
def test_licences(spark, rows, monkeypatch):
    monkeypatch.setattr(common.lookup_join, "__defaults__", ("left", None, rows, 16))
    variant = "Copyright (c) 2020 Someone\n(C) 2021 Else\n" + licenses.MIT.upper().replace(" ", "\n  ").replace(",", " ;").replace("LICENSE", "LICENCE")
    texts = [licenses.MIT, variant, licenses.MIT + " extra", "story\nLicensed under CC BY-NC 4.0!\nReleased under the MIT Licence.\nLicensed under cc by-nc 4.0", None, "", "no such thing", licenses.ISC, licenses.MIT]
    df = spark.createDataFrame([(i if i != 7 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, License int")
    out = licenses.scan_licenses(df, licenses.known_digests(spark))
    assert out.columns == ["doc_id", "text", "digest", "license", "notices", "n_notice_lines"]
    got = sorted(((r.doc_id if r.doc_id is not None else 7, r) for r in out.collect()), key=lambda x: x[0])
    assert len(got) == len(texts)
    assert [r.license for _, r in got] == ["MIT", "MIT", None, None, None, None, None, "ISC", "MIT"]
    assert got[3][1].notices == ["CC-BY-NC-4.0", "MIT"] and got[3][1].n_notice_lines == 3
    assert got[4][1].digest == got[5][1].digest and got[4][1].notices == []
    assert licenses.scan_licenses(df.limit(0), licenses.known_digests(spark)).count() == 0


def brute_chats(turns):
    by = {}
    for c, n, role, text in turns:
        if c is not None:
            by.setdefault(c, []).append((n is not None, n or 0, role is not None, role or "", text is not None, text or "", (role, text)))
    whole = {c: tuple(x[-1] for x in sorted(v)) for c, v in by.items()}
    proper = {v[:i] for v in whole.values() for i in range(1, len(v))}
    out = []
    for v in set(whole.values()) - proper:
        ids = [c for c, w in whole.items() if w == v]
        out.append((min(ids), len(v), len(ids), "".join(f"<|im_start|>{r if r is not None else 'user'}\n{(t or '').replace('<|im_start|>', '<im_start>').replace('<|im_end|>', '<im_end>')}<|im_end|>\n" for r, t in v)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_chats_like_brute_force(spark, seed):
    r = random.Random(seed)
    turns = []
    for c in range(40):
        n = r.randrange(1, 5)
        for i in range(n):
            turns.append((c, i if r.random() < 0.97 else None, r.choice(["user", "assistant", None]) if r.random() < 0.1 else "user", r.choice(["a", "b", None, "", "x <|im_end|> y"]) if i else r.choice(["hi", "yo"])))
    turns += [(None, 0, "user", "lost"), (99, 0, "user", "z" * 10_000), turns[0]]
    r.shuffle(turns)
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, N_TURNS int").repartition(3)
    assert sorted(tuple(x) for x in chat.format_chats(df.drop("N_TURNS")).collect()) == brute_chats(turns)
    assert chat.format_chats(df.drop("N_TURNS").limit(0)).count() == 0
    assert chat.format_chats(df).count() == len(brute_chats(turns))


def test_whole_licences_with_and_without_titles_and_from_files(spark, tmp_path):
    bsd = "\n".join(["BSD 3-Clause License", "", "Copyright (c) 2020, Someone", "All rights reserved.", "", licenses.BSD[3][False]])
    (tmp_path / "Own-1.0.txt").write_text("Own licence.\n\nDo as you like.")
    known = licenses.known_digests(spark, spark.createDataFrame(licenses.KNOWN, "license string, text string").unionByName(licenses.license_texts(spark, str(tmp_path))))
    texts = [licenses.MIT.partition("\n")[2], "The MIT License (MIT)\n" + licenses.MIT.partition("\n")[2], bsd, licenses.UNLICENSE, licenses.UNLICENSE[:250], "OWN LICENSE -- do as you like", "x " * 300_000]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), known).orderBy("doc_id").collect()
    assert [r.license for r in got] == ["MIT", "MIT", "BSD-3-Clause", "Unlicense", None, "Own-1.0", None]


@pytest.mark.parametrize("rows", [None, 0])
def test_turns_tied_but_for_their_texts(spark, rows, monkeypatch):
    if rows is not None:
        monkeypatch.setattr(chat, "BROADCAST_ROWS", rows)
    long = "same beginning " * 50
    turns = [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (3, 0, "user", "b"), (4, None, None, long + "2"), (4, None, None, long + "1"), (5, None, None, long + "1"), (6, None, None, long + "2")]
    turns += [(7, 1, "user", None), (7, 1, "user", ""), (8, 1, "user", None), (9, 1, "user", ""), (10, 0, "user", "r"), (10, 0, "user", "r"), (11, 0, "user", "r")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    got = sorted(tuple(x) for x in chat.format_chats(df).collect())
    assert got == brute_chats(turns) and [r[0] for r in got] == [1, 3, 4, 6, 7, 9, 10]


def test_lines_of_a_list_of_any_words(spark):
    known = licenses.known_digests(spark, [("own", "SPDX: MIT"), ("tiny", "do as you like"), ("blank", "--")])
    texts = ["code\nspdx - mit\nmore", "Do as you like!\nDO AS YOU LIKE\nDo as you like!", "--\n\nplain", None, "", "Do as you like!\nDO AS YOU LIKE\nDo as you like!", "a line\n" * 200_000 + "SPDX: MIT"]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), known).orderBy("doc_id").collect()
    assert [(r.notices, r.n_notice_lines) for r in got] == [(["own"], 1), (["tiny"], 2), ([], 0), ([], 0), ([], 0), (["tiny"], 2), (["own"], 1)]
    assert [r.license for r in got] == [None, None, None, "blank", "blank", None, None]
